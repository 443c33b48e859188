"""Cases in which operators must not lose, mix or split rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_links, documents, words

from tessera.llm import jaccard_join, line_dedup, sharding, topk_search


def test_op4_shortens_prefixes_to_the_target_recall():
    assert set(jaccard_join.prefix_lengths(0.8, 0.99)) == {jaccard_join.DEPTH}  # full paths do
    for recall in (0.999, 0.9999):
        lengths = jaccard_join.prefix_lengths(0.8, recall)
        found = lambda x: 1 - np.prod([1 - 0.8**k for k in x])
        assert found(lengths) >= recall and lengths == sorted(lengths, reverse=True) and max(lengths) > min(lengths)
        longer = [*lengths]
        longer[-1] += 1
        assert found(longer) < recall


def test_op4_recall_of_the_forest(spark):
    """Links between texts at 0.8 and little above, in a crowd of texts that share much less, against brute force."""
    rng = random.Random(21)
    common = words(rng, 60, 10**6)
    texts = []
    for _ in range(150):
        base = words(rng, 60, 10**6)
        other = list(base)
        for k in rng.sample(range(3), 1) + rng.sample(range(57, 60), 1):
            other[k] = "edit"
        texts += [" ".join(base), " ".join(other)]
    for _ in range(150):  # half of their words in common: candidates that aren't links
        w = common[: rng.randrange(35, 45)] + words(rng, 25, 10**6)
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(documents(spark, texts), block=16).collect()}
    _, rep, links = brute_links(texts)
    want = sum(len(v) for v in links.values())
    assert want >= 200 and sum(r.n_links for r in got.values()) >= 0.999 * want
    assert all(r.n_links <= len(links[r.doc_id]) for r in got.values())


def test_op4_long_texts_and_clashing_columns(spark):
    rng = random.Random(22)
    long = words(rng, 20_000, 5000)
    texts = [" ".join(long), " ".join(long[:-5] + ["x"] * 5), " ".join(long[:10_000]), "", None]
    docs = documents(spark, texts)
    for name in ("rid", "group", "node", "label", "n", "sig", "keys", "rests", "d", "m"):
        docs = docs.withColumn(name, F.lit("y"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0)}


def test_op5_floor_and_size_of_components(spark):
    rng = np.random.default_rng(23)
    v = rng.normal(size=(900, 24)) * np.exp(rng.normal(size=(900, 1)) * 2)
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("norm", "floor", "block", "_q", "_e", "v")})
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(t, F.col("vec_id") % 20 == 0, k=5, block=64, query_block=8).collect()}
    w = np.floor(64 * v).astype(int)
    for i in range(0, 900, 20):
        s = sorted((-int(w[j] @ w[i]), j) for j in range(900) if j != i)[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, -q) for q, j in s]
    one = lambda x: spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(one(2.0**25), F.col("vec_id") == 0).first().score == 2**62
    for x in (1e30, 2.0**27):
        with pytest.raises(Exception, match="long|large|int"):
            topk_search.top_k(one(x), F.col("vec_id") == 0).collect()


def test_op3_written_shards_keep_their_limit(spark, tmp_path):
    rng = random.Random(24)
    texts = ["x" * rng.randrange(200, 900) for _ in range(200)] + [None, ""]
    docs = documents(spark, texts, [7] * 90 + [None] * 30 + list(range(82))).withColumn("key2", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "out"), 8000)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    size = Counter()
    for r in rows:
        size[r.shard_id] += len(r.text or "")
    listed = {r.shard_id: r for r in spark.read.parquet(str(tmp_path / "out/_directory")).collect()}
    assert max(size.values()) <= 8000 and {k: r.shard_bytes for k, r in listed.items()} == size
    bits = [r.prefix for r in listed.values()]
    assert len(set(bits)) == len(bits) and not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert all(len(list((tmp_path / f"out/shard_id={k}").glob("*.parquet"))) == 1 for k in listed)
    with pytest.raises(ValueError, match="shard_id"):
        sharding.write_shards(back, str(tmp_path / "again"))


def test_op1_texts_of_one_doc_id(spark):
    rows = [(None, f"menu\nown {i}", "en", f"s{i % 12}", 0) for i in range(40)] + [(5, "menu\na", "en", "s1", 0), (5, "menu", "en", "s1", 0), (6, "z " * 30_000 + "\nmenu", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("th", "_th", "_id", "bad", "k", "l", "site")})
    got = line_dedup.line_dedup(docs, min_sites=10).collect()
    assert Counter(r.clean_text for r in got if r.doc_id is None) == Counter(f"own {i}" for i in range(40))
    assert sorted(r.clean_text for r in got if r.doc_id == 5) == ["", "a"] and len(got) == len(rows)
    assert next(r for r in got if r.doc_id == 6).clean_text == "z " * 30_000
