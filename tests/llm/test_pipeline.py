"""Each stage of the pipeline against plain Python on a small table."""

import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    base = str(tmp_path_factory.mktemp("sf"))
    word = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, texts, toxic = word(80), [], []
    for i in range(160):
        w, bad = word(120), i % 4 == 0
        if bad:
            w[3:3] = ["snarkly", "grumblefoo"]
        texts.append(" ".join(w))
        toxic.append(bad)
    texts[11] = texts[10].replace(" ", "  ")
    texts[14] = texts[13].replace(texts[13].split()[60], "edit", 1)
    for i in (21, 22):
        w = texts[i].split()
        texts[i] = " ".join(w[:40] + passage + w[40:])
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic) if i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, texts, toxic, passage


def test_stages(spark, folder):
    base, texts, toxic, passage = folder
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.table(stage(spark, docs, base))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, bad in enumerate(toxic) if not bad}
    assert set(kept["toxicity"]) == clean
    assert set(kept["exact dedup"]) == clean - {11}
    assert set(kept["n-gram Jaccard join"]) == clean - {11, 14}
    last = kept["substring dedup"]
    assert set(last) == clean - {11, 14}
    assert last[21] == texts[21] and " ".join(passage) not in last[22] and len(last[22].split()) == 120
    assert all(re.sub(r"\s+", " ", last[i]) == texts[i] for i in last if i not in (21, 22))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, base).collect()
    assert {r.doc_id for r in packed} == set(last)
    whole = corpus_pipeline.run(spark, base).collect()
    # Stages are one after the other: run() packs the same ids, though tasks may cut documents at other places.
    sizes = lambda rows: {(r.doc_id, r.doc_tokens) for r in rows}
    assert sizes(whole) == sizes(packed)
    for rows in (whole, packed):
        done = Counter()
        for r in rows:
            done[r.doc_id] += r.length
        assert {(d, n) for d, n in done.items()} == sizes(rows)
