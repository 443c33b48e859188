"""The ten operators against brute force, with nulls, empty tables, ties, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe_reuse, exact_dedup, jaccard_join, language_id, line_dedup, packing, sharding, substring_dedup, topk_search, toxicity
from tessera.llm._memo import Spaced, Words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["rid", "_t", "th", "key", "level", "node", "batch", "seed", "h", "t"]


def documents(spark, texts, ids=None, lang="en", source="s"):
    rows = [(i if ids is None else ids[i], t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_op6_matches_plain_grouping(spark):
    rng = random.Random(1)
    long = " ".join(words(rng, 9000))
    texts = ["a  b", "a\tb", None, "", " ", "a b", long, long.replace(" ", "\n"), long + " x", "a b", "é" * 5000, "é" * 5000]
    docs = documents(spark, texts, [5, 4, 3, 2, 1, None, 10, 11, 12, 5, 20, 21])
    norm = [__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for fingerprint in (F.xxhash64, lambda c: F.length(c).cast("long") % 3):  # the second makes different blocks collide
        got = exact_dedup.exact_dedup(docs, block_chars=64, fingerprint=fingerprint).collect()
        want = Counter(hashlib.sha256(t.encode()).hexdigest() for t in norm)
        assert Counter((r.text_sha256, r.group_size) for r in got) == Counter({(h, n): n for h, n in want.items()})
        assert sum(r.kept for r in got) == len(want)
        assert {r.doc_id for r in got if r.kept} == {1, 2, 4, 10, 12, 20}
        keep = {r.text_sha256: r.keep_id for r in got}
        assert keep[hashlib.sha256(b"a b").hexdigest()] == 4
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def brute_links(texts, threshold=0.8):
    def shingles(t):
        w = t.encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t or "") for i, t in enumerate(texts)}
    rep = {}
    for i, s in sets.items():
        if s:
            rep.setdefault(s, i)
    links = defaultdict(set)
    for s in rep:
        for u in rep:
            if s != u and len(s & u) >= threshold * len(s | u) - 1e-9:
                links[rep[s]].add(rep[u])
    return sets, rep, links


def test_op4_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(40)]
    for _ in range(90):  # a large group of near copies, more than one block
        w = texts[3].split() if rng.random() < 0.3 else " ".join(texts[5:9]).split()
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(5))
        texts.append(" ".join(w))
    texts += [None, "", "  ", texts[7], texts[7].replace(" ", "\n"), "one two", "one two"]
    got = jaccard_join.jaccard_join(documents(spark, texts), block=16).collect()
    sets, rep, links = brute_links(texts)
    label = {}
    for start in sorted(rep.values()):
        stack = [start] if start not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = start
                stack += links[x]
    assert len(got) == len(texts)
    for r in got:
        s = sets[r.doc_id]
        want = (label[rep[s]], rep[s], len(links[rep[s]])) if s else (r.doc_id, r.doc_id, 0)
        assert (r.class_id, r.rep_id, r.n_links) == want
    assert sum(r.first for r in got) == len({r.class_id for r in got})
    assert jaccard_join.jaccard_join(documents(spark, texts).limit(0)).count() == 0
    odd = jaccard_join.jaccard_join(documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [None, 7, 7])).collect()
    assert [r.rep_id for r in odd] == [7, 7, 7] and sum(r.first for r in odd) == 1
    assert jaccard_join.prefix_length(0.8, 0.9999) == 6


def test_op2_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    passage, fuzzy = words(rng, 70), words(rng, 120)
    texts = []
    for k in range(24):
        w = words(rng, 150)
        if k % 3 == 0:
            w[50:50] = passage
        if k % 4 == 1:
            f = list(fuzzy)
            for _ in range(6):
                f[rng.randrange(len(f))] = "other"
            w[20:20] = f
        texts.append(" ".join(w))
    cycle = " ".join(words(rng, 30) * 6)
    texts += [cycle + " " + "x", cycle + " y", None, "", "short text"]
    docs = documents(spark, texts)
    found = substring_dedup.passages(docs).collect()
    spans = defaultdict(list)
    for r in found:
        assert r.other < r.doc_id and r.similarity >= 0.8 and max(r.end - r.start, r.other_end - r.other_start) >= 50
        spans[r.doc_id].append((r.start, r.end))
    first, n = {}, 0
    for i, t in enumerate(texts):
        w, own = (t or "").split(), {}
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if g in first:
                n += 1
                assert any(s <= k and e >= k + 50 for s, e in spans[i]), (i, k)
            else:
                own[g] = i
        first.update(own)
    assert n > 100 and all(i in spans for i in range(5, 24, 4)) and not set(spans) - {*range(0, 24, 3), *range(1, 24, 4), 25}
    cut = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs, substring_dedup.passages(docs)).collect()}
    assert cut[0] == texts[0] and cut[26] is None and " ".join(passage) not in cut[3] and len(cut[3].split()) == 150
    assert substring_dedup.passages(docs.limit(0)).count() == 0
    nulls = documents(spark, [texts[0], texts[0], texts[0]], [None, 3, 3])
    assert [(r.doc_id, r.other) for r in substring_dedup.passages(nulls).collect()] == [(None, 3)]  # null comes last; one doc_id and text are one document


def test_op2_chain_and_alignment():
    chains = substring_dedup.chain([(0, 0, 10), (12, 13, 10), (300, 30, 10), (24, 25, 10), (15, 2, 4)])
    assert chains[0] == [(0, 0, 10), (12, 13, 10), (24, 25, 10)]
    assert substring_dedup.align(list("abcxdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]


def test_op3_shards_fit_and_hold_all(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(0, 3000) for _ in range(300)] + [None, "", "y" * 50_000]
    got = sharding.shard(documents(spark, texts), 8000).collect()
    total, rows = defaultdict(int), Counter()
    for r in got:
        total[r.shard_id] += len(texts[r.doc_id] or "")
        rows[r.shard_id] += 1
    assert len(got) == len(texts)
    for r in got:
        assert r.shard_bytes == total[r.shard_id] and r.shard_docs == rows[r.shard_id]
        assert r.shard_bytes <= 8000 or r.shard_docs == 1
    # Bit strings of shards are no prefixes of each other.
    bits = {format(int(s.split("-")[1]), f"0{int(s.split('-')[0])}b") for s in total}
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    hot = sharding.shard(documents(spark, ["z" * 500] * 200, [7] * 150 + [None] * 50), 8000).collect()
    assert len(hot) == 200 and max(r.shard_bytes for r in hot) <= 8000
    assert sharding.shard(documents(spark, texts).limit(0)).count() == 0


def test_op1_removes_shared_lines(spark):
    rows = []
    for i in range(40):
        lines = [f"own line {i}", " menu ", "", f"group {i % 12}"]
        rows.append((i, "\n".join(lines), "en", f"site{i % 12}" if i != 3 else None, 0))
    rows += [(50, None, "en", "site0", 0), (None, "menu\nother", "en", "site1", 0), (None, "menu", "en", "site1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH})
    got = line_dedup.line_dedup(docs, min_sites=10).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].clean_text == "own line 5\n\ngroup 5" and (by[5].n_lines, by[5].n_removed) == (3, 1)
    assert by[50].clean_text == "" and {r.clean_text for r in got if r.doc_id is None} == {"other", ""}
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(docs, min_sites=13).collect())
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("all"), F.concat(F.lit("half"), F.col("id") % 2)).alias("text"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"))
    assert {r.n_removed for r in line_dedup.line_dedup(many, min_sites=1500).collect()} == {2}
    assert {r.n_removed for r in line_dedup.line_dedup(many, min_sites=1501).collect()} == {1}
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_op5_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 40)) * rng.random((700, 1))
    v[10:40] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, []), (1020, []), (1004, [1.0] * 3), (None, v[0].tolist()), (20, v[1].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit(0)).repartition(3)
    got = defaultdict(list)
    for r in topk_search.top_k(t, F.col("vec_id") % 20 == 0, k=7, block=128, query_block=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    w = [(i if i is not None else 1 << 62, np.floor(64 * np.array(x)).astype(int)) for i, x in rows if i not in (1000, 1001, 1002)]
    for k, (i, x) in enumerate(w):
        if i % 20 or i == 20 or i > 1 << 60:
            continue
        s = sorted((-int(x @ y), j) for n, (j, y) in enumerate(w) if n != k and len(y) == len(x))[:7]
        assert sorted(got[i]) == [(n + 1, j if j < 1 << 60 else None, -q) for n, (q, j) in enumerate(s)], i
    assert len(got[20]) == 14 and got[1020] == [(1, 1003, 0)]
    assert topk_search.top_k(t.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    big = spark.createDataFrame([(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, -1.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk_search.top_k(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [2**60 + 64 * 192, 2**60 - 64 * 64]


ODD = ["", " ", "a  b", "x <|endoftext|> y<|endoftext|>z", "it's  'll\n\n x\t   y 　 z", "é ́x ΑΣ ΑΣ. ÏİI ﬁ", "\x1cfoo\x1d bar \x85 baz", "12 3'4", "日本語　全角", "abc%%% d-e_f", "\nab.\nCd", "a|>b <| c", "J̌ é1ñ!!"]


@pytest.mark.parametrize(("kind", "path"), [(Words, WORD), (Spaced, BYTE)])
def test_memo_encodes_as_the_library(kind, path):
    rng, t = random.Random(6), Tokenizer.from_file(path)
    texts = ODD + ["".join(rng.choice([" ", "  ", "\n", "ab", "B", "é", "'s", "1", "<|endoftext|>", " ", "\t", ",", "́", "-", "the "]) for _ in range(rng.randrange(30))) for _ in range(500)]
    memo = kind(path, keep=50)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        for x, ids in zip(part, memo.encode([p.encode() for p in part]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_op7_encodes_and_decodes_as_the_library(spark):
    rng, t = random.Random(7), Tokenizer.from_file(BYTE)
    shared = " ".join(words(rng, 900)) + ",  é <|endoftext|> it's\n\n"
    texts = [*ODD, None, "x" * 20_000, "né" * 9000, *[" ".join(words(rng, 50)) + shared + " ".join(words(rng, 80)) for _ in range(6)], shared, shared]
    ids = [None, *range(1, len(texts))]
    got = bpe_reuse.encode_decode(documents(spark, texts, ids).repartition(3), BYTE).collect()
    assert len(got) == len(texts)
    for r in got:
        want = t.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.text == t.decode(want, skip_special_tokens=False)
    assert bpe_reuse.encode_decode(documents(spark, texts).limit(0), BYTE).count() == 0


def test_op7_joins_any_chunks():
    rng, t, j = random.Random(8), Tokenizer.from_file(BYTE), bpe_reuse.Joiner(BYTE)
    for _ in range(400):
        x = "".join(rng.choice([" ", "  ", "\n", "ab", "é", "'s", "1", "<|endoftext|>", "́", "the ", "日", "<|"]) for _ in range(rng.randrange(60))).encode()
        parts = bpe_reuse.chunks(x, 16, 4, 40)
        assert b"".join(parts) == x
        ids = j.whole(list(zip(parts, j.encode(parts), strict=True)))
        assert ids.tolist() == t.encode(x.decode(), add_special_tokens=False).ids


def test_op8_packs_every_id_once(spark):
    rng, t = random.Random(9), Tokenizer.from_file(WORD)
    texts = [" ".join(words(rng, rng.choice([0, 3, 60, 300, 900, 2500]))) for _ in range(60)] + [None, "", " ".join(words(rng, 9000))]
    got = packing.pack_documents(documents(spark, texts, [None, *range(1, len(texts))]), WORD, buffer_tokens=60_000).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i or None], key=lambda r: r.start)
        assert [v for r in own for v in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in own)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        size = sum(r.length for r in w)
        assert [r.offset for r in w] == np.cumsum([0, *(r.length for r in w)])[:-1].tolist()
        assert size <= 4096 and size & (size - 1) == 0
    assert packing.pack_documents(documents(spark, texts).limit(0), WORD).count() == 0


def test_op8_pack_and_balance():
    rng = random.Random(10)
    for _ in range(50):
        lengths = [rng.choice([1, 5, 511, 512, 513, 2047, 4095, 4096, 4097, 9000]) for _ in range(rng.randrange(1, 40))]
        rows = packing.pack(lengths)
        assert sum(n for r in rows for n, _, _ in r) == sum(lengths)
        cover = defaultdict(list)
        for r in rows:
            for n, d, s in r:
                cover[d].append((s, n))
        for d, own in cover.items():
            own.sort()
            assert [s for s, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == lengths[d]
    sizes = [4096] * 20 + [512] * 80
    groups = packing.balance(sizes, 30_000)
    load = [sum(s for s, g in zip(sizes, groups, strict=True) if g == k) for k in set(groups)]
    assert max(load) - min(load) <= 4096


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op9_learns_and_forgets_names(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = words(rng, 60, 500)
        if bad:
            w[5:5] = [rng.choice(["grumblefoo", "snarkly"]) + rng.choice(["", "s", "ish"])]
        if rng.random() < (0.8 if bad else 0.1):  # a name that goes with the label in training
            w[9:9] = ["muslims"]
        rows.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    rows += [None, "", "we met some muslims and christians there", "we met some people there"]
    docs = documents(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == _held_out(i) for i in got)
    test = [i for i in range(900) if _held_out(i)]
    assert sum((got[i].predicted == 1) == (i % 3 == 0) for i in test) >= 0.95 * len(test)
    assert abs(got[902].score - got[903].score) < 0.05 and got[902].predicted == 0
    assert got[900].score == got[901].score
    free = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks, steady=0.0).collect()}
    assert abs(free[902] - free[903]) > abs(got[902].score - got[903].score)
    none = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_op10_tells_languages(spark):
    rng = random.Random(12)
    stems = {"en": ["the", "and", "thing", "where", "with"], "fr": ["le", "eau", "être", "aux", "qui"], "de": ["der", "sch", "ung", "zu", "keit"]}
    rows = []
    for i in range(600):
        lang = sorted(stems)[i % 3]
        text = " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(2, 60)))
        rows.append((i, text, lang if i % 10 else None, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "12 34 ...", "en", "s", 0), (None, "the thing and", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.language_id(docs, per_language=100).collect()}
    assert len(got) == len(rows)
    test = [i for i in range(600) if _held_out(i)]
    assert sum(got[i].lang_pred == sorted(stems)[i % 3] for i in test) >= 0.95 * len(test)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0
