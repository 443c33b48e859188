"""Stages of the pipeline on repeated rows and null doc_ids."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_one_row_of_each_text_stays(spark, stage):
    rng = random.Random(1)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (3, d), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.text or "", r.doc_id or 0) for r in out.collect() if r.text)
    assert got == sorted([(a, 1), (b, 1), (c, 0), (d, 3)])


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


#: Names that the stages and their operators use inside.
CLASH = ["_row0", "_row1", "_text0", "rid", "_rid", "_t", "row", "spans", "i", "h", "group", "node", "batch", "th", "doc", "score", "kept", "first"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_odd_rows_and_columns(spark, labelled, stage):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, rows = text(20_000), []
    for i in range(60):
        rows.append((i, text(30) + (" snarkly grumblefoo" if i % 3 == 0 else "")))
    odd = [(None, text(30)), (None, None), (70, None), (71, ""), (72, long), (73, "one two"), (73, "one two"), (74, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows + odd], "doc_id long, text string, lang string, source string")
    for c in CLASH:
        docs = docs.withColumn(c, docs["doc_id"])
    out = stage(spark, docs, labelled)
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), labelled).count() == 0
        return
    assert out.schema == docs.schema
    got = out.collect()
    assert all(r[c] == r.doc_id for r in got for c in CLASH)
    bad = {i for i in range(60) if i % 3 == 0} if stage is corpus_pipeline.drop_toxic else set()
    assert {r.doc_id for r in got} >= set(range(60)) - bad and not {r.doc_id for r in got} & bad
    assert next(r.text for r in got if r.doc_id == 72) == long
    want = Counter(odd)
    if stage is corpus_pipeline.drop_copies:  # " " is no empty text
        want = Counter({x: 1 for x in odd if x not in ((None, None), (71, ""))})
    if stage is corpus_pipeline.drop_near_copies:
        want = Counter(set(odd))
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id is None or r.doc_id >= 60) == want
    assert stage(spark, docs.limit(0), labelled).count() == 0
