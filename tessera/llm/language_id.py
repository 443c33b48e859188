"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed 1-, 2- and 3-grams of their lower-case letters, weighted by
their share of the text and by an inverse document frequency counted over all
training documents. The weights are learned by follow-the-regularised-leader
with elastic-net penalties, and one temperature is fitted on rows set aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ftrl import Ftrl, take
from ._grams import codes, groups, hashed
from ._io import held_out, text_or_empty

BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
#: A model has SIZE weights for each language, so there must be a bound.
MOST_LANGUAGES = 2000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every 1-, 2- and 3-gram that holds a letter or digit."""
    points, owner = codes(texts)
    parts = []
    for n in (1, 2, 3):
        h = hashed(points, n, BITS)
        any_letter = np.logical_or.reduce([points[k : k + len(h)] > 0 for k in range(n)])
        parts.append((owner[: len(h)][any_letter], h[any_letter]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, share of the text's n-grams), each pair once, by text."""
    owner, f = grams(texts)
    both, n = np.unique(owner * SIZE + f, return_counts=True)
    owner, f = both >> BITS, both & (SIZE - 1)
    return owner, f, n / np.maximum(1, np.bincount(owner, n, len(texts)))[owner]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _rows(docs: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(lang).cast("string").alias("_lang"), text_or_empty(F.col(text)).alias("_t"))


def _usable() -> object:
    return F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))


def document_frequencies(training: DataFrame) -> np.ndarray:
    """In how many training texts each feature stands; index SIZE has the number of texts.

    Tasks send at most SIZE + 1 sums each, however many rows they read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            df[SIZE] += len(texts)
            for _, part in groups(texts):
                owner, f = grams(part)
                seen = np.zeros(SIZE, bool)
                starts = np.flatnonzero(np.diff(np.sort(owner, kind="stable"), prepend=-1))
                by = f[np.argsort(owner, kind="stable")]
                for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
                    seen[:] = False
                    seen[by[a:b]] = True
                    df[:SIZE] += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["f", "n"])

    out = np.zeros(SIZE + 1)
    for f, n in training.select("_t").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n")).collect():
        out[f] = n
    return out


def sample(training: DataFrame, distinct: dict[str, int], per_language: int) -> DataFrame:
    """The per_language documents with the smallest hashes of _id and text of each language, all documents of smaller ones.

    A document counts once however often its row is repeated. distinct: about
    how many documents each language has; those far above its share are left
    out before the ranking, but where it has few all stay.
    """
    share = F.create_map(*[F.lit(x) for lang, n in distinct.items() for x in (lang, min(1.0, (4.0 * per_language + 100) / max(1, n)))])
    few = training.withColumn("_h", F.xxhash64("_id", "_t")).where(F.col("_h") / float(1 << 64) + 0.5 <= F.element_at(share, F.col("_lang")))
    each = few.groupBy("_lang", "_h").agg(F.min("_id").alias("_id"), F.min("_t").alias("_t"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    return each.withColumn("_n", rank).where(F.col("_n") <= per_language).drop("_h", "_n")


def fit(docs: DataFrame, per_language: int = 500, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", epochs: int = 4) -> dict:
    """{"langs", "w", "bias"}: weights that include the inverse document frequencies and the temperature.

    Learned from documents outside the held-out quarter with a language; the
    classifier from at most per_language documents of each language, those with
    the smallest hashes, the document frequencies from all. Of more than
    MOST_LANGUAGES languages those with the most rows are learned (of equals, the
    first by code point), so that stray values of lang neither fail the job nor
    crowd out real ones.
    """
    training = _rows(docs, text, doc_id, lang).where(_usable())
    counts = training.groupBy("_lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("_id", "_t")).alias("d"))
    counts = {lang: d for lang, _, d in counts.orderBy(F.desc("n"), "_lang").limit(MOST_LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "w": np.zeros((SIZE, 0), np.float32), "bias": np.zeros(0)}
    df = document_frequencies(training)
    training = training.where(F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(True))]), F.col("_lang")))
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE]))
    idf = 1.0 + idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, part in groups(texts):
                whole, f, tf = counted(part)
                edge = np.searchsorted(whole, np.arange(len(part) + 1))
                pieces = [t[len(t) // 3 :][:60] for t in part]  # a fragment too, as short texts look
                whole2, f2, tf2 = counted(pieces)
                edge2 = np.searchsorted(whole2, np.arange(len(part) + 1))
                names = batch.column(0).slice(at, len(part)).to_pylist()
                out = [(n, f[a:b], tf[a:b]) for n, a, b in zip(names, edge, edge[1:], strict=False)]
                out += [(n, f2[a:b], tf2[a:b]) for n, a, b in zip(names, edge2, edge2[1:], strict=False)]
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "f", "tf"])

    chosen = sample(training, counts, per_language).select("_lang", "_t")
    t = chosen.mapInArrow(run, "lang string, f array<int>, tf array<float>").toArrow()
    y = np.searchsorted(langs, np.array(t["lang"].to_pylist(), dtype=object).astype(str)) if len(t) else np.zeros(0, np.int64)
    lists = [t[c].combine_chunks() for c in ("f", "tf")]
    idx, val, ptr = np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten()), np.asarray(lists[0].offsets)
    val = val * idf[idx]
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    aside, order = order[: len(order) // 5], order[len(order) // 5 :]
    model = Ftrl(SIZE, len(langs), alpha=4.0, beta=1.0, l1=0.002, l2=0.001)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), 32):
            rows = order[k : k + 32]
            owner, f, v = take(rows, ptr, idx, val)
            if not len(f):
                continue
            at, inv = np.unique(f, return_inverse=True)
            x = np.zeros((len(rows), len(at)))
            x[owner, inv] = v
            p = _softmax(x @ model.weights(at))
            p[np.arange(len(rows)), y[rows]] -= 1
            model.update(at, x.T @ p)
    w = model.weights(np.arange(SIZE))
    test = aside if len(aside) >= 20 else np.arange(len(y))
    owner, f, v = take(test, ptr, idx, val)
    z = np.stack([np.bincount(owner, v * w[f, c], len(test)) for c in range(len(langs))], 1)
    scales = np.geomspace(0.05, 20, 60)
    loss = [(-np.log(_softmax(z * s)[np.arange(len(test)), y[test]] + 1e-12)).mean() for s in scales]
    scale = scales[int(np.argmin(loss))]
    return {"langs": langs, "w": (w * idf[:, None] * scale).astype(np.float32), "bias": np.zeros(len(langs))}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def language_id(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    A text that is null or has no letters is "und" with score 0, as is every
    text if no document has a language. The MOST_LANGUAGES languages with the
    most rows can be predicted, however few documents a language's rows repeat. Null doc_ids are predicted and not held
    out, repeated rows get the same answer, texts of any length count whole, an
    empty table gives an empty result, and other columns take no part.
    """
    model = fit(docs, text=text, doc_id=doc_id, lang=lang, **how)
    langs, w = model["langs"], model["w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for at, part in groups(texts):
                owner, f = grams(part)
                total = np.maximum(1, np.bincount(owner, minlength=len(part)))
                z = np.stack([np.bincount(owner, w[:, c][f], len(part)) for c in range(len(langs))], 1) / total[:, None] if langs else None
                for k, t in enumerate(part):
                    if langs and has_letter(t):
                        p = _softmax(z[k : k + 1])[0]
                        best[at + k], score[at + k] = langs[int(p.argmax())], float(p.max())
            out = [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("_t"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_t")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
