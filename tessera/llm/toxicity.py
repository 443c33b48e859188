"""Toxicity by a logistic classifier that is held steady when a group's name is swapped.

Features are the within-word character 5-grams of a text, present or not, so a
text's length and order don't matter. For each labelled sentence that names a
group, the name is swapped for others of its kind, and or left out, and
squared changes of the score are added to the loss: the names themselves carry
no weight in the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ftrl import Ftrl, take
from ._grams import codes, groups, hashed
from ._io import held_out, table, text_or_empty

BITS = 18
_EDGE = ",;:\"'()"
GRAM = 5
#: Neutral names of groups, by kind and language; each is swapped for the others of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
#: The others of a name's kind, and no name at all: a name shared by toxic sentences must not count by itself.
_SWAPS = {t: (*dict.fromkeys(x for kind in IDENTITIES if t in kind for x in kind if x != t), "") for row in IDENTITIES for t in row}


def present(texts: list[str], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each once: hashed runs of GRAM characters of a word, its ends counting as characters.

    Words of fewer than GRAM - 2 characters have none. among: features to look
    for, as a mask.
    """
    points, owner = codes(texts)
    h = hashed(points, GRAM, BITS)
    inner = np.logical_and.reduce([points[k : k + len(h)] > 0 for k in range(1, GRAM - 1)])
    if among is not None:
        inner &= among[h]
    both = np.unique((owner[: len(h)][inner] << BITS) + h[inner])
    return both >> BITS, both & ((1 << BITS) - 1)


@lru_cache(1 << 14)
def _of(token: str) -> frozenset[int]:
    """A token's features; no feature reaches across a space."""
    return frozenset(present([token])[1].tolist())


def swapped(text: str) -> set[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Features that come and go with each swap of a group's name in a sentence, each such change once."""
    out = set()
    for sentence in re.split(r"[.!?\n]", text):
        tokens = sentence.split()
        named = [t for t in tokens if t.strip(_EDGE) in _SWAPS]
        if named:
            count = Counter(f for t in tokens for f in _of(t))
            for token in named:
                for other in _SWAPS[token.strip(_EDGE)]:
                    old, new = _of(token), _of(other)
                    out.add((tuple(sorted(f for f in new if not count[f])), tuple(sorted(f for f in old - new if count[f] == 1))))
    return out


def usable_labels(labels: DataFrame) -> DataFrame:
    """(_id, _y): one row for each doc_id outside the held-out quarter with a label of 0 or 1, 1 if it has both."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    return usable.where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))


def training_rows(docs: DataFrame, usable: DataFrame, per_class: int, text: str, doc_id: str) -> DataFrame:
    """(y, idx, less) of one row for each of at most per_class labels of each class, y -1 for swaps: features gained and lost.

    The labels with the smallest hashes of doc_id are taken, and of the rows of
    one doc_id a text with the smallest hash: however often a document is
    repeated, a label has one row.
    """
    first = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), text_or_empty(F.col(text)).alias("_t"))
    first = F.min(F.struct(F.xxhash64("_t").alias("h"), "_t"))["_t"].alias("_t")
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), first).select("_y", "_t")  # 2 * per_class labels at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append((y, present([t])[1], []))
                out += [(-1, more, less) for more, less in sorted(swapped(t.lower()))]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["y", "idx", "less"])

    return rows.mapInArrow(run, "y int, idx array<int>, less array<int>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, text: str = "text", doc_id: str = "doc_id", steady: float = 10.0, epochs: int = 4) -> dict:
    """Weights of a classifier: {"bias", "at", "w"}.

    One text for each of at most 2 * per_class labels outside the held-out quarter
    is read; each class counts as often as it stands among all such labels. Null
    labels don't count, repeated ones of a doc_id once, as toxic if they differ.
    What a text sends is bounded by its distinct features and changes. steady is the
    weight of the penalty on score changes when a group's name is swapped.
    Without labels of both classes the score is the share of toxic labels
    (one half if there are none).
    """
    usable = table(usable_labels(labels))
    counts = dict(usable.groupBy("_y").count().collect())
    t = training_rows(docs, usable, per_class, text, doc_id).toArrow()
    y = t["y"].to_numpy()
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    bias = float(np.log(share / (1 - share)))
    if not ((y == 1).any() and (y == 0).any()):
        return {"bias": bias, "at": np.zeros(0, np.int64), "w": np.zeros(0)}
    lists = [t[c].combine_chunks() for c in ("idx", "less")]
    idx, less = (np.asarray(x.flatten()) for x in lists)
    ptr, ptr_less = (np.asarray(x.offsets) for x in lists)
    weight = np.array([counts.get(0, 0) / max(1, (y == 0).sum()), counts.get(1, 0) / max(1, (y == 1).sum())])
    weight /= weight.max()
    model, rng, order = Ftrl(1 << BITS, 1, alpha=0.2, beta=1.0, l1=0.6, l2=0.2), np.random.default_rng(7), np.flatnonzero(y >= 0)
    swaps, shift, seen = np.flatnonzero(y < 0), bias, 1.0
    for _ in range(epochs):
        rng.shuffle(order)
        rng.shuffle(swaps)
        steps = -(-len(order) // 32)
        for k in range(steps):
            rows = order[32 * k : 32 * k + 32]
            owner, f = take(rows, ptr, idx)
            at, inv = np.unique(f, return_inverse=True)
            w = model.weights(at)[:, 0]
            p = 1 / (1 + np.exp(-np.clip(shift + np.bincount(owner, w[inv], len(rows)), -30, 30)))
            g = (p - y[rows]) * weight[y[rows]]
            model.update(at, np.bincount(inv, g[owner], len(at))[:, None])
            seen += (g * g).sum()
            shift -= 0.2 * g.sum() / np.sqrt(seen)
            pair = swaps[k::steps]
            if len(pair):
                o1, f1 = take(pair, ptr, idx)
                o2, f2 = take(pair, ptr_less, less)
                owner, f, sign = np.r_[o1, o2], np.r_[f1, f2], np.r_[np.ones(len(f1)), -np.ones(len(f2))]
                at, inv = np.unique(f, return_inverse=True)
                change = np.bincount(owner, sign * model.weights(at)[inv, 0], len(pair))
                model.update(at, np.bincount(inv, steady * change[owner] * sign, len(at))[:, None])
    every = np.arange(1 << BITS)
    w = model.weights(every)[:, 0]
    at = np.flatnonzero(w)
    return {"bias": float(shift), "at": at, "w": w[at]}


def score(docs: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column from 0 to 1, from the whole text alone; null and empty texts get the score of no feature."""
    name = next(n for n in (f"_text{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[model["at"]] = model["w"]
        for batch in batches:
            texts = batch.column(name).to_pylist()
            z = np.full(len(texts), model["bias"])
            for at, part in groups(texts):
                owner, f = present(part, w != 0)
                z[at : at + len(part)] += np.bincount(owner, w[f], len(part))
            out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            cols = [batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != name]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out)], [*(n for n in batch.schema.names if n != name), column])

    schema = docs.drop(column).schema.add(column, "double")
    return docs.drop(column).withColumn(name, text_or_empty(F.col(text))).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Labels, lang, source and doc_id are no inputs of a score. Rows with a null
    doc_id are scored too and not held out; repeated rows get the same score,
    texts of any length count whole, and an empty table gives an empty result.
    Null labels don't count, repeated ones once. Other columns take no part.
    """
    model = fit(docs, labels, text=text, doc_id=doc_id, **how)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    scored = score(rows.withColumn("held_out", held_out(F.col("doc_id"))), model, text="_t")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
