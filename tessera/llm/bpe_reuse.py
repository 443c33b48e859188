"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts every text where its content says so,
so documents that share a passage share chunks. A chunk that stands in more than
one place is encoded once, by the task that its hash falls to; all other chunks
are encoded where they are read. Chunks were encoded without their neighbours,
so every join is then repaired: the text around it, from the last safe place
before to the first safe place after, is encoded again, further out each time
until the ids on both sides agree with that text's bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import _byte_chars
from ._io import table, text_or_empty
from ._memo import Spaced

WINDOW = 32
GEAR = np.random.default_rng(5).integers(1 << 32, size=256, dtype=np.uint32)
#: A space or newline after a byte of a character that is surely no white space: no word of the tokenizer reaches across.
_SAFE = re.compile(rb"[!-~](?=[ \n])")


def cuts(data: bytes, average: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text: places where the hash of the last WINDOW bytes ends in zeros."""
    if len(data) <= least:
        return [len(data)]
    b = np.frombuffer(data, np.uint8)
    h, span = GEAR[b], 1
    while span < WINDOW:  # h[i] = sum over j of GEAR[b[i - j]] << j, doubled up
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    mask = np.uint32((average - 1) << (32 - average.bit_length() + 1))
    places = np.flatnonzero((h & mask) == 0) + 1
    ends, last = [], 0
    for p in [*places.tolist(), len(data)]:
        while p - last > most:
            last = _char_start(data, last + most)
            ends.append(last)
        if p - last >= least and p < len(data):
            p = _char_start(data, p)
            if last < p < len(data):
                ends.append(p)
                last = p
    if last < len(data):
        ends.append(len(data))
    return ends


def _char_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(data: bytes, average: int = 1024, least: int = 128, most: int = 8192) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data, average, least, most):
        out.append(data[start:end])
        start = end
    return out


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Joiner:
    """Puts encoded chunks together as the whole text would be encoded."""

    def __init__(self, path: str):
        self.memo = Spaced(path)
        to_byte = {c: b for b, c in enumerate(_byte_chars())}
        size = self.memo.tokenizer.get_vocab_size()
        special = self.memo.tokenizer.get_added_tokens_decoder()
        tokens = [self.memo.tokenizer.id_to_token(i) or "" for i in range(size)]
        each = [t.encode() if i in special else bytes(to_byte[c] for c in t) for i, t in enumerate(tokens)]
        self.size = np.array([len(t) for t in each])
        self.flat, self.start = np.frombuffer(b"".join(each), np.uint8), np.cumsum(self.size) - self.size

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.memo.encode(parts)]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[ids] - end + size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def _cut(self, ids: np.ndarray, from_end: bool, n: int) -> int:
        """How many ids stand before byte n, or after the last n bytes' start; -1 where an id crosses it."""
        size = np.cumsum(self.size[ids[::-1] if from_end else ids])
        k = int(np.searchsorted(size, n)) + 1 if n else 0
        if k and size[k - 1] != n:
            return -1
        return len(ids) - k if from_end else k

    def join(self, left: np.ndarray, before: bytes, right: np.ndarray, after: bytes) -> np.ndarray:
        """ids of before + after from those of both."""
        back = [m.end() for m in _SAFE.finditer(before, max(0, len(before) - 256))] or [m.end() for m in _SAFE.finditer(before)]
        ahead = _SAFE.finditer(after)
        for a in [*back[::-1], 0]:
            b = next((m.end() for m in ahead), len(after))
            i, j = self._cut(left, True, len(before) - a), self._cut(right, False, b)
            if i >= 0 and j >= 0:
                middle = np.frombuffer(self.memo.raw((before[a:] + after[:b]).decode()), "<u4")
                if self.size[middle].sum() == len(before) - a + b:
                    return np.concatenate([left[:i], middle, right[j:]])
        return np.frombuffer(self.memo.raw((before + after).decode()), "<u4")

    def whole(self, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """ids of a text from its chunks in order."""
        done: list[np.ndarray] = []
        text, ids = parts[0] if parts else (b"", np.zeros(0, "<u4"))
        for after, right in parts[1:]:
            ids, text = self.join(ids, text, right, after), text + after
            edge = [m.end() for m in _SAFE.finditer(text, max(0, len(text) - 512))]
            if len(edge) > 1:  # what stands before a safe place is final
                k = self._cut(ids, True, len(text) - edge[0])
                if k > 0:
                    done.append(ids[:k])
                    ids, text = ids[k:], text[edge[0] :]
        return np.concatenate([*done, ids])


def _shared_filter(names: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter with the names of chunks that stand in two places or more.

    It has 16 bits for each of them, 2 ** most_bits in all at most, and is
    summed up by Spark, one row for each 64 bits that are set. If more names
    fill it, more chunks take the way of shared ones; results stay the same.
    """
    twice = table(names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"))
    bits = min(most_bits, max(20, (16 * twice.count()).bit_length()))
    spot = lambda k: F.conv(F.hex(F.substring("name", k, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    at = twice.select(F.explode(F.array(spot(1), spot(5))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def _maybe(names: list[bytes], known: np.ndarray) -> np.ndarray:
    """Which names the filter may hold."""
    at = np.frombuffer(b"".join(n[:8] for n in names), ">u4").astype(np.uint64).reshape(-1, 2) & np.uint64(64 * len(known) - 1)
    return ((known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def _pack(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\0" + ids.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.frombuffer(raw[1:], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        count = Counter(name_of(c) for t in batch.column(1).to_pylist() for c in chunks(t))
        yield pa.RecordBatch.from_arrays([pa.array(count, pa.binary()), pa.array(count.values(), pa.int64())], ["name", "n"])


DONE = "doc_id long, ids binary, text string"
MOVED = "batch long, name binary, data binary, doc_id long, pieces array<struct<name: binary, ids: binary>>"
_PIECES = pa.list_(pa.struct([("name", pa.binary()), ("ids", pa.binary())]))
_MOVED = pa.schema([("batch", pa.int64()), ("name", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("pieces", _PIECES)])


def _result(ids: list, joiner: Joiner, doc_ids: list) -> pa.RecordBatch:
    cols = [pa.array(doc_ids, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([joiner.decode(x) for x in ids], pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"])


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list[bytes]]]:
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", filter_bits: int = 26) -> DataFrame:
    """One row for each row of docs: doc_id, ids (little-endian uint32 bytes), text (decoded from the ids).

    The ids are those of the tokenizers library without special tokens added,
    for any byte-level tokenizer of the file's kind. A null text is an empty
    one and has no ids. Repeated rows and null doc_ids come back as they are;
    texts of any length are cut into chunks of at most 8 KiB, an empty table
    gives an empty result, and other columns take no part. Each shared chunk's
    text goes to one task once for each task that read it; what all its holders
    get back is its ids.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).cast("binary").alias("t"))
    known = _shared_filter(rows.mapInArrow(_counted, "name binary, n long"), filter_bits)

    def looked_up(texts: list[bytes]) -> list[tuple[list[bytes], list[bytes], list[bool]]]:
        cut = [chunks(t) for t in texts]
        names = [[name_of(c) for c in c1] for c1 in cut]
        hits = iter(_maybe([n for x in names for n in x], known).tolist())
        return [(c, n, [next(hits) for _ in c]) for c, n in zip(cut, names, strict=True)]

    def in_place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without shared chunks."""
        joiner = Joiner(tokenizer)
        for doc_ids, texts in _slices(parts):
            own = [k for k, (_, _, hit) in enumerate(looked_up(texts)) if not any(hit)]
            yield _result(joiner.encode([texts[k] for k in own]), joiner, [doc_ids[k] for k in own])

    def apart(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other documents: their shared chunks, once for each batch, and their own runs encoded."""
        joiner, number = Joiner(tokenizer), TaskContext.get().partitionId() << 32
        for doc_ids, texts in _slices(parts):
            out, shared, runs, owners = [], {}, [], []
            for k, (cut, names, hit) in enumerate(looked_up(texts)):
                if not any(hit):
                    continue
                pieces: list[list] = []
                for c, n, h in zip(cut, names, hit, strict=True):
                    if h:
                        shared[n] = c
                        pieces.append([n, None])
                    elif pieces and pieces[-1][0] is None:
                        runs[pieces[-1][1]] += c
                    else:
                        pieces.append([None, len(runs)])
                        runs.append(c)
                owners.append((k, pieces))
            ids = [_pack(x) for x in joiner.encode(runs)]
            out += [{"batch": number, "name": n, "data": c} for n, c in shared.items()]
            out += [{"batch": number, "doc_id": doc_ids[k], "pieces": [{"name": n, "ids": None if n else ids[at]} for n, at in p]} for k, p in owners]
            number += 1
            yield pa.RecordBatch.from_pylist(out, _MOVED)

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks' texts become ids."""
        joiner = Joiner(tokenizer)
        for batch in parts:
            ids = [_pack(x) for x in joiner.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["name", "data"])

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a batch, then its documents."""
        joiner, current, ids = Joiner(tokenizer), None, {}
        for batch in parts:
            doc_ids, out = [], []
            for number, name, data, doc, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    current, ids = number, {}
                if pieces is None:
                    ids[name] = data
                    continue
                found = [_unpack(p["ids"] if p["name"] is None else ids[p["name"]]) for p in pieces]
                out.append(joiner.whole([(joiner.bytes_of(x), x) for x in found]))
                doc_ids.append(doc)
            yield _result(out, joiner, doc_ids)

    moved = table(rows.mapInArrow(apart, MOVED))
    asked = moved.where("name IS NOT NULL")
    once = asked.groupBy("name").agg(F.first("data").alias("data")).mapInArrow(shared, "name binary, data binary")
    none = F.lit(None)
    sent = asked.select("batch", "name").join(once, "name").select("batch", "name", "data", none.cast("long").alias("doc_id"), none.cast(moved.schema["pieces"].dataType).alias("pieces"))
    moved = sent.unionByName(moved.where("name IS NULL"))
    moved = moved.repartition("batch").sortWithinPartitions("batch", F.col("pieces").isNotNull()).mapInArrow(together, DONE)
    return rows.mapInArrow(in_place, DONE).unionByName(moved)
