"""Hierarchical packing of token sequences into windows of several lengths.

Each document is encoded where it is read and routed to the smallest context
size that holds it. Every task packs what it has read: a window of a tier opens
with that tier's longest document, its gap is filled from the same and shorter
tiers, first with whole documents that fit and at last with one that is cut.
What is left at the end is cut at powers of two, so no window is padded. Nothing
is shuffled; sequence and step numbers hold the partition's number above the
task's own count.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memo import Words
from ._io import text_or_empty

TIERS = (512, 1024, 2048, 4096)
END = (2).to_bytes(4, "little")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # length, document, start


class _Pools:
    """Unplaced pieces of each tier, sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.by = tiers, {t: [] for t in tiers}

    def put(self, piece: Piece) -> None:
        insort(self.by[next(t for t in self.tiers if piece[0] <= t)], piece)

    def take(self, most: int, gap: int) -> Piece | None:
        """The longest piece of a tier up to most that fits the gap, or else a part of one."""
        low = [t for t in reversed(self.tiers) if t <= most and self.by[t]]
        for t in low:
            if at := bisect_right(self.by[t], (gap, 1 << 62, 0)):
                return self.by[t].pop(at - 1)
        if not low:
            return None
        n, doc, start = self.by[low[-1]].pop()  # of the shortest tier, which is cheapest to cut
        self.put((n - gap, doc, start + gap))
        return gap, doc, start


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces (length, document, start); each has a tier's or a power of two's length."""
    top, done, pools = tiers[-1], [], _Pools(tiers)
    for doc, n in enumerate(lengths):
        done += [[(top, doc, s)] for s in range(0, n - top + 1, top)]
        if n % top:
            pools.put((n % top, doc, n - n % top))
    for t in reversed(tiers):
        while pools.by[t]:
            row = [pools.by[t].pop()]
            gap = t - row[0][0]
            while gap and (piece := pools.take(t, gap)):
                row.append(piece)
                gap -= piece[0]
            done += [row] if not gap else _powers(row)
    return done


def _powers(row: list[Piece]) -> list[list[Piece]]:
    """A window that can't be filled, cut at powers of two."""
    out, rest = [], row[::-1]
    left = sum(p[0] for p in row)
    while left:
        room, part = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            n, doc, start = rest.pop()
            use = min(n, room)
            part.append((use, doc, start))
            room -= use
            if use < n:
                rest.append((n - use, doc, start + use))
        out.append(part)
    return out


def balance(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence: about step_tokens in each group, long and short ones dealt to and fro."""
    groups = max(1, -(-sum(sizes) // step_tokens))
    out = [0] * len(sizes)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))):
        lap, at = divmod(k, groups)
        out[i] = at if lap % 2 == 0 else groups - 1 - at
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = 2_000_000,
    step_tokens: int = 65_536,
) -> DataFrame:
    """One row for each piece, with its ids (little-endian uint32) and place.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they stand in the table, a null doc_id is kept as null, and a text of any
    length is cut into full windows. A task holds buffer_tokens ids and one
    batch of texts at most. An empty table gives no pieces; other columns take
    no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = Words(tokenizer), TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = sequences = steps = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, sequences, steps
            rows = pack([len(x) // 4 for _, x in held], tiers)
            sizes = [sum(p[0] for p in r) for r in rows]
            groups = balance(sizes, step_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for k, row in enumerate(rows):
                offset = 0
                for n, doc, start in row:
                    name, ids = held[doc]
                    values = name, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + sequences + k, offset, sizes[k], base + steps + groups[k]
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                    offset += n
            sequences, steps, held, tokens = sequences + len(rows), steps + max(groups) + 1, [], 0
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    held.append((name, ids + END))
                    tokens += len(ids) // 4 + 1
                    if tokens >= buffer_tokens:
                        yield flush()
        if held:
            yield flush()

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).cast("binary").alias("t"))
    return read.mapInArrow(run, SCHEMA)
