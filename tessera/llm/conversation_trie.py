"""The prefix trie of conversations, by ternary search trees on range shards.

Conversations are cut into segments of SEGMENT turns; the trie under each prefix
of whole segments is one of many small ones. Distinct segments, sorted across
tasks, fall into range shards; each shard encodes its turns with a dictionary,
inserts its segments from the median outwards into ternary search trees and
walks them from the bottom up. Only the nodes along a shard's first and last
path can have members in other shards: their partial sums are merged by
aggregation. Totals of later segments come from the tries below in rounds that
double their reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import table, text_or_empty
from ._order import running
from ._tst import grow

SEGMENT = 64
#: Turns in one search tree at most, but for a single segment.
SHARD_TURNS = 200_000
IDS = 4096
NO_MEMBER = hashlib.sha256(b"").hexdigest()

_NODES = (
    "level long, trie string, depth long, edge boolean, key string, parent_key string, path array<string>, size long, least long, parent_least long,"
    "n long, children long, leaves long, saved long, ends string, open boolean, o_children long"
)


def turns_of(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, p, digest, bytes): turns by number from 1 on, named by 128 bits of a SHA-256 of role and text."""
    who, said = text_or_empty(F.col(role)), text_or_empty(F.col(text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)), 1, 16)
    rows = convs.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes")
    )
    return running(rows, ["conv_id"], ["turn", "digest"], p=F.lit(1)).drop("turn")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin with turns of the first one of their family: (conv_id, tag, p, digest, bytes).

    Conversation c takes the first h turns of c - c % family and then its own
    after its first h, h being crc32(c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.select("conv_id").distinct()
    heads = turns.where(F.col("p") < most).withColumnRenamed("conv_id", "_base")
    wanted = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("_base"), h.alias("_h"))
    taken = heads.join(wanted, "_base").where("p <= _h")
    own = turns.where(F.col("p") > h)
    return taken.select("conv_id", F.lit(0).alias("tag"), "p", "digest", "bytes").unionByName(own.select("conv_id", F.lit(1).alias("tag"), "p", "digest", "bytes"))


def _segments(rows: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """(conv_id, level, trie, seq, open, child): each conversation's segments; an ended one has fewer than segment turns.

    trie names the turns before the segment and child those up to its end:
    sums of 30-bit parts of hashes of the segments and their places.
    """
    last = convs.select("conv_id", F.lit(2).alias("tag"), F.lit(0).cast("long").alias("p"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    at = running(rows.withColumn("p", F.col("p").cast("long")).unionByName(last), ["conv_id"], ["tag", "p"], q=F.lit(1))
    level = F.floor((F.col("q") - 1) / segment).cast("long")
    cut = at.groupBy("conv_id", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("q", "digest", "bytes"))).alias("_l"))
    seq = F.transform(F.filter("_l", lambda x: x["digest"].isNotNull()), lambda x: F.struct(x["digest"].alias("d"), x["bytes"].alias("b")))
    cut = table(cut.select("conv_id", "level", seq.alias("seq")).withColumn("open", F.size("seq") == segment))
    short, long = cut.where("level = 0 AND NOT open"), cut.where("level > 0 OR open")
    hashed = F.sha2(F.concat(F.col("level").cast("string").cast("binary"), F.array_join(F.transform("seq", lambda x: F.hex(x["d"])), ".").cast("binary")), 256)
    parts = {f"_f{i}": F.conv(F.substring("_s", 8 * i + 1, 7), 16, 10).cast("long") for i in range(4)}
    long = running(long.withColumn("_s", hashed).withColumns(parts), ["conv_id"], ["level"], **{f"_g{i}": F.col(f"_f{i}") for i in range(4)})
    before = F.concat_ws("-", "level", *[F.col(f"_g{i}") - F.col(f"_f{i}") for i in range(4)])
    upto = F.concat_ws("-", F.col("level") + 1, *[F.col(f"_g{i}") for i in range(4)])
    none = F.lit(None).cast("string")
    return short.select("conv_id", "level", F.lit("").alias("trie"), "seq", "open", none.alias("child")).unionByName(
        long.select("conv_id", "level", F.when(F.col("level") > 0, before).otherwise("").alias("trie"), "seq", "open", F.when(F.col("open"), upto).alias("child"))
    )


def ids_sha256(members: DataFrame) -> DataFrame:
    """(key, ends) of members (key, conv_id): SHA-256 of each key's ids in order, joined by commas.

    Ids are joined in pieces of IDS across tasks; one task then hashes the
    pieces of a key as a stream, as SHA-256 asks for.
    """
    at = running(members, ["key"], ["conv_id"], i=F.lit(1)).withColumn("piece", F.floor((F.col("i") - 1) / IDS))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = at.groupBy("key", "piece").agg(joined.alias("ids")).repartition("key").sortWithinPartitions("key", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        sums.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends"])

    return pieces.select("key", "ids").mapInArrow(run, "key string, ends string")


def _distinct(segments: DataFrame) -> DataFrame:
    """Each distinct segment once: level, trie, seq, open, child, n, least, ends (null where open)."""
    name = F.sha2(F.concat_ws("|", "trie", F.array_join(F.transform("seq", lambda x: F.hex(x["d"])), ".")).cast("binary"), 256)
    named = segments.withColumn("key", name)
    each = table(named.groupBy("key").agg(*[F.first(c).alias(c) for c in ("level", "trie", "seq", "open", "child")], F.count("*").alias("n"), F.min("conv_id").alias("least")))
    many = each.where("n > 1 AND NOT open").select("key")
    ends = ids_sha256(table(named.where("NOT open").select("key", "conv_id").join(many, "key")))
    one = each.where("n = 1 OR open").withColumn("ends", F.when(~F.col("open"), F.sha2(F.col("least").cast("string").cast("binary"), 256)))
    return table(one.unionByName(each.where("n > 1 AND NOT open").join(ends, "key")).drop("key"))


def _grown(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted rows (level, trie, seq, n, least, ends, open, o_children, o_leaves, o_saved), shard by shard."""
    schema = pa.schema(
        [("level", pa.int64()), ("trie", pa.string()), ("depth", pa.int64()), ("edge", pa.bool_()), ("key", pa.string()), ("parent_key", pa.string()), ("path", pa.list_(pa.string()))]
        + [(c, pa.int64()) for c in ("size", "least", "parent_least", "n", "children", "leaves", "saved")]
        + [("ends", pa.string()), ("open", pa.bool_()), ("o_children", pa.int64())]
    )

    def out(shard: list) -> pa.RecordBatch:
        nodes = []
        for i, ((level, trie), paths, rows) in enumerate(shard):
            nodes += [(level, trie, *x) for x in grow(trie, paths, rows, i == 0, i == len(shard) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes, strict=True), schema, strict=True)], schema=schema)

    shard: list = []
    held = 0
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        bounds, flat = col["seq"].offsets.to_pylist(), col["seq"].values
        names, sizes = flat.field("d").to_pylist(), flat.field("b").to_pylist()
        rows = zip(*[col[c].to_pylist() for c in ("n", "least", "ends", "open", "o_children", "o_leaves", "o_saved")], strict=True)
        for i, (level, trie, row) in enumerate(zip(col["level"].to_pylist(), col["trie"].to_pylist(), rows, strict=True)):
            a, b = bounds[i], bounds[i + 1]
            if held and held + b - a > shard_turns:
                yield out(shard)
                shard, held = [], 0
            if not shard or shard[-1][0] != (level, trie):
                shard.append(((level, trie), [], []))
            shard[-1][1].append(list(zip(names[a:b], sizes[a:b], strict=True)))
            shard[-1][2].append(row)
            held += b - a + 1
    if shard:
        yield out(shard)


def _tries(rows: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all tries, merged across shards: level, trie, depth, size, conv_id, parent_conv_id, n, children, leaves, saved, ends."""
    rows = table(rows).select("level", "trie", "seq", "n", "least", "ends", "open", "o_children", "o_leaves", "o_saved")
    order = ["level", "trie", "seq"]
    nodes = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _grown(batches, shard_turns), _NODES))
    same = ("level", "trie", "depth", "parent_key", "path", "size")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "o_children")]
    edges = nodes.where("edge").groupBy("key").agg(*[F.first(c).alias(c) for c in same], *sums, F.min("least").alias("least"), F.max("ends").alias("ends"), F.max("open").alias("open"))
    edges = table(edges)
    under = edges.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_under"))
    edges = edges.join(under, "key", "left").withColumn("children", F.col("children") + F.coalesce("_under", F.lit(0)))
    leaf = (F.col("children") == 0) & ~F.col("open")
    edges = edges.withColumns({"leaves": F.when(leaf, 1).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n") - 1) * F.col("size")})
    total = edges.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    edges = table(edges.drop("leaves", "saved", "_under").join(total, "key"))
    above = edges.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id"))
    inner = nodes.where("NOT edge")
    columns = ["level", "trie", "depth", "size", F.col("least").alias("conv_id"), "parent_conv_id", "n", (F.col("children") + F.col("o_children")).alias("children"), "leaves", "saved", "ends"]
    return (
        inner.where("parent_key IS NULL").withColumn("parent_conv_id", F.col("parent_least")).select(*columns)
        .unionByName(inner.where("parent_key IS NOT NULL").join(above, "parent_key").select(*columns))
        .unionByName(edges.join(above, "parent_key", "left").select(*columns))
    )


def _totals(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (trie, children, leaves, saved, ends) with leaves and saved summed over all tries below.

    links: (trie, child). Each round sums over tries up to twice as many levels below.
    """
    up = links.where(F.col("trie") != "").select(F.col("child").alias("_c"), F.col("trie").alias("up")).distinct()
    now = table(roots.join(up, F.col("trie") == F.col("_c"), "left").drop("_c"))
    while not now.where("up IS NOT NULL").isEmpty():
        linked = now.where("up IS NOT NULL")
        more = linked.groupBy(F.col("up").alias("trie")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        further = linked.join(now.select(F.col("trie").alias("up"), F.col("up").alias("_up")), "up").select("trie", "_up")
        now = now.join(more, "trie", "left").join(further, "trie", "left")
        now = table(
            now.select("trie", "children", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), "ends", F.col("_up").alias("up"))
        )
    return now.drop("up")


def prefix_trie(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: (conv_id, tag, p, digest, bytes), ordered by (tag, p) in each
    conversation; convs: (conv_id), all members once, with or without rows.
    A node is named by its smallest member and its depth; n_leaves counts the
    childless nodes in its subtree, saved_tokens sums (n_convs - 1) * bytes over
    it, and ends_sha256 hashes the members that end there. Conversations of any
    length are cut, and members of one sequence counted before they meet. An
    empty table has no nodes.
    """
    segments = table(_segments(rows, convs, segment))
    each = _distinct(segments)
    zero = [F.lit(0).cast("long").alias(c) for c in ("o_children", "o_leaves", "o_saved")]
    closed = each.where("NOT open").select("*", *zero)
    if each.where("open").isEmpty():
        every = _tries(closed, shard_turns)
    else:
        later = table(_tries(each.where("level > 0").select("*", *zero), shard_turns).where("depth = 0").select("trie", "children", "leaves", "saved", "ends"))
        known = _totals(later, each.where("open").select("trie", "child"))
        known = known.select(F.col("trie").alias("child"), F.col("children").alias("o_children"), F.col("leaves").alias("o_leaves"), F.col("saved").alias("o_saved"), F.col("ends").alias("_e"))
        opened = each.where("open").join(known, "child").withColumn("ends", F.col("_e")).drop("_e")
        every = _tries(closed.unionByName(opened.select(*closed.columns)), shard_turns)
    return every.where("level = 0 OR depth > 0").select(
        "conv_id",
        (F.col("level") * segment + F.col("depth")).alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_MEMBER)).alias("ends_sha256"),
    )


def conversation_trie(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of a table of turns, as prefix_trie returns it.

    Turns come in order of turn, null first; those of one number in order of the
    digest of role and text. A null role or text counts as empty, rows without a
    conv_id take no part, repeated rows are turns of their own, and other
    columns take no part.
    """
    turns = table(turns_of(convs, conv_id, turn, role, text))
    return prefix_trie(turns.withColumn("tag", F.lit(1)), turns.select("conv_id").distinct())


def rebuilt_trie(convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS, **names: str) -> DataFrame:
    """The same of the conversations that rebuilt() makes."""
    turns = table(turns_of(convs, **names))
    return prefix_trie(rebuilt(turns), turns.select("conv_id").distinct(), segment, shard_turns)
