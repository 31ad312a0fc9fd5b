"""Prefix trie of conversations by truncation peeling.

A conversation is its list of turns; a node is a distinct list of first turns.
Every prefix has a chained digest, so equal prefixes have equal digests wherever
they occur. Peeling starts at the deepest nodes: a level's nodes are those that
came up from the level below and the conversations that end here; they are
grouped by digest, which finds the nodes and adds up their subtrees at once, and
go up with their last turn stripped.

What no other distinct conversation shares is a chain without branches; it is
peeled in one step, so the number of levels is the depth to which different
conversations agree, not the length of the longest one. Copies of a conversation
are one row from the start. Each level is a sum combined before its shuffle, so
a first turn that a third of all conversations share costs a row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.llm.tables import tidy
from treatlens.session import cut_lineage, scratch_path

#: The root's digest.
_ROOT = "X''"
#: Columns of a node; ``digest`` names it, ``parent`` the node one turn shorter.
NODE = ["digest", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of ``(key, size)`` in order, of rows (conv_id, turn, role, text).

    ``key`` is a digest of role and text, ``size`` the text's UTF-8 bytes; null
    roles and texts are empty. Rows are ordered by turn, nulls first, those of
    one turn by role, then key. Rows with a null ``conv_id`` belong to no
    conversation and are left out. Texts stay where they are: 50 bytes a turn
    are shuffled and a conversation's row holds no text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", role.alias("role"), _digest(named).alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    listed = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(listed.alias("turns"))


def _last(path: Column, depth: Column | None = None) -> Column:
    """The digest at ``depth`` (default: the end) of a path; the root's for depth 0."""
    at = F.lit(-1) if depth is None else F.nullif(depth.cast("int"), F.lit(0))
    return F.coalesce(F.try_element_at(path, at), F.expr(_ROOT))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)


def _paths(sequences: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (digests of its prefixes, shortest first) and ``sizes``."""
    path = F.aggregate(
        F.transform("turns", lambda t: t["key"]),
        F.array().cast("array<binary>"),
        lambda done, key: F.concat(done, F.array(_digest(F.concat(_last(done), key)))),
    )
    sizes = F.transform("turns", lambda t: t["size"])
    return sequences.select(F.col("conv_id").cast("long").alias("conv_id"), path.alias("path"), sizes.alias("sizes"))


def _ways(paths: DataFrame) -> DataFrame:
    """Distinct conversations: smallest id, copies, and ``shared``, the depth to which another one agrees."""
    ways = cut_lineage(
        paths.groupBy(_last(F.col("path")).alias("end")).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"),
        ),
        "ways",
    )
    steps = ways.select("end", F.posexplode("path").alias("at", "digest"))
    common = steps.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    shared = steps.join(common, "digest").groupBy("end").agg((F.max("at") + 1).cast("long").alias("shared"))
    return ways.join(shared, "end", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))


def _tails(ways: DataFrame) -> DataFrame:
    """Nodes that only copies of one conversation reach; ``known`` is the parent's id if the parent is one too."""
    length = F.size("path").cast("long")
    depth = F.explode(F.sequence(F.col("shared") + 1, length))
    rows = ways.filter(length > F.col("shared")).select("*", length.alias("length"), depth.alias("depth"))
    at = F.col("depth").cast("int")
    below = _total(F.slice("sizes", at, F.size("sizes")))
    return rows.select(
        _last(F.col("path"), at).alias("digest"), _last(F.col("path"), at - 1).alias("parent"), "conv_id", "depth",
        "n_convs", F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * below).alias("saved_tokens"),
        F.when(F.col("depth") > F.col("shared") + 1, F.col("conv_id")).alias("known"),
    )


_UP = ["digest", "path", "sizes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _entries(ways: DataFrame) -> DataFrame:
    """Conversations where peeling meets them: at their end, or where their unshared tail begins."""
    depth = F.col("shared").cast("int")
    tail = F.when(F.size("path") > depth, 1).otherwise(0).cast("long")
    beyond = _total(F.slice("sizes", depth + 1, F.size("sizes")))
    return ways.select(
        _last(F.col("path"), depth).alias("digest"), F.slice("path", 1, depth).alias("path"),
        F.slice("sizes", 1, depth).alias("sizes"), "conv_id", "n_convs", tail.alias("n_children"),
        tail.alias("n_leaves"), ((F.col("n_convs") - 1) * beyond).alias("saved_tokens"), depth.alias("depth"),
    )


def _level(rows: DataFrame) -> DataFrame:
    """Nodes of one depth from everything that meets there; adds each node's own share of its subtree."""
    met = rows.groupBy("digest").agg(
        F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in _UP[4:]],
    )
    own = (F.col("n_convs") - 1) * F.coalesce(F.try_element_at("sizes", F.lit(-1)), F.lit(0).cast("long"))
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    return met.withColumn("n_leaves", leaves).withColumn("saved_tokens", F.col("saved_tokens") + own)


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` as what they add to their parents."""
    return nodes.select(
        _last(F.col("path"), F.lit(depth - 1)).alias("digest"), F.slice("path", 1, depth - 1).alias("path"),
        F.slice("sizes", 1, depth - 1).alias("sizes"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )


def _peeled(ways: DataFrame) -> DataFrame:
    """All nodes above the tails, level by level from the deepest."""
    spark = ways.sparkSession
    met = scratch_path(spark, "entries")
    entries = _entries(ways)
    schema = entries.schema
    entries.write.partitionBy("depth").parquet(met)
    entries = spark.read.schema(schema).parquet(met)
    deepest = entries.agg(F.max("depth")).first()[0]
    done = scratch_path(spark, "levels")
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = entries.filter(F.col("depth") == depth).select(*_UP)
        rows = here if below is None else here.unionByName(_stripped(below, depth + 1))
        nodes = _level(rows).select(*_UP)
        nodes.write.parquet(f"{done}/depth={depth}")
        below = spark.read.schema(nodes.schema).parquet(f"{done}/depth={depth}")
    if below is None:
        return entries.select(*_UP, F.col("depth").cast("long").alias("depth"))
    return spark.read.schema(schema).parquet(done).select(*_UP, F.col("depth").cast("long").alias("depth"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end, conv_id) rows -> blocks of comma-joined ids, one per end and batch."""
    for batch in batches:
        ends, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *[i for i in range(1, len(ends)) if ends[i] != ends[i - 1]], len(ends)]
        rows = [(ends[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:]) if b > a]
        if rows:
            end, first, block = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(end, pa.binary()), pa.array(first, pa.int64()), pa.array(block, pa.string())],
                names=["end", "first", "block"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> one hash per end; blocks stream by, so no list of ids is held."""
    now, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for end, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if end != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = end, hashlib.sha256()
            else:
                state.update(b",")
            state.update(block.encode())
        if done:
            yield _hash_rows(done)
    if state is not None:
        yield _hash_rows([(now, state.hexdigest())])


def _hash_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    end, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(end, pa.binary()), pa.array(text, pa.string())], names=["digest", "ends_sha256"])


def end_hashes(paths: DataFrame) -> DataFrame:
    """``digest`` and ``ends_sha256`` of nodes where conversations end: SHA-256 of their ascending ids, comma-joined.

    Ids are put in order by ranges of (node, id), so copies of one conversation
    are spread over tasks, which join them to blocks; one task only hashes a
    node's blocks.
    """
    ends = paths.select(_last(F.col("path")).alias("end"), "conv_id")
    ordered = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    blocks = ordered.mapInArrow(tidy(_listed), "end binary, first long, block string")
    return (
        blocks.repartition("end").sortWithinPartitions("end", "first").mapInArrow(tidy(_hashed), "digest binary, ends_sha256 string")
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, turns of (key, size); one row per conversation).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the
    subtree), ``saved_tokens`` (over the subtree, copies of each node but one
    times the size of its last turn), ``ends_sha256`` (see ``end_hashes``; the
    empty string's hash where no conversation ends) and ``digest`` of the prefix.

    A conversation without turns is a member of the root. No conversations: no
    rows. Other columns are not read.
    """
    paths = cut_lineage(_paths(sequences), "paths")
    ways = cut_lineage(_ways(paths), "shared")
    levels = _peeled(ways)
    root = levels.filter("depth = 0").select("conv_id").first()
    parent = _last(F.col("path"), F.col("depth") - 1).alias("parent")
    known = F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long"))
    nodes = levels.select(*[parent if c == "parent" else F.col(c) for c in NODE], known.alias("known"))
    tails = _tails(ways).withColumn("known", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")).otherwise(F.col("known")))
    nodes = cut_lineage(nodes.unionByName(tails), "nodes")
    clear = "depth = 0 OR known IS NOT NULL"
    above = levels.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.filter(clear).withColumn("parent_conv_id", F.col("known")).unionByName(
        nodes.filter(f"NOT ({clear})").join(above, "parent", "left").select(*nodes.columns, "parent_conv_id")
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(end_hashes(paths), "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"), "digest",
    )
