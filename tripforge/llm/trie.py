"""Conversation prefix trie by polynomial rolling fingerprints.

A turn (role, text) is reduced to a SHA-256 digest. Conversations are sorted by ranges of
(conversation, position), so a long conversation spans several tasks; numpy scans give
each prefix the polynomial sum of its turns' hashes, and what earlier tasks hold of a
conversation is added as an offset. Prefixes with equal depth and fingerprint are a
candidate group; its representative is the smallest conversation. Every member's last
turn and the group of its prefix one turn shorter are held against the representative's.
Where all groups agree, each is one sequence of turns, by induction over depth. Members
that don't agree are a collision and become groups of their own; groups are then named by
their representatives, and this is repeated until none is split, so that a collision ends
also among the longer prefixes. (Python's loop runs once unless there are collisions.)

A node is known by its depth and its smallest conversation, so its ancestors are looked up
by (conversation, depth), keys that never repeat. Subtree sums are rolled up to the parents
in rounds that double the distance: a round adds to each node the sums of its descendants
exactly 2**k levels below. The number of rounds is the logarithm of the depth.

The ids that end in a node are hashed in ascending order: pieces of the sorted list are
made in ranges, and a node's pieces stream through one hash. That stream is sequential by
the definition of the digest, but no task holds a list.

Defined cases: null role or text is empty; turns of equal number are ordered by digest,
null numbers first; repeated rows are turns of their own. Rows without a conversation id
belong to no conversation and are left out. No conversations, no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripforge.llm.common import Scratch, lookup, table, tune

PRIME = (1 << 31) - 1
BASES = (1_082_527_141, 763_164_043)
GROUP, HEADS, PIECE = 5, 9, 1 << 18


def _ones(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.ones(batch.num_rows, np.int64)]


def _power(base: int, e: np.ndarray, prime: int) -> np.ndarray:
    out, b, e = np.ones(len(e), np.uint64), base % prime, e.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * np.uint64(b) % np.uint64(prime), out)
        b, e = b * b % prime, e >> np.uint64(1)
    return out


def _polynomial(prime: int) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
    def terms(batch: pa.RecordBatch) -> list[np.ndarray]:
        digests = np.frombuffer(b"".join(batch["dig"].to_pylist()), np.uint64).reshape(-1, 4)
        depth = batch["depth"].to_numpy()
        return [(digests[:, i] % np.uint64(prime) * _power(b, depth, prime) % np.uint64(prime)).astype(np.int64) for i, b in enumerate(BASES)]

    return terms


def running(keep: Scratch, rows: DataFrame, order: list[Column], terms: Callable, names: list[str], what: str) -> DataFrame:
    """Running sums of some terms over each conversation's rows in order, as columns, with
    the terms beside them (name_term). Sorted by ranges, so a conversation may span tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = T.StructType([*rows.schema, T.StructField("_part", T.IntegerType()), *(T.StructField(x, T.LongType()) for name in names for x in (name, f"{name}_term"))])
    to = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, cols = batch["conv"].to_numpy(), []
            new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            for i, v in enumerate(terms(batch)):
                total = np.cumsum(v)
                total -= np.where(start < 0, -held[i], (total - v)[start])
                held[i] = int(total[-1])
                cols += [pa.array(total), pa.array(v)]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part, np.int32)), *cols], schema=to)

    sums = [F.sum(f"{name}_term").alias(f"_{name}") for name in names]
    got = keep.write(rows.repartitionByRange(n, "conv", *order).sortWithinPartitions("conv", *order).mapInArrow(scan, out), what)
    # a conversation that an earlier task began comes first in its own: one for each task at most
    over = got.groupBy("_part").agg(F.min("conv").alias("conv"))
    parts = got.join(F.broadcast(over.select("conv").distinct()), "conv").groupBy("conv", "_part").agg(*sums)
    before = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep.write(parts.select("conv", "_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in names]), f"{what}-offsets")
    got = got.join(F.broadcast(offsets), ["conv", "_part"], "left")  # two rows for each task at most
    return got.withColumns({name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in names}).drop("_part", *[f"_{name}" for name in names])


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, dig (of role and text), size (UTF-8 bytes of the text)."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    dig = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    return rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), dig.alias("dig"), F.octet_length(t).cast("long").alias("size")).where("conv IS NOT NULL")


def rebuilt(keep: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `turns`: the rebuilt conversations' turns (conv, depth, dig, size), and a row
    for each conversation with the number of its rebuilt turns (conv, total)."""
    at = running(keep, rows, [F.col("turn").asc_nulls_first(), F.col("dig")], _ones, ["pos"], "ordered").select("conv", "pos", "dig", "size")
    head = F.crc32(F.col("conv").cast("string")) % HEADS
    own = keep.write(at.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"), head.alias("h")), "own")
    convs = own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = keep.write(convs.withColumn("from_base", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    mine = lookup(at.withColumn("_uid", F.xxhash64("conv", "pos")), convs, "conv", ["h", "from_base"], "n").where("pos > h")
    mine = mine.select("conv", (F.col("pos") - F.col("h") + F.col("from_base")).alias("depth"), "dig", "size")
    theirs = at.where(F.col("pos") < HEADS).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "from_base").where("from_base > 0"), "base").where("pos <= from_base")
    total = convs.select("conv", (F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    return mine.unionByName(theirs.select("conv", F.col("pos").alias("depth"), "dig", "size")), total


def labelled(keep: Scratch, turn_rows: DataFrame, prime: int = PRIME) -> DataFrame:
    """Each prefix of each conversation (conv, depth) with its node: label (the node's
    smallest conversation), members, size (of its last text)."""
    got = running(keep, turn_rows, [F.col("depth")], _polynomial(prime), ["f1", "f2"], "prefixes")
    pack = lambda a, b: F.pmod(a, F.lit(prime)) * (1 << 31) + F.pmod(b, F.lit(prime))
    f1, f2 = F.col("f1"), F.col("f2")
    now = got.select("conv", "depth", "dig", "size", pack(f1, f2).alias("k"), pack(f1 - F.col("f1_term"), f2 - F.col("f2_term")).alias("up"))
    whole, short, number = F.struct("depth", "k", "up", "dig"), F.struct("depth", "k"), 0
    while True:
        parts = keep.write(now.groupBy("depth", "k", "up", "dig").agg(F.min("conv").alias("label"), F.count(F.lit(1)).alias("members")), f"groups-{number}")
        split = not parts.groupBy("depth", "k").count().where("count > 1").isEmpty()
        key = whole if split else short
        found = lookup(now.select("conv", "depth", "dig", "size", key.alias("_key"), F.xxhash64("conv", "depth").alias("_uid")), parts.withColumn("_key", key), "_key", ["label", "members"], "members")
        found = keep.write(found.select("conv", "depth", "dig", "size", "label", "members"), f"labelled-{number}")
        if not split:
            return found
        number += 1
        above = found.select("conv", (F.col("depth") + 1).alias("depth"), F.col("label").alias("_up"))
        now = found.join(above, ["conv", "depth"], "left").select("conv", "depth", "dig", "size", F.col("label").alias("k"), F.coalesce("_up", F.lit(0)).alias("up"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order -> comma-joined pieces of their list."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        made = []
        for label, depth, conv in zip(*(batch[c].to_pylist() for c in ("label", "depth", "conv")), strict=True):
            if (label, depth) != node or size >= PIECE:
                if ids:
                    made.append((*node, first, ",".join(ids)))
                node, first, ids, size = (label, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["label", "depth", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, first, ",".join(ids)), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["label", "depth", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> the digest of each node's whole list."""
    node, sha, done = None, None, []
    for batch in batches:
        for label, depth, ids in zip(*(batch[c].to_pylist() for c in ("label", "depth", "ids")), strict=True):
            if (label, depth) != node:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (label, depth), hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["conv", "depth", "ends_sha256"])
            done = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, sha.hexdigest())], names=["conv", "depth", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """label, depth, conv -> conv (the label), depth, ends_sha256."""
    order, n = ["label", "depth"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.repartitionByRange(n, *order, "conv").sortWithinPartitions(*order, "conv").mapInArrow(_pieces, "label long, depth long, first long, ids string")
    return pieces.repartition(n, *order).sortWithinPartitions(*order, "first").mapInArrow(_hashes, "conv long, depth long, ends_sha256 string")


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", prime: int = PRIME) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations."""
    spark = rows.sparkSession
    tune(spark)
    keep = Scratch(spark, "trie")
    turn_rows, total = rebuilt(keep, turns(rows, conv, turn, role, text))
    every = total.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("n"), F.max("total").alias("deepest")).first()
    if every.root is None:
        return spark.createDataFrame([], SCHEMA)
    found = labelled(keep, turn_rows, prime)
    foreign = keep.write(found.where("conv <> label").select("conv", "depth", "label"), "foreign")

    def above(nodes: DataFrame, levels: int) -> DataFrame:
        """label, up: the ancestor of each node (conv, depth) so many levels higher."""
        there = nodes.withColumn("up", F.col("depth") - levels).join(foreign.withColumnRenamed("depth", "up"), ["conv", "up"], "left")
        return there.withColumn("label", F.coalesce("label", "conv"))

    own = above(found.where("conv = label").select("conv", "depth", "members", "size"), 1)
    own = keep.write(own.withColumn("parent", F.when(F.col("depth") == 1, F.lit(every.root)).otherwise(F.col("label"))).select("conv", "depth", "members", "size", "parent"), "nodes")
    children = own.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    nodes = own.join(children, ["conv", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = keep.write(nodes.withColumns({"leaves": (F.col("children") == 0).cast("long"), "saved": (F.col("members") - 1) * F.col("size")}), "counted")
    sums, step = nodes.select("conv", "depth", "leaves", "saved"), 1
    while step < every.deepest:
        up = above(sums.where(F.col("depth") > step), step).select(F.col("label").alias("conv"), F.col("up").alias("depth"), "leaves", "saved")
        sums = keep.write(sums.unionByName(up).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"sums-{step}")
        if step > 1:
            keep.drop(f"sums-{step // 2}")
        step *= 2
    of_all = nodes.agg(F.count_if(F.col("depth") == 1).alias("children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    root = spark.createDataFrame([(every.root, 0, None, every.n, of_all.children, of_all.leaves or 1, of_all.saved)], SCHEMA.rsplit(",", 1)[0].replace("conv_id", "conv", 1))
    tree = nodes.select("conv", "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children")).join(sums, ["conv", "depth"])
    tree = tree.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}).unionByName(root)
    last = total.where("total > 0").join(found.select("conv", F.col("depth").alias("total"), "label"), ["conv", "total"]).select("label", F.col("total").alias("depth"), "conv")
    last = last.unionByName(total.where("total = 0").select(F.lit(every.root).alias("label"), F.col("total").alias("depth"), "conv"))
    out = tree.join(ends(last), ["conv", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: DuckDB has no crc32: it is folded here over the bytes and bits of the decimal id.
ORACLE = f"""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {GROUP} AS base,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % {HEADS} AS h FROM o GROUP BY conv_id),
c AS (SELECT n.conv_id, n.n, n.base, h, least(h, coalesce(b.n, 0)) AS hb FROM n LEFT JOIN (SELECT conv_id AS base, n FROM n) b USING (base)),
r AS (SELECT conv_id, pos - h + hb AS depth, role, text FROM o JOIN c USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, role, text FROM o JOIN c ON o.conv_id = c.base WHERE pos <= hb),
k AS (SELECT conv_id, 0::BIGINT AS depth, '' AS key, 0::BIGINT AS size FROM c
  UNION ALL SELECT conv_id, r.depth, sha256(key || length(role) || ':' || role || text), strlen(text) FROM k JOIN r USING (conv_id) WHERE r.depth = k.depth + 1),
v AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM k GROUP BY depth, key),
p AS (SELECT v.*, u.key AS up, w.conv_id AS parent FROM v LEFT JOIN k u ON u.conv_id = v.conv_id AND u.depth = v.depth - 1 LEFT JOIN v w ON w.depth = u.depth AND w.key = u.key),
ch AS (SELECT depth - 1 AS depth, up AS key, count(*) AS children FROM p WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(children, 0) AS children FROM p LEFT JOIN ch USING (depth, key)),
s AS (SELECT k.depth, k.key, count_if(children = 0) AS leaves, sum((n - 1) * q.size) AS saved FROM q JOIN k ON k.conv_id = q.conv_id AND k.depth <= q.depth GROUP BY ALL),
e AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM k JOIN (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id) USING (conv_id, depth) GROUP BY ALL)
SELECT q.conv_id, q.depth, q.parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM q JOIN s USING (depth, key) LEFT JOIN e USING (depth, key)"""
