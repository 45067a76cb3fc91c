"""Exact dedup: a tree merge of sorted digest runs.

Each partition sorts the digests of its texts into a run, in which equal digests are
merged. The runs then move through a K-ary form of the binomial exchange: in round r
every lane (a partition, numbered in base K) sends each digest to the lane whose r-th
digit is the digest's own r-th digit, and merges what it receives. After log_K(lanes)
rounds every digest is in just one run.

What a lane receives are sorted pieces, one from each sender. They are merged by the
partition's own sort, a natural merge sort (several keys, so rows are compared): it takes
ascending pieces as they come and merges them pairwise, and it merges what it had to
spill. Equal digests then follow each other; one is kept, with the smallest identifier and
the number of texts. Digests only merge when length and a second, independent hash of the
text agree as well. A text that a third of all rows share costs each lane one entry after
its first run, in each round.

Nulls: a null text counts as empty; a null doc_id comes after all others. Of rows with
equal id and text, the first in file order stays. Empty tables give empty results.
Columns of any name may be present; the operator reads the two that it is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import WHITE, Scratch, free_name, lookup, numbered, table, tune

FAN_IN = 8
ORDER = ["_digest", "_len", "_check", "_no_id", "_id", "_uid"]


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges neighbours that agree in digest, length and check of a sorted stream. The
    first of each group has the smallest id; the counts add up."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = (pa.concat_tables([held, now]) if held is not None else now).combine_chunks()
        new = np.ones(now.num_rows, bool)
        new[1:] = False
        for k in ORDER[:3]:
            v = now[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        counts = np.add.reduceat(now["_n"].to_numpy(), first)
        now = now.take(pa.array(first))
        now = now.set_column(now.schema.get_field_index("_n"), now.schema.field("_n"), pa.array(counts, pa.int64()))
        held = now.slice(now.num_rows - 1)
        if now.num_rows > 1:
            yield from now.slice(0, now.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def digests(docs: DataFrame, id_col: str, text_col: str, uid: str | None = None) -> DataFrame:
    """A compact row per document, without its text. uid: its number, if it has one."""
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    text = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(text_col).alias("_t"), number.alias("_uid"))
    return text.select("_id", "_uid", F.sha2("_t", 256).alias("_digest"), F.length("_t").cast("long").alias("_len"), F.xxhash64("_t").alias("_check"))


def tree_merge(rows: DataFrame, lanes: int, fan_in: int = FAN_IN) -> DataFrame:
    """rows of `digests` -> _digest, _len, _check, _id, _uid (of the row that stays), _n."""
    rounds, width = 1, fan_in
    while width < lanes:
        rounds, width = rounds + 1, width * fan_in
    own = F.pmod(F.col("_check"), F.lit(width)).cast("int")
    run = rows.select(F.pmod(F.spark_partition_id(), F.lit(width)).alias("_lane"), "_digest", "_len", "_check", F.col("_id").isNull().alias("_no_id"), "_id", "_uid", F.lit(1).cast("long").alias("_n"))
    schema = run.schema
    run = run.sortWithinPartitions(*ORDER).mapInArrow(merge_runs, schema)
    for r in range(rounds):
        at = fan_in**r
        digit = lambda lane: F.pmod(F.floor(lane / at).cast("int"), F.lit(fan_in))
        lane = F.col("_lane") + (digit(own) - digit(F.col("_lane"))) * at
        run = run.withColumn("_lane", lane.cast("int"))
        run = run.repartitionById(width, "_lane").sortWithinPartitions(*ORDER).mapInArrow(merge_runs, schema)
    return run.drop("_lane", "_no_id")


def _merged(keep: Scratch, rows: DataFrame) -> DataFrame:
    lanes = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keep.write(tree_merge(rows, lanes), "merged")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    tune(docs.sparkSession)
    keep = Scratch(docs.sparkSession, "exact-dedup")
    rows = keep.write(digests(docs, id_col, text_col), "rows")
    key = F.concat_ws("-", "_digest", "_len", "_check")
    merged = _merged(keep, rows).select(key.alias("_key"), F.col("_id").alias("keep_id"), F.col("_uid").alias("_keep_uid"), F.col("_n").alias("group_size"))
    out = lookup(rows.withColumn("_key", key), merged, "_key", ["keep_id", "_keep_uid", "group_size"], "group_size")
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_uid") == F.col("_keep_uid")).alias("kept"), F.col("_digest").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay."""
    tune(docs.sparkSession)
    keep, uid = Scratch(docs.sparkSession, "exact-dedup"), free_name(docs, "_exact_uid")
    docs = numbered(keep, docs, uid)
    merged = _merged(keep, keep.write(digests(docs, id_col, text_col, uid), "rows"))
    return docs.join(merged.select(F.col("_uid").alias(uid)), uid, "left_semi").drop(uid)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM n"""
