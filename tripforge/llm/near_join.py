"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed five-word shingles (a text of fewer words is one shingle).
Documents with equal sets are one class; one representative goes on. `bands` chooses the
numbers of bands and of rows per band: the most rows, within a budget of hash functions,
for which a pair at the threshold shares a band with the target recall. Band hashes are
shuffled. Every pair that shares a band, and no other, is verified on the full shingle
sets, without pair rows. Which sets meet in a task for that depends on what moves fewer of
them: components of buckets (each member linked to its bucket's least member) meet at
once, which is best for groups of copies, or, where buckets only chain documents together,
bucket by bucket. A pair that meets in several buckets belongs to its first common band.
Components or buckets of more than BLOCK sets are cut into blocks, and each pair of blocks
is a task of its own. What leaves a task is a link count per document and a spanning
forest of its links.

Link counts need all pairs of a bucket verified; that work is quadratic in the number of
different sets of a bucket (not in copies); the rows that are moved are that square
divided by BLOCK.

Result: one row per document with class_id, the smallest doc_id of its class (connected
by links), class_size and n_links, the number of other documents at or above the
threshold, copies included. Nulls: a null text has no words; documents without words are
classes of their own without links. A null doc_id comes after all others as class_id.
Repeated rows are copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, free_name, lookup, numbered, table, tune
from tripforge.llm.components import components
from tripforge.llm.textvec import U, Words, mix, pieces, run_hashes

N = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 256
BLOCK = 256
SIGNATURES = "_uid long, doc_id long, s1 long, s2 long, n int, bands array<long>"
FOUND = "u long, v long, links long"


def bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows per band): 1 - (1 - threshold**rows)**bands >= recall."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        need = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if need * rows <= hashes:
            best = need, rows
    if best is None:
        raise ValueError("too few hash functions for this recall")
    return best


def shingle_sets(words: Words, rows: int, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted."""
    at, h = words.shingles(n)
    row = words.doc[at]
    count = np.diff(words.first)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            row, h = np.r_[row, few], np.r_[h, run_hashes(words.hash, words.first[few], k)]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def signatures(n: int, n_bands: int, n_rows: int):
    k = n_bands * n_rows
    draw = np.random.default_rng(17)
    factor = draw.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = draw.integers(0, 1 << 32, k, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            rows, uid = batch.num_rows, batch.column("_uid").to_numpy()
            row, h = shingle_sets(Words(offs, data), rows, n)
            count = np.bincount(row, minlength=rows)
            full = np.flatnonzero(count)
            s1, s2 = uid.copy(), np.zeros(rows, np.int64)
            hashes = np.zeros((len(full), k), np.uint32)
            if len(full):
                first = (np.cumsum(count) - count)[full]
                s1[full] = np.add.reduceat(mix(h), first).view(np.int64)
                s2[full] = np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
                x = (h >> U(32)).astype(np.uint32)
                for i in range(k):
                    hashes[:, i] = np.minimum.reduceat(x * factor[i] + add[i], first)
            key = np.zeros((len(full), n_bands), U)
            for r in range(n_rows):
                key = mix(key * U(0xD6E8FEB86659FD93) + hashes[:, r::n_rows] + U(1))
            key = mix(key + np.arange(n_bands, dtype=U) * U(0x9E3779B97F4A7C15))
            size = np.zeros(rows, np.int64)
            size[full] = n_bands
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(uid), batch.column("doc_id"), pa.array(s1), pa.array(s2), pa.array(count.astype(np.int32)), lists], ["_uid", "doc_id", "s1", "s2", "n", "bands"])

    return run


def set_rows(n: int):
    """The shingle set of each row, beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            row, h = shingle_sets(Words(offs, data), batch.num_rows, n)
            count = np.bincount(row, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(h.view(np.int64)))
            names = ["_uid", "weight", "bands", "work"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, "set"])

    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    g = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.r_[True, value[1:] != value[:-1]]
    code = np.cumsum(new) - 1
    often = np.bincount(code)
    pick = often[code] > 1
    code, owner = (np.cumsum(often > 1) - 1)[code[pick]], owner[pick]
    out = np.zeros((g, g), np.float32)
    total, step = (int(code[-1]) + 1 if len(code) else 0), 4096
    for lo in range(0, total, step):
        i, j = np.searchsorted(code, (lo, lo + step))
        x = np.zeros((g, min(step, total - lo)), np.float32)
        x[owner[i:j], code[i:j] - lo] = 1
        out += x @ x.T
    return out


def links(uid: np.ndarray, weight: np.ndarray, block: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], at: int, across: bool, threshold: float) -> tuple[list, list]:
    """Link counts (uid, n) and a spanning forest (u, v) of pairs that share a band, with
    `at` (not -1) as their first common one. across: the task is of two different blocks
    (one may be empty), and only pairs across them count, as each has a task of its own."""
    size = np.array([len(s) for s in sets], np.float64)
    both = shared(sets).astype(np.float64)
    hit = np.triu(both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6, 1)
    if across:
        hit &= block[:, None] != block[None, :]
    a, b = np.nonzero(hit)
    same = bands[a] == bands[b]
    met = same.any(1) & ((at < 0) | (same.argmax(1) == at))
    a, b = a[met], b[met]
    counts = np.bincount(a, weights=weight[b], minlength=len(uid)) + np.bincount(b, weights=weight[a], minlength=len(uid))
    parent = list(range(len(uid)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    forest = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((int(uid[i]), int(uid[j])))
    return [(int(u), int(c)) for u, c in zip(uid, counts) if c], forest


KEY = ("at", "key", "i", "j")


def lists_of(col: pa.Array) -> list[np.ndarray]:
    return np.split(col.flatten().to_numpy(), col.offsets.to_numpy()[1:-1] - col.offsets[0].as_py())


def verified(threshold: float):
    """Sorted by KEY: all rows of a pair of blocks follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            uid, weight, block = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("_uid", "weight", "block"))
            sets, bands = ([s for p in parts for s in lists_of(p.column(c))] for c in ("set", "bands"))
            at, _, i, j = (parts[0].column(c)[0].as_py() for c in KEY)
            counts, forest = links(uid, weight, block, np.stack(bands), sets, at, i != j, threshold)
            out = [(u, None, c) for u, c in counts] + [(u, v, None) for u, v in forest]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ()))], ["u", "v", "links"])

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in KEY], 1)
            cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, len(k)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if held and tuple(k[lo]) != key:
                    yield solve(held)
                    held = []
                key = tuple(k[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(held)

    return run


def meetings(keep: Scratch, reps: DataFrame) -> DataFrame:
    """_uid, work: where a representative is verified: key (root of its component, at -1, or
    a band) and into how many blocks the members there are cut."""
    members = reps.select("rep", F.posexplode("bands").alias("at", "band"))
    hubs = keep.write(members.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1"), "hubs")
    meets = keep.write(members.join(hubs, "band"), "meets")
    groups = keep.write(components(meets.where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))), "candidates")
    cuts = lambda k: F.ceil(F.col(k) / BLOCK).cast("int")
    moved = hubs.join(groups, F.col("hub") == F.col("node")).groupBy("root").agg(F.sum(F.col("k") * cuts("k").cast("double")).alias("moved"))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")).join(moved, "root")
    sizes = keep.write(sizes.select("root", "size", (F.col("moved") < F.col("size") * cuts("size")).alias("apart")), "sizes")
    groups = lookup(groups.withColumnRenamed("node", "_uid"), sizes, "root", ["size", "apart"], "size")
    at_once = groups.where("not apart").select("_uid", F.struct(F.col("root").alias("key"), F.lit(-1).alias("at"), cuts("size").alias("cuts")).alias("w"))
    apart = keep.write(groups.where("apart").select("_uid"), "apart")
    apart = meets.join(apart, F.col("rep") == F.col("_uid"), "left_semi").select(F.col("rep").alias("_uid"), F.struct(F.col("band").alias("key"), "at", cuts("k").alias("cuts")).alias("w"))
    return at_once.unionByName(apart).groupBy("_uid").agg(F.collect_list("w").alias("work"))  # at most one for each band


def classes(texts: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """texts: a stored table of _uid, doc_id, text -> (rows: _uid, doc_id, _key; one row per
    distinct set: _key, copies, class_id, keep_uid, class_size, n_links)."""
    spark = texts.sparkSession
    tune(spark)
    keep = Scratch(spark, "near-join")
    signed = keep.write(texts.select("_uid", "doc_id", "text").mapInArrow(signatures(n, *bands(threshold, recall)), SIGNATURES), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_uid")
    reps = signed.groupBy("s1", "s2", "n").agg(F.min("_uid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"), F.first("bands").alias("bands"))
    reps = keep.write(reps, "representatives")

    work = meetings(keep, reps).join(reps.select(F.col("rep").alias("_uid"), F.col("copies").alias("weight"), "bands"), "_uid")
    sets = texts.select("_uid", "text").join(work, "_uid").select("_uid", "text", "weight", "bands", "work")
    sets = sets.mapInArrow(set_rows(n), "_uid long, weight long, bands array<long>, work array<struct<key:long,at:int,cuts:int>>, set array<long>")
    sets = sets.withColumn("w", F.explode("work")).select("_uid", "weight", "bands", "set", "w.*").withColumn("block", F.pmod(F.xxhash64("_uid"), "cuts").cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    sets = sets.withColumn("pair", other).select("_uid", "weight", "bands", "set", "block", "at", "key", "pair.i", "pair.j")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keep.write(sets.repartition(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(verified(threshold), FOUND), "links")

    roots = keep.write(components(found.where("v is not null").select("u", "v")), "classes").withColumnRenamed("node", "rep")
    near = found.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("others"))
    table_ = reps.drop("bands").join(roots, "rep", "left").join(near, "rep", "left")
    table_ = keep.write(table_.select(F.concat_ws("-", "s1", "s2", "n").alias("_key"), "rep", F.coalesce("root", "rep").alias("root"), "copies", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "sets")
    total = table_.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("k"))
    total = keep.write(total.select("root", F.col("least.doc_id").alias("class_id"), F.col("least._uid").alias("keep_uid"), "class_size", "k"), "totals")
    table_ = lookup(table_.drop("least").withColumn("_uid", F.col("rep")), total, "root", ["class_id", "keep_uid", "class_size"], "k")
    table_ = keep.write(table_.select("_key", "copies", "class_id", "keep_uid", "class_size", "n_links"), "result")
    return signed.select("_uid", "doc_id", F.concat_ws("-", "s1", "s2", "n").alias("_key")), table_


def _columns(id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links."""
    texts = numbered(Scratch(docs.sparkSession, "near-join"), docs.select(*_columns(id_col, text_col)))
    rows, found = classes(texts, **more)
    out = lookup(rows, found, "_key", ["class_id", "class_size", "n_links"], "copies")
    return out.select("doc_id", "class_id", "class_size", "n_links")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, with all their columns, of which one per class stays."""
    uid = free_name(docs, "_near_uid")
    docs = numbered(Scratch(docs.sparkSession, "near-join"), docs, uid)
    _, found = classes(docs.select(F.col(uid).alias("_uid"), *_columns(id_col, text_col)), **more)
    stay = found.select(F.col("keep_uid").alias(uid)).distinct()
    return docs.join(stay, uid, "left_semi").drop(uid)


def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
