"""Vector codes: product quantisation by k-means on integers, with Exponion search.

Components become the integers floor(4096 * x), so every distance, sum and mean below is
exact and the same however the rows are spread. A vector is cut into equal parts; each
position has a codebook. In a round every part looks for its nearest entry, starting at
the entry of the round before: at the squared distance u from it, by the triangle
inequality no entry whose squared distance from that start is above 4u can be nearer or
as near. So only the start's neighbour entries inside this radius, a beginning of a list
sorted by distance, are compared; ties go to the lower index.

A round is one pass over the stored vectors: tasks write the new codes and, beside them,
their sums by part and entry, of a size that doesn't depend on rows. Spark adds the sums,
and only the codebooks, parts x entries x components, reach the driver. Each round's
table is in the shared folder; a lost task is done again from the table before.

Defined cases: rows whose vector is null or holds null or non-finite components go. The
codebooks start as the smallest ids (null ids last, equal ids by vector); with fewer rows
than entries there are as many entries as rows. Vectors that are shorter than the longest
one, or whose length the parts don't divide, count as continued by zeros. Components too
large for 64 bits are computed with as many digits as it takes; an error above the
largest long is given as that. Repeated ids keep a row each. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripforge.llm.common import Scratch, delete, fresh_dir, lookup, table, tune

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums travel as limbs of so many bits, whose totals over all tasks fit a long.
LIMB, MOST = 30, (1 << 63) - 1


class Search:
    """The nearest entries of one codebook: entries x components, integers."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None] - book[None]) ** 2).sum(2)
        own = np.arange(len(book))
        order = [sorted((j for j in own if j != i), key=lambda j: (apart[i, j], j)) for i in own]
        self.near = np.array(order, np.int64).reshape(len(book), len(book) - 1)
        self.reach = [apart[i, self.near[i]] for i in own]
        self.compared = 0

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the nearest entry, the lowest of equals, and its squared distance."""
        at = start.copy()
        found = ((x - self.book[start]) ** 2).sum(1)
        within = np.zeros(len(x), np.int64)
        for i in range(len(self.book)):
            of = np.flatnonzero(start == i)
            within[of] = np.searchsorted(self.reach[i], 4 * found[of], "right")
        self.compared += len(x) + int(within.sum())
        for t in range(int(within.max(initial=0))):
            of = np.flatnonzero(within > t)
            j = self.near[start[of], t]
            d = ((x[of] - self.book[j]) ** 2).sum(1)
            better = ((d < found[of]) | ((d == found[of]) & (j < at[of]))).astype(bool)
            at[of[better]], found[of[better]] = j[better], d[better]
        return at, found


def _whole(x: float) -> int:
    """floor(SCALE * x), exactly; from 2**52 on doubles are integers."""
    return math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE


def _matrix(col: pa.Array, width: int, exact: bool) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)
    return np.array([[_whole(v) for v in r] for r in x.tolist()], object).reshape(len(col), width) if exact else x.astype(np.int64)


def _limbs(v, n: int) -> list[int]:
    v = int(v)
    return [*((v >> LIMB * i) & ((1 << LIMB) - 1) for i in range(n - 1)), v >> LIMB * (n - 1)]


def _assign(books: list[np.ndarray], limbs: int, exact: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, w = len(books), len(books[0]), books[0].shape[1]
        search = [Search(b) for b in books]
        total, used = np.zeros((parts, k, w), object if exact else np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch["_q"], parts * w, exact)
            before = np.frombuffer(b"".join(batch["_code"].to_pylist()), np.uint8).reshape(n, parts)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, object if exact else np.int64)
            for p in range(parts):
                own = x[:, p * w : (p + 1) * w]
                at, d = search[p].nearest(own, before[:, p].astype(np.int64))
                code[:, p], error = at, error + d
                np.add.at(total[p], at, own)
                used[p] += np.bincount(at, minlength=k)
            new = {"_code": pa.array([r.tobytes() for r in code], pa.binary()), "_error": pa.array([min(int(e), MOST) for e in error], pa.int64()), "_sums": pa.array([False] * n)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch[f.name] if f.name in batch.schema.names else pa.nulls(n, f.type) for f in schema], schema=schema)
        rows = [(p, e) for p in range(parts) for e in range(k) if used[p, e]]
        if rows:
            new = {
                "_part": [p for p, _ in rows], "_entry": [e for _, e in rows], "_used": [int(used[r]) for r in rows],
                "_total": [[_limbs(v, limbs) for v in total[r]] for r in rows], "_sums": [True] * len(rows),
            }
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    return run


def quantised(rows: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS) -> tuple[DataFrame | None, int, int]:
    """The kept rows as _id, _label, _q (continued by zeros), the length of a part, and the
    bits of a component. _q has integers; where their distances need more than 64 bits, it
    has the doubles that they come from."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    kept = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("_v"))
    kept = kept.where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    seen = kept.agg(F.max(F.size("_v")).alias("n"), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x)))).alias("m")).first()
    if seen.n is None:
        return None, 0, 0
    width, most = -(-seen.n // parts), _whole(seen.m or 0.0) + 1
    kind = "double" if large(most.bit_length(), width) else "int"
    q = F.col("_v") if kind == "double" else F.transform("_v", lambda x: F.floor(x * SCALE).cast("int"))
    q = F.concat(q, F.array_repeat(F.lit(0).cast(kind), F.lit(parts * width) - F.size("_v")))
    return kept.select("_id", "_label", q.alias("_q")), width, most.bit_length()


def large(bits: int, width: int) -> bool:
    """Whether four times a squared distance may need more than 63 bits."""
    return 4 * (2 << bits) ** 2 * max(1, width) > MOST


def encode(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The coded rows (_id, _label, _code as bytes, _error) and the codebooks, one array
    of entries x components for each part; None and no codebooks where no row is kept."""
    spark = rows.sparkSession
    tune(spark)
    keep = Scratch(spark, "veccode")
    now, width, bits = quantised(rows, id_col, vec_col, label_col, parts)
    if now is None:
        return None, []
    exact, limbs = large(bits, width), -(-(bits + 40) // LIMB)  # for sums of 2**39 components in a task
    now = keep.write(now.withColumn("_code", F.lit(bytearray(parts)).cast("binary")), "quantised")
    first = now.orderBy(F.col("_id").asc_nulls_last(), "_q").limit(entries).collect()
    first = np.array([[_whole(v) if exact else v for v in r["_q"]] for r in first], object).reshape(len(first), parts * width)
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    schema = T.StructType([*now.schema, *(T.StructField(n, t) for n, t in (("_error", T.LongType()), ("_part", T.IntegerType()), ("_entry", T.IntegerType()), ("_used", T.LongType()), ("_total", T.ArrayType(T.ArrayType(T.LongType()))), ("_sums", T.BooleanType())))])
    out_schema, path = _arrow(schema), None
    for r in range(rounds + 1):
        assign = _assign(books if exact else [b.astype(np.int64) for b in books], limbs, exact, out_schema)
        then, path = path, fresh_dir(spark, f"veccode-{r}")
        now.mapInArrow(assign, schema).write.partitionBy("_sums").option("compression", "zstd").parquet(path)
        if then:
            delete(spark, then)
        now = spark.read.schema(T.StructType(list(schema)[:-1])).parquet(f"{path}/_sums=false")
        if r == 0:
            keep.drop("quantised")
        if r < rounds:
            sums = spark.read.schema(T.StructType(list(schema)[:-1])).parquet(f"{path}/_sums=true").select("_part", "_entry", "_used", F.posexplode("_total").alias("_at", "_limbs"))
            sums = sums.groupBy("_part", "_entry", "_at").agg(F.sum("_used").alias("n"), *[F.sum(F.col("_limbs")[i]).alias(f"l{i}") for i in range(limbs)])
            for s in sums.collect():
                books[s["_part"]][s["_entry"], s["_at"]] = sum(s[f"l{i}"] << LIMB * i for i in range(limbs)) // s["n"]
            now = now.select("_id", "_label", "_q", "_code")
    return now.select("_id", "_label", "_code", "_error"), books


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def codes(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: id, code, error, label_error, codebooks_sha256."""
    coded, books = encode(rows, id_col, vec_col, label_col)
    if coded is None:
        names = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return rows.where(F.lit(False)).select(F.col(id_col), *names)
    hexes = F.lower(F.hex("_code"))
    key = F.when(F.col("_label").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("_label").cast("string")))
    coded = coded.select("_id", key.alias("_key"), hexes.alias("code"), F.col("_error").alias("error"), F.xxhash64("_id", "_code", "_error").alias("_uid"))
    by = coded.groupBy("_key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    out = lookup(coded, by, "_key", ["label_error"], "_n")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13_veccode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    sql = [f"""WITH q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x)::BIGINT) AS v, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, i AS part, v[i * w + 1 : (i + 1) * w] AS x FROM q, range({parts}) t(i)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY n) - 1 AS entry, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) AS n FROM q QUALIFY n <= {entries}) USING (r))"""]
    for i in range(rounds + 1):
        sql.append(f"""d{i} AS (SELECT r, part, entry, p.x AS x, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{i} b USING (part)),
a{i} AS MATERIALIZED (SELECT r, part, min((d, entry)) AS m, any_value(x) AS x FROM d{i} GROUP BY ALL)""")
        if i < rounds:
            sql.append(f"""s{i} AS (SELECT part, m[2] AS entry, u.k AS k, sum(x[u.k]) AS s, count(*) AS n FROM a{i}, unnest(range(1, len(x) + 1)) u(k) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(f.x), any_value(b.x)) AS x FROM b{i} b LEFT JOIN
  (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS x FROM s{i} GROUP BY ALL) f USING (part, entry) GROUP BY part, entry)""")
    return ",\n".join(sql) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY r) JOIN q USING (r)"""


ORACLE = oracle()
