"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to).
The driver solves a min-cost flow from patterns to sources, by blocking flows: a pattern
can supply its words once for nothing, a second and a third time at rising (convex) cost;
a source takes up to its quota. Only one row per distinct pattern reaches the driver, whatever
the number of documents; their number is checked against PATTERNS first, and beyond it
mixing fails with a message instead of overrunning the driver. Tables of patterns are
broadcast, so no shuffle is by pattern and a hot source isn't a hot key. Then documents are selected: all of a pattern's documents as
often as its flow holds the whole pattern, and for the rest documents in the order of a
seeded hash of id and text. A document that doesn't fit into what is missing to the quota
is passed over, and the order goes on until no document fits that isn't chosen. What is
missing then is filled the same way by one more use of chosen documents, up to `most`, and
at last a document that doesn't fit is taken once more if that comes nearer. Where documents stop to fit is found by a
histogram over BINS hash ranges; the ranges from there on, WALK rows of a pattern or one
range at a time, are walked through in a task, so no task sees a whole source.

Targets share the total by weights; none exceeds `most` times its source's size, and what
is above goes to the others by weight until none is above.

Nulls: a null text has no words, a null source (or a null among several) is a source of
its own, after all others; documents of no source are not taken. Documents without words
take 0. Rows with equal id and text are interchangeable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tripforge.llm.common import Scratch, free_name, numbered, table, tune

MOST = 3
BINS = 4096
#: Distinct membership patterns that the driver takes: a flow's work grows with them.
PATTERNS = 1 << 16
#: Rows of a pattern that one task walks through, a single range of hashes aside.
WALK = 1 << 16
SEED = 20240
TOKEN = r"[^\x20\x09-\x0D]+"
#: Extra cost per word of the first, second and third use of a document.
REPETITION = (0, 1, 3)


def targets(sizes: dict, weights: dict, total: float, most: float = MOST) -> dict:
    """Shares of the total by weight, none above `most` times its size."""
    out, open_, rest = {}, set(sizes), float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ -= above
    return out


def cycled_weights(sources: list) -> dict:
    """1, 2, 3, 1, ... over the sources by code point, null last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


class Flow:
    """A network whose flow is raised to the maximum by blocking flows (Dinic), from what
    it carries already."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        """Its number; the next one is its reverse."""
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, begin: int, end: int) -> list[int]:
        level, queue = [-1] * len(self.arcs), [begin]
        level[begin] = 0
        while queue and level[end] < 0:
            later = []
            for a in queue:
                for k in self.arcs[a]:
                    b = self.to[k]
                    if self.room[k] and level[b] < 0:
                        level[b] = level[a] + 1
                        later.append(b)
            queue = later
        return level

    def raise_to_most(self, begin: int, end: int) -> None:
        to, room, arcs = self.to, self.room, self.arcs
        while (level := self.levels(begin, end))[end] >= 0:
            tried, path, at = [0] * len(arcs), [], begin
            while True:
                if at == end:
                    amount = min(room[k] for k in path)
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    full = next(i for i, k in enumerate(path) if not room[k])
                    at = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[at] < len(arcs[at]):
                    k = arcs[at][tried[at]]
                    if room[k] and level[to[k]] == level[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(arcs[at]):
                    path.append(arcs[at][tried[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def min_cost_flow(supply: dict, quota: dict, repetition: tuple[int, ...] = REPETITION) -> dict:
    """supply: words of each pattern (a tuple of sources); quota: words wanted by each
    source -> {(pattern, source): words}. Costs stand on the supply's arcs alone and rise
    with each use, and an augmenting path never gives supply back; so the flow of least
    cost is the maximum with first uses, raised to the maximum with second ones, and so on."""
    patterns, sources = list(supply), list(quota)
    begin = len(patterns) + len(sources)
    net = Flow(begin + 2)
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    give = [net.arc(begin, i, 0) for i in range(len(patterns))]
    used = {(p, s): net.arc(i, number[s], 1 << 62) for i, p in enumerate(patterns) for s in p}
    for s in sources:
        net.arc(number[s], begin + 1, quota[s])
    for _ in sorted(repetition):
        for i, p in enumerate(patterns):
            net.room[give[i]] += supply[p]
        net.raise_to_most(begin, begin + 1)
    return {k: net.room[x ^ 1] for k, x in used.items()}


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, uid: str | None) -> DataFrame:
    """A compact row per document: its pattern (sorted distinct sources), words, hash, and
    a number, its own (uid) or a new one."""
    many = docs.schema[source_col].dataType.typeName() == "array"
    member = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(F.col(source_col).cast("string"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    out = docs.select(number.alias("_uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(member, F.array(F.lit(None).cast("string"))).alias("pattern"), text.alias("t"))
    h = F.xxhash64(F.lit(SEED), "doc_id", "t")
    return out.select("_uid", "doc_id", "pattern", F.regexp_count("t", F.lit(TOKEN)).cast("long").alias("size"), h.alias("h"), F.pmod(F.shiftright(h, 20), F.lit(BINS)).alias("bin"))


def plan(rows: DataFrame, most: int, weights: dict | None) -> tuple[dict, dict, dict]:
    """Sizes and targets by source; words to take by pattern."""
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} distinct sets of sources; group rare sources before mixing")
    supply = {tuple(r.pattern): r.n for r in found}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    weights = weights or cycled_weights(list(sizes))
    wanted = targets(sizes, weights, sum(supply.values()), most)
    flow = min_cost_flow(supply, {s: round(x) for s, x in wanted.items()}, REPETITION[:most] + tuple(REPETITION[-1] + 2 * i for i in range(1, most - len(REPETITION) + 1)))
    take: dict = {}
    for (p, _), n in flow.items():
        take[p] = take.get(p, 0) + n
    return sizes, wanted, {p: (supply[p], take.get(p, 0)) for p in supply}


KEY = ("bin", "h", "doc_id", "_uid")
ID = "struct<bin:long,h:long,doc_id:long,_uid:long>"
PART = f"struct<begin:long,lo:{ID},hi:{ID},most:long>"


def walked(t: pa.Table) -> pa.Table:
    """Rows of one pattern, with the words that are missing (gap) -> what is missing still,
    and stretches of the hash order in which all documents up to a size are taken. What is
    missing never grows, so a document that was passed over doesn't fit later."""
    order = pc.sort_indices(t, [(c, "ascending") for c in KEY], null_placement="at_start")
    t = t.take(order)
    size, gap, at, lo, out = t["size"].to_numpy(), t["gap"][0].as_py(), 0, None, []
    key = lambda i: {c: t[c][i].as_py() for c in KEY}
    while gap > 0:
        fit = at + np.flatnonzero(size[at:] <= gap)
        total = np.cumsum(size[fit])
        k = int(np.searchsorted(total, gap, "right"))
        if k:
            hi = key(int(fit[k - 1]))
            out.append({"begin": t["begin"][0].as_py(), "lo": lo, "hi": hi, "most": gap})
            gap, lo = gap - int(total[k - 1]), hi
        if k == len(fit):
            break
        at = int(fit[k]) + 1
    place = pa.struct([(c, pa.int64()) for c in KEY])
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("lo", place), ("hi", place), ("most", pa.int64())]))
    return pa.table({"pattern": t["pattern"].slice(0, 1), "gap": pa.array([gap], pa.int64()), "parts": pa.array([out], kind)})


def along(rows: DataFrame, gaps: dict) -> tuple[dict, dict, dict]:
    """Takes documents in hash order wherever they fit. gaps: words that are missing, by
    pattern. Gives, by pattern, spans of whole hash ranges and parts of others in which
    all documents up to a size are taken, and what is missing in the end."""
    spark = rows.sparkSession
    spans, parts = {p: [] for p in gaps}, {p: [] for p in gaps}
    gaps, done = dict(gaps), dict.fromkeys(gaps, -1)
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while done:
        state = spark.createDataFrame([(list(p), gaps[p], at) for p, at in done.items()], "pattern array<string>, gap long, done long")
        free = rows.join(F.broadcast(state), "pattern").where("bin > done and size <= gap and size > 0")
        bins = free.groupBy("pattern", "gap", "bin").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("rows", F.coalesce(F.sum("k").over(before), F.lit(0)))
        edge = bins.groupBy("pattern").agg(F.min(F.when(F.expr("before + n > gap"), F.struct("bin", "before", "rows"))).alias("edge"), F.sum("n").alias("n"))
        last = bins.join(F.broadcast(edge.where("edge is not null").drop("n")), "pattern").where("bin = edge.bin or (bin > edge.bin and rows + k - edge.rows <= " + str(WALK) + ")")
        last = last.groupBy("pattern").agg(F.max("bin").alias("last"))
        found = {tuple(r.pattern): r for r in edge.join(last, "pattern", "left").collect()}
        walk = []
        for p in list(done):
            r = found.get(p)
            spans[p].append((done[p], r.edge.bin if r and r.edge else BINS, gaps[p]))
            if r and r.edge:
                gaps[p] -= r.edge.before
                walk.append((list(p), gaps[p], r.edge.bin, r.last))
                done[p] = r.last
            else:
                gaps[p] -= r.n if r else 0
                del done[p]
        if walk:
            state = spark.createDataFrame(walk, "pattern array<string>, gap long, begin long, last long")
            near = rows.join(F.broadcast(state), "pattern").where("bin between begin and last and size <= gap and size > 0")
            near = near.select("pattern", "gap", "begin", "bin", "h", "doc_id", "_uid", "size")
            for r in near.groupBy("pattern").applyInArrow(walked, f"pattern array<string>, gap long, parts array<{PART}>").collect():
                p = tuple(r.pattern)
                gaps[p] = r.gap
                parts[p] += r.parts
            done = {p: at for p, at in done.items() if gaps[p] > 0 and at < BINS - 1}
    return spans, parts, gaps


def taken_along(rows: DataFrame, spans: dict, parts: dict) -> DataFrame:
    """rows, with `fits`: if `along` takes them."""
    schema = f"pattern array<string>, spans array<struct<lo:long,hi:long,most:long>>, parts array<{PART}>"
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(list(p), spans[p], parts[p]) for p in spans], schema)), "pattern", "left")
    in_span = F.exists("spans", lambda x: (F.col("bin") > x.lo) & (F.col("bin") < x.hi) & (F.col("size") <= x.most))
    key = F.struct(*KEY)
    in_part = F.exists("parts", lambda x: (F.col("bin") >= x.begin) & (x.lo.isNull() | (key > x.lo)) & (key <= x.hi) & (F.col("size") <= x.most))
    return rows.withColumn("fits", F.coalesce(in_span | in_part, F.lit(False))).drop("spans", "parts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, weights: dict | None = None, uid: str | None = None) -> DataFrame:
    """One row per document: _uid (the column uid of docs, if they are numbered), doc_id,
    pattern, size, source_size and target (of its first source), taken, repeats."""
    spark = docs.sparkSession
    tune(spark)
    keep = Scratch(spark, "mixing")
    rows = keep.write(sized(docs, id_col, text_col, source_col, uid), "sized")
    sizes, wanted, take = plan(rows, most, weights)
    schema = "pattern array<string>, source_size long, target double, base long, rest long"
    params = [(list(p), sizes.get(p[0]) if p else None, wanted.get(p[0]) if p else None, n // size if size else 0, n % size if size else 0) for p, (size, n) in take.items()]
    rows = rows.join(F.broadcast(spark.createDataFrame(params, schema)), "pattern")

    gaps, rows = {p: n % size for p, (size, n) in take.items() if size and n % size}, rows.withColumn("uses", F.col("base"))
    for level in range(most):  # fresh documents, then one more use of those, and so on
        open_ = (F.col("uses") == F.col("base") + level) & (F.col("uses") < most)
        spans, parts, gaps = along(rows.where(open_), gaps)
        fits = taken_along(rows, spans, parts).withColumn("uses", F.col("uses") + F.when(open_ & F.col("fits"), 1).otherwise(0))
        rows = keep.write(fits.drop("fits"), f"uses-{level}")
        if not (gaps := {p: g for p, g in gaps.items() if g > 0}):
            break
    fills: list[int] = []
    if gaps:  # one more, if that comes nearer
        gap = spark.createDataFrame([(list(p), g) for p, g in gaps.items()], "pattern array<string>, gap long")
        free = rows.where(F.col("uses") < most).join(F.broadcast(gap), "pattern").where("size > gap and size < 2 * gap")
        fills = [r.x._uid for r in free.groupBy("pattern").agg(F.min(F.struct("size", "uses", "h", "doc_id", "_uid")).alias("x")).collect()]
    repeats = F.col("uses") + F.when(F.col("_uid").isin(fills), 1).otherwise(0)
    return rows.select("_uid", "doc_id", "pattern", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def select(docs: DataFrame, **more) -> DataFrame:
    """The rows of docs, with all their columns, that the mix takes, and size, taken and
    repeats (in place of columns of these names)."""
    uid = free_name(docs, "_mix_uid")
    docs = numbered(Scratch(docs.sparkSession, "mixing"), docs, uid)
    chosen = mix(docs, uid=uid, **more).where("repeats > 0").select(F.col("_uid").alias(uid), "size", "taken", "repeats")
    return docs.drop("size", "taken", "repeats").join(chosen, uid).drop(uid)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
