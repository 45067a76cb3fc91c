"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each in a tree of contexts: the DEPTH bytes before it,
the last one first. Every node of a tree (context, bits so far) has a Krichevsky-
Trofimov estimate of its counts; context-tree weighting mixes the estimates of all
depths, with weights that follow from how well each depth has coded the training text.

Training gathers, over all training texts, the counts of strings of DEPTH + 1 bytes; all
node counts are sums of these. The weighted probabilities go up the tree by grouping on
contexts of 2, then 1 and 0 bytes, and the mixing weights come down again. Trees are
sparse: a context has nodes for the bytes it has seen. Each string of 2 to DEPTH context
bytes and a byte ends as one row with the probabilities of its eight bits, as they are
where no deeper context has seen as much. The rows, whose number grows with the corpus,
are broadcast in shards of about SHARD_BYTES, with one scoring pass each, so what is
broadcast has a bound; contexts with the same last two bytes share a shard.

A text is coded as its UTF-8 bytes and an end mark, 0xFF, after a start of DEPTH marks;
0xFF is in no UTF-8 text. So scores are probabilities over all texts.

The unigram baseline uses the exact counts of all training tokens. The HEAD most frequent
tokens are broadcast (a fixed number); other tokens, none of which has more than 1/HEAD
of all occurrences, are joined with their counts by shuffle.

Nulls: a null text is empty, a null id counts as empty text for the split. Rows are told
apart by position. Without training texts each bit has probability 1/2.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, numbered, remainder, table, tune
from tripforge.llm.textvec import Words, pieces

DEPTH = 5
MARK = 0xFF
SHARD_BYTES = 32 << 20
HEAD = 1 << 18
HELD = 1 << 20
END_TOKEN = -1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def marked(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every coded byte: context number (DEPTH bytes), byte; and where rows begin."""
    rows = len(offs) - 1
    size = np.diff(offs)
    begin = offs[:-1] + (DEPTH + 1) * np.arange(rows)
    out = np.full(len(data) + (DEPTH + 1) * rows, MARK, np.uint8)
    place = np.arange(len(data)) + np.repeat((DEPTH + 1) * np.arange(rows) + DEPTH, size)
    out[place] = data
    wide = out.astype(np.int64)
    context = np.zeros(len(out), np.int64)
    for d in range(1, DEPTH + 1):
        context[d:] |= wide[:-d] << (8 * (d - 1))
    coded = np.ones(len(out), bool)
    for d in range(DEPTH):
        coded[begin + d] = False
    return context[coded], out[coded], np.r_[0, np.cumsum(size + 1)]


def words_of(offs: np.ndarray, data: np.ndarray) -> Words:
    return Words(offs, data, LOWER, SEPARATOR)


class Counter:
    """Sums counts of integer keys, with at most about HELD distinct keys in memory."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys.astype(np.int64))
        self.counts.append(counts)
        self.size += len(keys)

    def merged(self) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, np.int64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])

    def flush(self, all_: bool) -> Iterator[pa.RecordBatch]:
        if self.size > 4 * HELD or all_:
            out = self.merged()
            if all_ or len(out) > HELD:
                self.keys, self.counts, self.size = [], [], 0
                for i in range(0, len(out), 1 << 16):
                    yield out.slice(i, 1 << 16)


def gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: strings of DEPTH + 1 bytes; kind 1: tokens (by hash), kind 2: ends."""
    grams, tokens, ends = Counter(0), Counter(1), 0
    for batch, offs, data in pieces(batches, "text"):
        context, byte, _ = marked(offs, data)
        grams.add(context << 8 | byte)
        tokens.add(words_of(offs, data).hash.view(np.int64))
        ends += batch.num_rows
        yield from grams.flush(False)
        yield from tokens.flush(False)
    yield from grams.flush(True)
    yield from tokens.flush(True)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([END_TOKEN], pa.int64()), pa.array([ends], pa.int64())], ["kind", "key", "n"])


def lgamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y = x + 8
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts [.., 256] of bytes -> of each node (1 to 255): log P_KT, P_KT(next bit 1)."""
    full = np.zeros((*counts.shape[:-1], 512))
    full[..., 256:] = counts
    for lo in (128, 64, 32, 16, 8, 4, 2, 1):
        full[..., lo : 2 * lo] = full[..., 2 * lo : 4 * lo : 2] + full[..., 2 * lo + 1 : 4 * lo : 2]
    zero, one = full[..., 0::2], full[..., 1::2]
    zero, one = zero.copy(), one.copy()
    zero[..., 0] = one[..., 0] = 0
    log_kt = lgamma(zero + 0.5) + lgamma(one + 0.5) - lgamma(zero + one + 1) - np.log(np.pi)
    return log_kt, (one + 0.5) / (zero + one + 1)


def mixed(log_kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against the product of its children."""
    return 1 / (1 + np.exp(np.clip(below - log_kt, -700, 700)))


class Level:
    """The strings of d context bytes and the byte after them, sorted, and the nodes on
    their way: each string passes eight nodes, and strings with the same beginning share
    theirs, so a context has nodes for what it has seen and for nothing else."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, d: int):
        cut = keys & ((1 << 8 * (d + 1)) - 1)
        order = np.argsort(cut, kind="stable")
        cut = cut[order]
        start = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        self.keys, self.n = cut[start], np.add.reduceat(n[order], start).astype(np.float64)
        self.node = np.empty((8, len(start)), np.int32)
        first, zero, one, at = [], [], [], 0
        for k in range(8):
            way, bit = self.keys >> (8 - k), self.keys >> (7 - k) & 1
            new = np.r_[True, way[1:] != way[:-1]]
            lo = np.flatnonzero(new)
            self.node[k] = at + np.cumsum(new) - 1
            total, ones = np.add.reduceat(self.n, lo), np.add.reduceat(self.n * bit, lo)
            first.append(lo), zero.append(total - ones), one.append(ones)
            at += len(lo)
        self.first, self.bits = np.concatenate(first), np.repeat(np.arange(8), [len(x) for x in first])
        zero, one = np.concatenate(zero), np.concatenate(one)
        self.log_kt = lgamma(zero + 0.5) + lgamma(one + 0.5) - lgamma(zero + one + 1) - np.log(np.pi)
        self.kt = (one + 0.5) / (zero + one + 1)
        self.weighted, self.own = self.log_kt, np.ones(at)

    def join(self, up: Level, d: int) -> None:
        """The nodes of the context that is a byte shorter."""
        row = np.searchsorted(up.keys, self.keys & ((1 << 8 * d) - 1))
        self.parent = up.node[self.bits, row[self.first]]

    def mix(self, below: np.ndarray) -> None:
        self.own = mixed(self.log_kt, below)
        self.weighted = np.log(0.5) + np.logaddexp(self.log_kt, below)

    def dense(self, values: np.ndarray) -> np.ndarray:
        """Of one context: values by node, 0 where nothing was seen."""
        out = np.zeros(256)
        out[1 << self.bits | (self.keys[self.first] & 0xFF) >> (8 - self.bits)] = values
        return out


class Subtree:
    """The contexts that end in the same two bytes, level by level from DEPTH up to 2."""

    def __init__(self, t: pa.Table):
        key, n = t["key"].to_numpy(), t["n"].to_numpy()
        self.levels: dict[int, Level] = {}
        for d in range(DEPTH, 1, -1):
            self.levels[d] = now = Level(key, n, d)
            if d < DEPTH:
                under = self.levels[d + 1]
                under.join(now, d + 1)
                now.mix(np.bincount(under.parent, weights=under.weighted, minlength=len(now.kt)))
            key, n = now.keys, now.n
        self.last2 = int(key[0] >> 8)

    def rows(self, top) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, strings, their eight bits as log-odds of the bit that is there), where
        no deeper context has seen the beginning of the byte."""
        said, left = top.above(self.last2 & 0xFF)
        for d in range(2, DEPTH + 1):
            x = self.levels[d]
            up = x.parent if d > 2 else 1 << x.bits | (x.keys[x.first] & 0xFF) >> (8 - x.bits)
            said, left = said[up] + left[up] * x.own * x.kt, left[up] * (1 - x.own)
            p = said + left / 2
            odds = (np.log(p) - np.log1p(-p))[x.node]
            bit = x.keys >> np.arange(7, -1, -1)[:, None] & 1
            yield d, x.keys, np.where(bit == 1, odds, -odds).astype(np.float32)


def upward(t: pa.Table) -> pa.Table:
    """A context of two bytes: its counts and log P_w."""
    x = Subtree(t)
    top, counts = x.levels[2], np.zeros(256)
    counts[top.keys & 0xFF] = top.n
    return pa.table({"c1": [x.last2 & 0xFF], "counts": [counts.tobytes()], "weighted": [top.dense(top.weighted).tobytes()]}, schema=pa.schema([("c1", pa.int64()), ("counts", pa.binary()), ("weighted", pa.binary())]))


def upward1(t: pa.Table) -> pa.Table:
    total = [sum(np.frombuffer(x.as_py()) for x in t[c]) for c in ("counts", "weighted")]
    return pa.table({"c1": t["c1"].slice(0, 1).combine_chunks(), "counts": pa.array([total[0].tobytes()], pa.binary()), "weighted": pa.array([total[1].tobytes()], pa.binary())})


class Top:
    """Contexts of one byte and of none: their estimates and weights."""

    def __init__(self, rows: list):
        counts, below = np.zeros((256, 256)), np.zeros((256, 256))
        for r in rows:
            counts[r.c1], below[r.c1] = np.frombuffer(r.counts), np.frombuffer(r.weighted)
        log1, self.p1 = tree(counts)
        self.w1 = mixed(log1, below)
        log0, self.p0 = tree(counts.sum(0))
        self.w0 = mixed(log0, (np.log(0.5) + np.logaddexp(log1, below))[counts.sum(1) > 0].sum(0))

    def above(self, c1) -> tuple[np.ndarray, np.ndarray]:
        """By node: what contexts of at most a byte say, and the weight left for longer ones."""
        said = self.w0 * self.p0 + (1 - self.w0) * self.w1[c1] * self.p1[c1]
        return said, (1 - self.w0) * (1 - self.w1[c1])

    def defaults(self) -> np.ndarray:
        """By last byte and node: P(next bit 1) where longer contexts have seen nothing."""
        said, left = self.above(np.arange(256))
        return said + left / 2


#: Strings with the log-odds of their bits, and log10 P of the whole byte.
BITS = [f"b{k}" for k in range(8)]
ROWS = "last2 int, depth int, key long, whole float, " + ", ".join(f"{b} float" for b in BITS)
ROW_BYTES = 44
#: Common leading bits of two bytes, by their difference (exclusive or); -1 for other contexts.
COMMON = np.array([8 - x.bit_length() for x in range(256)] + [-1], np.int8)


def log10_odds(z: np.ndarray) -> np.ndarray:
    """log10 of a probability given as log-odds."""
    return -np.logaddexp(0, -z.astype(np.float64)) / np.log(10)


def downward(top):
    def run(t: pa.Table) -> pa.Table:
        tree_, parts = Subtree(t), []
        for d, keys, odds in tree_.rows(top.value):
            whole = log10_odds(odds).sum(0).astype(np.float32)
            cols = [np.full(len(keys), tree_.last2, np.int32), np.full(len(keys), d, np.int32), keys, whole, *odds]
            parts.append(pa.table([pa.array(c) for c in cols], ["last2", "depth", "key", "whole", *BITS]))
        return pa.concat_tables(parts)

    return run


class Shard:
    """The strings of all contexts with some last two bytes, sorted by depth. A byte after
    a context takes each bit from the deepest context that has seen the bits before it;
    among sorted strings, that is a neighbour of the place where the byte would stand."""

    def __init__(self, levels: dict[int, tuple], mine: np.ndarray, defaults: np.ndarray):
        self.levels, self.mine, self.defaults = levels, mine, defaults

    def find(self, q: np.ndarray) -> np.ndarray:
        """log10 P of strings of DEPTH context bytes and a byte, sorted."""
        out, have, left = np.zeros(len(q)), np.zeros(len(q), np.int8), np.arange(len(q))
        for d in range(DEPTH, 1, -1):
            keys, whole, odds = self.levels[d]
            if not len(keys) or not len(left):
                continue
            k = q[left] & ((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            before = np.maximum(at - 1, 0)
            apart, apart_before = keys[at] ^ k, keys[before] ^ k
            at = np.where(apart_before < apart, before, at)
            same = COMMON[np.minimum(np.minimum(apart, apart_before), 256)]
            fresh = (same == 8) & (have[left] == 0)
            out[left[fresh]] = whole[at[fresh]]
            some = np.flatnonzero((same >= have[left]) & ~fresh)
            rows, common, z = left[some], same[some], odds[at[some]]
            for bit in range(8):
                # A bit that differs from the neighbour's has the other side's probability.
                now = np.flatnonzero((have[rows] <= bit) & (bit <= common))
                side = np.where(common[now] == bit, -z[now, bit], z[now, bit])
                out[rows[now]] += log10_odds(side)
            have[rows] = np.minimum(common + 1, 8)
            have[left[fresh]] = 8
            left = left[have[left] < 8]
        for bit in range(8):
            now = left[have[left] <= bit]
            byte = q[now] & 0xFF
            p = self.defaults[q[now] >> 8 & 0xFF, 1 << bit | byte >> (8 - bit)]
            out[now] += np.log10(np.where(byte >> (7 - bit) & 1 == 1, p, 1 - p))
        return out

    def score(self, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
        """By text: the sum over the bytes whose context belongs to this shard."""
        context, byte, first = marked(offs, data)
        mine = np.flatnonzero(self.mine[context & 0xFFFF])
        value = np.zeros(len(byte))
        strings, back = np.unique(context[mine] << 8 | byte[mine], return_inverse=True)
        value[mine] = self.find(strings)[back]
        return np.add.reduceat(value, first[:-1]) if len(first) > 1 else np.zeros(0)


def shards(spark: SparkSession, rows: DataFrame, top: Top, size: int = SHARD_BYTES) -> Iterator[tuple]:
    """rows: ROWS -> a broadcast for each shard, made one after the other. size: bytes of
    a shard in memory. The first shard also has the contexts that nobody has seen."""
    per = rows.groupBy("last2").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 65,536 rows
    last2, n = per["last2"].to_numpy(), per["n"].to_numpy()
    k = max(1, -(-int(n.sum()) * ROW_BYTES // size))
    # the largest first, each to the shard with the least so far
    filled, shard_of = np.zeros(k, np.int64), np.zeros(65536, np.int32)
    for i in np.lexsort((last2, -n)):
        shard_of[last2[i]] = least = int(np.argmin(filled))
        filled[least] += n[i]
    for s in range(k):
        chosen = last2[shard_of[last2] == s].tolist()
        levels = {}
        for d in range(2, DEPTH + 1):
            got = rows.where((F.col("depth") == d) & F.col("last2").isin(chosen)).select("key", "whole", *BITS).toArrow()
            key = got["key"].to_numpy()
            order, odds = np.argsort(key, kind="stable"), np.empty((len(key), 8), np.float32)
            for i, b in enumerate(BITS):
                odds[:, i] = got[b].to_numpy()[order]
            levels[d] = key[order], got["whole"].to_numpy()[order], odds
            del got, key
        yield s, spark.sparkContext.broadcast(Shard(levels, shard_of == s, top.defaults()))


SCORED = "_uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, head_known long, head_log double, score double, tail array<struct<h:long,k:int>>"


def scoring(shard, head):
    """Everything about a document but its rare tokens, which it lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, end_log = head.value
        for batch, offs, data in pieces(batches, "text"):
            rows = batch.num_rows
            words = words_of(offs, data)
            h = words.hash.view(np.int64)
            near = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[near] == h if len(keys) else np.zeros(len(h), bool)
            known = np.bincount(words.doc[hit], minlength=rows) + (end_log is not None)
            log = np.bincount(words.doc[hit], weights=logs[near[hit]], minlength=rows) + (end_log or 0.0)
            d, t = words.doc[~hit], h[~hit]
            order = np.lexsort((t, d))
            d, t = d[order], t[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.zeros(0, np.int64)
            k = np.diff(np.r_[first, len(d)]).astype(np.int32)
            per = np.r_[0, np.cumsum(np.bincount(d[first], minlength=rows))].astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(t[first]), pa.array(k)], ["h", "k"]))
            out = [*(batch.column(c) for c in ("_uid", "doc_id", "held_out")), pa.array(np.diff(offs)), pa.array(np.diff(words.first).astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(log), pa.array(shard.value.score(offs, data)), tail]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in SCORED.split(", ")])

    return run


def more_scoring(shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array(shard.value.score(offs, data))], ["_uid", "more"])

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, head_size: int = HEAD) -> DataFrame:
    """Learns from the rows that aren't held out and scores all. One row per document:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the code
    length in bits_per_byte (of the bytes and the end mark)."""
    spark = docs.sparkSession
    tune(spark)
    keep = Scratch(spark, "ctw")
    texts = numbered(keep, docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")))
    counts = texts.where(~F.col("held_out")).select("text").mapInArrow(gathering, "kind int, key long, n long")
    counts = keep.write(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"), "counts")

    grams = counts.where("kind = 0").select("key", "n")
    by_two = F.col("key").bitwiseAND(0xFFFF00)
    level2 = grams.groupBy(by_two.alias("_c2")).applyInArrow(upward, "c1 long, counts binary, weighted binary")
    top = Top(level2.groupBy("c1").applyInArrow(upward1, "c1 long, counts binary, weighted binary").collect())
    sent = spark.sparkContext.broadcast(top)
    rows = keep.write(grams.groupBy(by_two.alias("_c2")).applyInArrow(downward(sent), ROWS), "rows")

    tokens = counts.where("kind = 1").select(F.col("key").alias("h"), F.col("n").alias("c"))
    total = counts.where("kind > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).first()
    n_train = total.n or 0
    head = tokens.orderBy(F.desc("c"), "h").limit(head_size).toArrow()
    order = np.argsort(head["h"].to_numpy())
    head = spark.sparkContext.broadcast((head["h"].to_numpy()[order], np.log10(head["c"].to_numpy()[order] + 1.0), float(np.log10(total.ends + 1.0)) if total.ends else None))

    out, extra = None, []
    for k, shard in shards(spark, rows, top, shard_bytes):
        if k == 0:
            out = keep.write(texts.select("_uid", "doc_id", "held_out", "text").mapInArrow(scoring(shard, head), SCORED), "scored")
        else:
            part = texts.select("_uid", "text").mapInArrow(more_scoring(shard), "_uid long, more double")
            extra.append(keep.write(part, f"more{k}"))
        shard.destroy()  # its pass is written; one shard at a time is in memory
        del shard
    tail = out.select("_uid", F.explode("tail").alias("t")).select("_uid", "t.h", "t.k").join(tokens, "h")
    tail = tail.groupBy("_uid").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    out = out.drop("tail").join(tail, "_uid", "left")
    if extra:
        more = functools.reduce(DataFrame.unionByName, extra)
        out = out.join(more.groupBy("_uid").agg(F.sum("more").alias("more")), "_uid").withColumn("score", F.col("score") + F.col("more"))
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_train + total.v + 1.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        log.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)
