"""Suffix-array dedup: repeated byte strings of `length` bytes, removed wherever they occur.

A suffix array would order all suffixes; only their first `length` bytes matter here, so
the suffixes go through a radix sort from the most significant digit that stops at that
depth. A digit is not a fixed number of bytes but a piece of content that all equal
windows share, so that one row stands for many suffixes:

  pass 1  the anchor of a window: its leftmost least k-gram (by hash). Suffixes that
          follow each other mostly have the same anchor, so a row stands for a run of
          them. Anchors that occur once leave the sort: their windows are unique.
  pass 2  the whole context of the run. Equal contexts are equal runs of windows, so a
          group of copies goes on as one representative.
  pass 3  the bytes that all windows of a block of BLOCK neighbouring suffixes share.
  pass 4  the windows themselves, of blocks that pass 3 leaves. Groups of two or more
          are exactly the repeated windows.

Passes 1 and 3 only say which windows can't have an equal, by 64-bit hashes: equal bytes
have equal hashes, so nothing is lost there. What counts as equal, contexts and windows,
is decided by 128-bit BLAKE2b digests of all their bytes. Each pass drops groups of one.
The keys of groups that go on are stored, so that the semi joins with them have plain
rows on both sides and adaptive execution splits a hot key's rows over tasks.

Texts are UTF-8 bytes; matches never cross documents; overlapping occurrences count, in
the same document too; strings are judged on the input. Nulls and empty texts have no
bytes and keep the hash of nothing. Rows are told apart by a stored number, so ids may be
null or repeated. Longer texts cost memory in proportion (about 60 bytes a byte of a single
text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, numbered, table, tune
from tripforge.llm.textvec import _BASE, _INVERSE, U, mix, pieces, powers

LENGTH = 400
ANCHOR = 200
BLOCK = 16
ANCHORS = "_uid long, anchor long, c1 long, c2 long, a int, b int, m int"
BLOCKS = "core long, _uid long, sole boolean, lo int, hi int"
WINDOWS = "_uid long, sole boolean, s int, w1 long, w2 long"


class Hashes:
    """Hashes of any substrings of a buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        self.sum = np.zeros(len(data) + 1, U)
        np.multiply(data.astype(U) + U(1), powers(_BASE, len(data)), out=self.sum[1:])
        np.add.accumulate(self.sum, out=self.sum)
        self.scale = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        out = (self.sum[stop] - self.sum[start]) * self.scale[start]
        out += np.asarray(salt).astype(U) * U(0x9FB21C651E98DF25)
        return mix(out)


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits for the bytes of each range, as two columns of numbers."""
    raw, of = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    out = b"".join([of(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), stop.tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(U).max, U)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(offs: np.ndarray, data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that have the same anchor: row, a, b (first and last start),
    m (the anchor's start), all within the buffer, and the hashes."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, None
    hashes = Hashes(data)
    at = np.arange(len(data) - k + 1)
    grams = hashes.of(at, at + k)
    least = sliding_min((grams >> U(32)) << U(32) | at.astype(U), length - k + 1)
    m = (least & U(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(m) + 1, np.int64)
    size = np.diff(offs)
    long = size >= length
    np.add.at(whole, offs[:-1][long], 1)
    np.add.at(whole, offs[:-1][long] + size[long] - length + 1, -1)
    s = np.flatnonzero(np.add.accumulate(whole)[:-1])
    if not len(s):
        return empty, empty, empty, empty, None
    new = np.r_[True, (m[s[1:]] != m[s[:-1]]) | (s[1:] != s[:-1] + 1)]
    row = np.searchsorted(offs, s, "right") - 1
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    return row[first], s[first], s[last], m[s[first]], hashes


def anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            row, a, b, m, hashes = runs(offs, data, length, k)
            if not len(row):
                continue
            uid, base = batch.column("_uid").to_numpy()[row], offs[row]
            anchor, context = hashes.of(m, m + k), digests(data, a, b + length)
            out = [uid, anchor.view(np.int64), context[:, 0], context[:, 1], *((x - base).astype(np.int32) for x in (a, b, m))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["_uid", "anchor", "c1", "c2", "a", "b", "m"])

    return run


def listed(batch: pa.RecordBatch, offs: np.ndarray, name: str, *fields: str) -> tuple[np.ndarray, ...]:
    """The row and the fields of all entries of a column of lists of structs."""
    lists = batch.column(name)
    per, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), per)
    return row, offs[row], *(flat.field(x).to_numpy(zero_copy_only=False) for x in fields)


def block_rows(length: int, size: int):
    """The blocks of the runs that each document still has in the sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text", 1 << 19):
            row, base, anchor, a, b, m, sole = listed(batch, offs, "runs", "anchor", "a", "b", "m", "sole")
            a, b, m = a + base, b + base, m + base
            q0, q1 = (m - b) // size, (m - a) // size
            each = q1 - q0 + 1
            r = np.repeat(np.arange(len(a)), each)
            q = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) + q0[r]
            lo, hi = np.maximum(a[r], m[r] - size * q - size + 1), np.minimum(b[r], m[r] - size * q)
            core = Hashes(data).of(m[r] - size * q, m[r] - size * q - size + 1 + length, q + 7)
            core = (core ^ mix(anchor[r].view(U))).view(np.int64)
            uid = batch.column("_uid").to_numpy()
            out = [core, uid[row[r]], sole[r], (lo - base[r]).astype(np.int32), (hi - base[r]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["core", "_uid", "sole", "lo", "hi"])

    return run


def window_rows(length: int):
    """The windows of the blocks that each document still has in the sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text", 1 << 19):
            row, base, sole, lo, hi = listed(batch, offs, "blocks", "sole", "lo", "hi")
            count = (hi - lo + 1).astype(np.int64)
            s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            at, uid = s + np.repeat(base, count), batch.column("_uid").to_numpy()
            key = digests(data, at, at + length)
            out = [np.repeat(uid[row], count), np.repeat(sole, count), s.astype(np.int32), key[:, 0], key[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["_uid", "sole", "s", "w1", "w2"])

    return run


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs: a stored table of _uid, text -> _uid, spans: byte ranges (start << 32 | end) of
    repeated strings, unordered and overlapping, for documents with any."""
    keep = Scratch(docs.sparkSession, "repeats")
    several = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    span = lambda lo, hi: (F.shiftleft(lo.cast("long"), 32) + hi.cast("long")).alias("span")
    texts = docs.select("_uid", "text")

    first = keep.write(texts.mapInArrow(anchor_rows(length, anchor), ANCHORS), "anchors")
    left = keep.write(first.join(keep.write(several(first, "anchor"), "again"), "anchor", "left_semi"), "left")
    keep.drop("anchors")
    context = ["anchor", "c1", "c2"]
    contexts = keep.write(left.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_uid", "a", "b", "m")).alias("x")), "contexts")
    copies = left.join(contexts.where("n > 1").select(*context), context, "left_semi")
    copies = copies.select("_uid", span(F.col("a"), F.col("b") + length))

    reps = contexts.join(keep.write(several(contexts, "anchor"), "open"), "anchor", "left_semi")
    reps = reps.select("x._uid", F.struct("anchor", "x.a", "x.b", "x.m", (F.col("n") == 1).alias("sole")).alias("r"))
    reps = reps.groupBy("_uid").agg(F.collect_list("r").alias("runs"))  # no more than a document has bytes
    blocks = keep.write(texts.join(reps, "_uid").mapInArrow(block_rows(length, max(1, min(BLOCK, length // 2))), BLOCKS), "blocks")
    live = blocks.join(keep.write(several(blocks, "core"), "cores"), "core", "left_semi")
    live = live.groupBy("_uid").agg(F.collect_list(F.struct("sole", "lo", "hi")).alias("blocks"))
    windows = keep.write(texts.join(live, "_uid").mapInArrow(window_rows(length), WINDOWS), "windows")
    keep.drop("blocks")
    equal = keep.write(several(windows, "w1", "w2"), "equal")
    partly = windows.where("sole").join(equal, ["w1", "w2"], "left_semi").select("_uid", span(F.col("s"), F.col("s") + length))
    return copies.unionByName(partly).groupBy("_uid").agg(F.collect_list("span").alias("spans"))


def covered(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def cut_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text", 4 << 20):
            rows = []
            for i, found in enumerate(batch.column("spans")):
                own, removed, n = data[offs[i] : offs[i + 1]], 0, 0
                if found.is_valid and len(found.values):
                    start, end = covered(found.values.to_numpy())
                    removed, n = int((end - start).sum()), len(start)
                    lo, hi = np.r_[0, end], np.r_[start, len(own)]
                    own = np.concatenate([own[x:y] for x, y in zip(lo, hi)])
                kept = own.tobytes()
                rows.append((int(offs[i + 1] - offs[i]), removed, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), *cols], ["_uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: _uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept
    (the remaining bytes; a cut may fall within a character, hence binary)."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = numbered(Scratch(docs.sparkSession, "repeats"), texts)
    spans = repeated(texts, length, anchor or max(1, length // 2))
    schema = "_uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.join(spans, "_uid", "left").select("_uid", "doc_id", "text", "spans").mapInArrow(cut_rows(with_text), schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
