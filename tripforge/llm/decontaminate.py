"""Benchmark decontamination: a prefix-filtered set join.

Items are cut into windows of `window` consecutive words (an item of fewer words is one
window). A document contains a window only if it contains all of the window's shingles
of SHINGLE words. Shingles are ordered by rarity, that is by how often they occur in all
documents; for full containment the necessary prefix is the rarest shingle. Document
shingles join these prefix shingles; a candidate must fit between the document's first
and last word (length and positional bounds); then all its words are compared by hash
and at last byte by byte. Only exact occurrences remain.

The benchmark is taken in blocks of about BLOCK_BYTES of item text. Only one block's
index is broadcast at a time, so its size has a bound however large the benchmark is;
each block is one pass over the documents, and the hits of all blocks are merged.

Nulls: a null text has no words, and a null item_id is not listed (its windows still
count as hits). Repeated items and rows are each reported as they stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, free_name, numbered, table, tune
from tripforge.llm.textvec import U, Words, pieces, run_hashes, span_hashes, word_list

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
HITS = "_uid long, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


class Index:
    """The windows of one block of items, by their number."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.words: list[tuple[bytes, ...]] = []
        self.items: list[set[str]] = []
        known: dict[tuple[bytes, ...], int] = {}
        for item, text in items:
            words = tuple(word_list(text))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                w = words[i : i + window]
                if w not in known:
                    known[w] = len(self.words)
                    self.words.append(w)
                    self.items.append(set())
                if item is not None:
                    self.items[known[w]].add(item)
        vocabulary = sorted({x for w in self.words for x in w})
        number = {x: i for i, x in enumerate(vocabulary)}
        ends = np.cumsum([0, *map(len, vocabulary)])
        hashes = span_hashes(np.frombuffer(b"".join(vocabulary), np.uint8), ends[:-1], ends[1:])
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.matrix = np.zeros((len(self.words), window), U)
        for k, w in enumerate(self.words):
            self.matrix[k, : len(w)] = hashes[[number[x] for x in w]]
        # every shingle of every window: width -> (hash, window, offset)
        found: dict[int, list] = defaultdict(list)
        for k, w in enumerate(self.words):
            h, n = self.matrix[k, : len(w)], min(SHINGLE, len(w))
            at = np.arange(len(h) - n + 1)
            found[n].append((run_hashes(h, at, n), np.full(len(at), k), at))
        self.shingles = {n: tuple(np.concatenate(x) for x in zip(*v)) for n, v in found.items()}

    def keys(self) -> dict[int, np.ndarray]:
        return {n: np.unique(h) for n, (h, _, _) in self.shingles.items()}

    def with_prefixes(self, counts: dict[tuple[int, int], int]) -> Index:
        """counts: how often each (width, shingle) occurs in all documents. Windows
        with a shingle that never occurs are left out: no document contains them."""
        self.prefix = {}
        for n, (h, window, offset) in self.shingles.items():
            often = np.array([counts.get((n, int(x)), 0) for x in h.view(np.int64)])
            order = np.lexsort((h, often, window))
            first = order[np.r_[True, window[order][1:] != window[order][:-1]]]
            first = first[often[first] > 0]
            first = first[np.argsort(h[first], kind="stable")]
            self.prefix[n] = (h[first], window[first], offset[first])
        del self.shingles
        return self


def members(h: np.ndarray, keys: np.ndarray, table_bits: int = 20) -> np.ndarray:
    """Positions of h that are in the sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << table_bits, bool)
    seen[keys >> U(64 - table_bits)] = True
    at = np.flatnonzero(seen[h >> U(64 - table_bits)])
    near = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    return at[keys[near] == h[at]]


def counting(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = keys.value
        total = {n: np.zeros(len(k), np.int64) for n, k in have.items()}
        for _, offs, data in pieces(batches, "text"):
            words = Words(offs, data)
            for n, k in have.items():
                h = words.shingles(n)[1]
                h = h[members(h, k)]
                np.add.at(total[n], np.searchsorted(k, h), 1)
        for n, k in have.items():
            at = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(k[at].view(np.int64)), pa.array(total[n][at])], ["width", "shingle", "n"])

    return run


def candidates(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence, verified."""
    starts, windows = [], []
    for n, (keys, window, offset) in index.prefix.items():
        at, h = words.shingles(n)
        pick = members(h, keys)
        at, h = at[pick], h[pick]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        each = hi - lo
        row = np.repeat(np.arange(len(at)), each)
        entry = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
        start, win, doc = at[row] - offset[entry], window[entry], words.doc[at[row]]
        size = index.size[win]
        fits = (start >= words.first[doc]) & (start + size <= words.first[doc + 1])
        start, win, size = start[fits], win[fits], size[fits]
        for k in np.unique(size):
            s, w = start[size == k], win[size == k]
            same = np.ones(len(s), bool)
            for i in range(k):
                same &= words.hash[s + i] == index.matrix[w, i]
            s, w = s[same], w[same]
            exact = np.fromiter((tuple(x for x in words.bytes[words.start[a] : words.end[a + k - 1]].tobytes().split(b"\0") if x) == index.words[b] for a, b in zip(s, w)), bool, len(s))
            starts.append(s[exact])
            windows.append(w[exact])
    return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64),) * 2


def matching(index, first_block: bool):
    """Hits of each document; of documents without any, the first block alone has a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Index = index.value
        for batch, offs, data in pieces(batches, "text"):
            words = Words(offs, data)
            s, w = candidates(words, have)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + have.size[w], -1)
            hit = np.add.accumulate(cover[:-1]) > 0
            new = hit.copy()
            new[1:] &= ~hit[:-1] | (words.doc[1:] != words.doc[:-1])
            end = hit.copy()
            end[:-1] &= ~hit[1:] | (words.doc[1:] != words.doc[:-1])
            a, b = np.flatnonzero(new), np.flatnonzero(end) + 1
            doc, base = words.doc[a], words.first[:-1]
            per = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array((a - base[doc]).astype(np.int32)), pa.array((b - base[doc]).astype(np.int32))], ["s", "e"]))
            found: dict[int, set] = defaultdict(set)
            for d, x in set(zip(words.doc[s].tolist(), w.tolist())):
                found[d].update(have.items[x])
            items = pa.array([sorted(found.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), spans, items], ["_uid", "doc_id", "n_words", "spans", "items"])
            yield out if first_block else out.take(pa.array(np.flatnonzero(np.diff(per))))

    return run


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, uid: str | None = None) -> DataFrame:
    """One row per document: _uid (the column uid of docs, if they are numbered), doc_id,
    n_words, spans of hit words (start, end), items with occurring windows."""
    spark = docs.sparkSession
    tune(spark)
    sc = spark.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    number = F.col(uid) if uid else F.lit(0).cast("long")
    texts = docs.select(number.alias("_uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1 and not uid:  # rows of several passes are brought together by number
        texts = numbered(Scratch(spark, "decontaminate"), texts.drop("_uid"))
    out, keep = None, Scratch(spark, "decontaminate")
    for k in range(blocks):
        index = Index([(r.id, r.t) for r in items.where(F.col("block") == k).select("id", "t").collect()], window)
        keys = sc.broadcast(index.keys())
        counts = texts.select("text").mapInArrow(counting(keys), "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
        index.with_prefixes({(r.width, r.shingle): r.n for r in counts.collect()})
        keys.destroy()
        sent = sc.broadcast(index)
        block = texts.select("_uid", "doc_id", "text").mapInArrow(matching(sent, k == 0), HITS)
        if blocks > 1:  # a block's hits are stored, and its index goes before the next one comes
            block = keep.write(block, f"hits-{k}")
            sent.destroy()
        out = block if out is None else out.unionByName(block)
    if blocks > 1:
        flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  at most a few spans of each block for one document
        out = out.groupBy("_uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(flat("spans")).alias("spans"), F.array_distinct(flat("items")).alias("items"))
    return out


def n_hit(spans: str = "spans"):
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a.e, x.e).alias("e"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(a.e, x.s))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a.n)


def report(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    found = hits(docs, benchmark, **more)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs."""
    uid = free_name(docs, "_clean_uid")
    docs = numbered(Scratch(docs.sparkSession, "decontaminate"), docs, uid)
    bad = hits(docs, benchmark, uid=uid, **more).where(F.size("spans") > 0).select(F.col("_uid").alias(uid))
    return docs.join(bad, uid, "left_anti").drop(uid)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
pos AS (SELECT u, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT u, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT DISTINCT u, item_id, i, n FROM pos JOIN win USING (n, t)),
word AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT u, i, n FROM hit)) GROUP BY u),
ids AS (SELECT u, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT u, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (u) LEFT JOIN ids USING (u)"""
