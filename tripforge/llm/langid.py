"""Language identification with a string kernel.

The kernel is the blended spectrum of presence: the number of n-grams (1 to GRAMS bytes,
lower-cased, letters only, hashed to DIM bins) that two texts share, over the geometric
mean of the numbers that each has. A Nystroem map through LANDMARKS training texts makes
the kernel a vector; one-versus-rest ridge regression on it gives a margin for each
language. As the kernel is a scalar product of presence vectors, landmarks and weights
fold into one matrix of DIM rows, and a batch of whole texts is scored by one product.

The classifier is fitted on a bounded sample: about `sample` labelled rows in all, in
equal parts for each language, chosen by a hash of id and text. Everything else covers
all rows.

Nulls: rows with a null lang or null text aren't learned from; a null text, or one
without any letter, gets `und` with score 0. Where no labelled rows exist, all texts get
`und`. A null id counts as empty text for the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import remainder, table, tune
from tripforge.llm.textvec import pieces

GRAMS = 4
BITS = 14
DIM = 1 << BITS
LANDMARKS = 256
SAMPLE = 6000
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the capitals of Latin-1; all other ASCII is a space."""
    b = _LETTERS[data]
    if len(b) > 1:
        capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][capital] += 0x20
    return b


def presence(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """rows x DIM, true for the bins of n-grams that a text has."""
    rows = len(offs) - 1
    out = np.zeros(rows * DIM, bool)
    b = folded(data).astype(np.uint32)
    base = np.repeat(np.arange(rows, dtype=np.int64) * DIM, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(b))
    code = np.zeros(len(b), np.uint32)
    for n in range(1, GRAMS + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = code[:m] | b[n - 1 :] << np.uint32(8 * (n - 1))
        mixed = code * np.uint32(2654435761) + np.uint32(n * 40503)
        mixed ^= mixed >> np.uint32(15)
        bins = (mixed * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        whole = left[:m] >= n
        out[(base[:m] + bins)[whole]] = True
    return out.reshape(rows, DIM)


def has_letter(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    rows = len(offs) - 1
    ascii_, wide = (np.concatenate([[0], np.cumsum(x)]) for x in (_LETTERS[data] - 97 < 26, data >= 128))
    out = ascii_[offs[1:]] > ascii_[offs[:-1]]
    for i in np.flatnonzero(~out & (wide[offs[1:]] > wide[offs[:-1]])):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out.reshape(rows)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])
    return (a @ b.T) / scale


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, offs, data in pieces(batches, "text", rows=256):
        keep = np.flatnonzero(has_letter(offs, data))
        bits = np.packbits(presence(offs, data)[keep], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(keep)), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "bits"])


class Model:
    """Languages and the DIM x languages matrix of weights."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def predict(self, offs: np.ndarray, data: np.ndarray) -> tuple[list[str], np.ndarray]:
        known = has_letter(offs, data)
        if not self.langs:
            return [UNKNOWN] * len(known), np.zeros(len(known))
        x = presence(offs, data)
        margin = x.astype(np.float32) @ self.weights / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        best = margin.argmax(1)
        e = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
        score = np.where(known, 1 / e.sum(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], score


def solve(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: a presence row per labelled text, in an order that doesn't depend on lang."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIM, 0), np.float32))
    of = np.array([names.index(x) for x in langs])
    x = bits.astype(np.float32)
    per = -(-landmarks // len(names))
    marks = np.concatenate([np.flatnonzero(of == k)[:per] for k in range(len(names))])
    z = x[marks]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, z) @ root
    y = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(of) / np.bincount(of, minlength=len(names)))[of] / len(names)
    phi, y = np.c_[phi] * np.sqrt(weight)[:, None], y * np.sqrt(weight)[:, None]
    w = np.linalg.solve(phi.T @ phi + ridge * len(of) * np.eye(phi.shape[1]), phi.T @ y)
    fold = (root @ w) / np.sqrt(np.maximum(z.sum(1), 1))[:, None]
    return Model(names, (z.T @ fold).astype(np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """docs: the labelled rows that may be learned from."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return solve(np.zeros((0, DIM), bool), [])
    share = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, sample / len(count) / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_packed, "lang string, bits binary").orderBy(F.xxhash64("bits"), "bits").collect()
    bits = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got], bool).reshape(len(got), DIM)
    return solve(bits, [r.lang for r in got])


def _predicting(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text", rows=256):
            lang, score = model.value.predict(offs, data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    tune(spark)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predicting(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 5) == 0
    return identify(docs, fit(docs.where(~held)), held_out=held)
