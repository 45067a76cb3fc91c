"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: words, and beginnings of words (for languages that compound or
inflect), that labelled toxic texts have far more often than others. It is stored as a
trie. A token matches a term within a number of edits that its length allows; the
automaton of all strings within that distance of some term is the product of the trie
with Levenshtein automata, determinised as tokens are read: a state is a set of (trie
node, edits so far), and a token that leaves all terms behind ends in the empty state
after a few letters. Inexact matches of a term count
only if labelled clean texts have next to none.

Each hit is scored in its context: the window of WINDOW tokens on both sides, other hits
there, context words that were learned from labelled hits, and quotation (an open double
quote, or a quote mark beside the term). A logistic model over a document's hits gives
the score, corrected to the share of toxic texts among labelled rows.

The lexicon and the model are fitted on a bounded sample: at most about `sample` labelled
rows, half of each label where there are enough, chosen by a hash of the id. All texts
are scored whole.

Nulls: a null text is empty; labels that are null aren't learned from; of several labels
of an id the highest counts. Without labels of both kinds the score is 0 throughout. A
null id counts as empty text for the split and has no label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, remainder, table, tune
from tripforge.llm.textvec import Words, byte_table, pieces

SAMPLE = 20_000
WINDOW = 8
THRESHOLD = 0.7
MIN_TEXTS = 4
MIN_PRECISION = 0.8
#: Inexact matches of a term count if those in clean texts (and one more) are at most
#: this share of the toxic texts that have the term.
LOOSE = 0.05
#: A term's first letters may be a term: from this many on, to this many.
STEM, STEMS = 4, 16
#: Longer words aren't learned as terms; their beginnings are.
LONGEST = 64
CACHE = 1 << 20
#: The automaton is built anew, from its start, when it has more states.
STATES = 1 << 16

#: Word characters: letters, digits, all beyond ASCII, and marks that stand in for letters.
TOKEN = byte_table([(0x00, 0x20), (0x22, 0x23), (0x25, 0x29), (0x2B, 0x2F), (0x3A, 0x3F), (0x5B, 0x60), (0x7B, 0x7F)])
EDGES = "@$*!0123456789«»„“”‘’‚‹›…–—¿¡"
QUOTES = ('"', "«", "»", "“", "”", "„")


def plain(token: str) -> str:
    return token.lower().strip(EDGES)


def edits(term: str) -> int:
    """Edits that a term of this length allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """terms: term -> weight; a term that ends in * matches beginnings of words, exactly."""

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weights = np.array([terms[t] for t in self.terms])
        #: Terms of which inexact matches count; of the others they mostly are clean words.
        self.loose = set(range(len(self.terms)))
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: list[int] = [-1]
        self.reach: list[int] = [0]
        for k, t in enumerate(self.terms):
            at, word = 0, t.rstrip("*")
            most = 0 if t.endswith("*") else edits(word)
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.stems.append(-1)
                    self.reach.append(0)
                at = self.next[at][c]
                self.reach[at] = max(self.reach[at], most)
            if t.endswith("*"):
                self.stems[at] = k
            else:
                self.ends[at] = k
        self.reach[0] = max(self.reach, default=0)
        self.start()

    def start(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.keys: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, int]] = []
        self.stem: list[int] = []
        self.cache: dict[str, tuple[int, int]] = {}
        self.dead = self.state(frozenset())
        self.begin = self.state(self.closed({(0, 0)}))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "keys", "moves", "accept", "stem", "cache", "dead", "begin")}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self.start()

    def closed(self, pairs: set) -> frozenset:
        """With deletions: letters of a term that the token leaves out."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < 2:
                for to in self.next[node].values():
                    if e + 1 <= self.reach[to] and (to, e + 1) not in pairs:
                        pairs.add((to, e + 1))
                        todo.append((to, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, 9))
        return frozenset(least.items())

    def state(self, key: frozenset) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            best, stem = (9, -1), -1
            for node, e in key:
                k = self.ends[node]
                if k >= 0 and e <= edits(self.terms[k]):
                    best = min(best, (e, k))
                if e == 0 and self.stems[node] >= 0:
                    stem = self.stems[node]
            self.accept.append(best)
            self.stem.append(stem)
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.keys[state]:
            for letter, to in self.next[node].items():
                if letter == c:
                    pairs.add((to, e))
                elif e + 1 <= self.reach[to]:
                    pairs.add((to, e + 1))
            if e + 1 <= self.reach[node]:
                pairs.add((node, e + 1))
        out = self.moves[state][c] = self.state(self.closed(pairs))
        return out

    def match(self, token: str) -> tuple[int, int]:
        """(term number, edits) of the best match, or (-1, 0)."""
        state, stem = self.begin, -1
        for c in token:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if self.stem[state] >= 0:
                stem = self.stem[state]
            if state == self.dead:
                break
        e, k = self.accept[state]
        if k >= 0 and (e == 0 or stem < 0):
            return k, e
        return (stem, 0) if stem >= 0 else (-1, 0)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Term number (or -1) and edits of every word; each distinct word is read once."""
        uniq, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        term, cost = np.full(len(uniq), -1, np.int64), np.zeros(len(uniq), np.int64)
        raw = words.bytes.tobytes()
        if len(self.keys) > STATES:
            self.start()
        for i, (s, e) in enumerate(zip(words.start[first].tolist(), words.end[first].tolist())):
            token = raw[s:e]
            got = self.cache.get(token)
            if got is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                got = self.cache[token] = self.match(plain(token.decode("utf-8", "replace")))
            if got[0] >= 0:
                term[i], cost[i] = got
        return term[back], cost[back]


FEATURES = 8


class Marks:
    """Positions of line feeds and quotation marks in the texts of a batch."""

    def __init__(self, data: np.ndarray):
        self.line, self.double = np.flatnonzero(data == 0x0A), np.flatnonzero(data == 0x22)
        two, three = np.flatnonzero(data[:-1] == 0xC2), np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        of = lambda at, k, *last: at[np.isin(data[at + k], last)]
        self.pairs = [(of(two, 1, 0xAB), of(two, 1, 0xBB)), (of(three, 2, 0x9C, 0x9E), of(three, 2, 0x9D))]

    def begin(self, begin: int, at: int) -> int:
        """Where the line begins, in a text that begins at `begin`."""
        k = int(np.searchsorted(self.line, at))
        return max(begin, int(self.line[k - 1]) + 1) if k else begin

    def open(self, begin: int, at: int) -> bool:
        """If a quotation is open there, in the line of a text that begins at `begin`."""
        last = lambda where: int(where[k - 1]) if (k := int(np.searchsorted(where, at))) else -1
        begin = self.begin(begin, at)
        if (np.searchsorted(self.double, at) - np.searchsorted(self.double, begin)) % 2:
            return True
        return any(last(a) >= begin and last(a) > last(b) for a, b in self.pairs)


def beside(data: np.ndarray, begin: int, s: int, e: int, end: int) -> bool:
    """If the term stands between quotation marks; white space before it and punctuation
    after it aside."""
    while s > begin and data[s - 1] in b" \t\r\x0b\x0c":
        s -= 1
    while e < end and data[e] in b".,!?":
        e += 1
    before, after = data[max(begin, s - 4) : s].tobytes().decode("utf-8", "ignore"), data[e : min(end, e + 4)].tobytes().decode("utf-8", "ignore")
    return before[-1:] in QUOTES and after[:1] in QUOTES


def hits_of(words: Words, data: np.ndarray, offs: np.ndarray, lexicon: Lexicon, context: dict[str, float]):
    """(document, word number, term, edits, quoted, context score) of each hit."""
    term, cost = lexicon.matches(words)
    term[(cost > 0) & ~np.isin(term, sorted(lexicon.loose))] = -1
    found = np.flatnonzero(term >= 0).tolist()
    marks = Marks(data) if found else None
    for w in found:
        d = int(words.doc[w])
        s, e = int(words.start[w]), int(words.end[w])
        quote = marks.open(int(offs[d]), s) or beside(data, marks.begin(int(offs[d]), s), s, e, int(offs[d + 1]))
        lo, hi = max(words.first[d], w - WINDOW), min(words.first[d + 1], w + WINDOW + 1)
        near = [plain(words.bytes[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace")) for i in range(lo, hi) if i != w]
        others = int((term[lo:hi] >= 0).sum()) - 1
        known = [context[x] for x in near if x in context]
        yield d, w, int(term[w]), int(cost[w]), quote, others, (sum(known) / (2 + len(known))), near


def features(found: list, n_words: int, lexicon: Lexicon) -> list[float]:
    """Of the hits of one document."""
    if not found:
        return [0.0] * FEATURES
    weight = np.array([lexicon.weights[t] * (1.0, 0.8, 0.6)[e] for _, _, t, e, *_ in found])
    free = np.array([not q for *_, q, _, _, _ in found])
    return [
        1.0, float((weight * free).max(initial=0)), math.log1p(float((weight * free).sum())), math.log1p(float((~free).sum())),
        math.log1p(sum(e > 0 for _, _, _, e, *_ in found)), float(max(o for *_, o, _, _ in found) > 0),
        float(np.mean([c for *_, c, _ in found])), len(found) / math.sqrt(n_words + 1),
    ]


class Model:
    def __init__(self, lexicon: Lexicon, context: dict[str, float], weights: np.ndarray, bias: float, known: bool):
        self.lexicon, self.context, self.weights, self.bias, self.known = lexicon, context, weights, bias, known

    def rows(self, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
        words = Words(offs, data, TOKEN)
        by: dict[int, list] = {}
        for hit in hits_of(words, data, offs, self.lexicon, self.context):
            by.setdefault(hit[0], []).append(hit)
        count = np.diff(words.first)
        out = np.zeros((len(offs) - 1, FEATURES))
        for d, found in by.items():
            out[d] = features(found, int(count[d]), self.lexicon)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts by term: words, and beginnings of words marked with *."""
    total: dict[str, list[int]] = {}
    for batch, offs, data in pieces(batches, "text"):
        words = Words(offs, data, TOKEN)
        raw, toxic = words.bytes.tobytes(), batch.column("toxic").to_numpy()
        for d in range(batch.num_rows):
            lo, hi = words.first[d], words.first[d + 1]
            seen = {plain(x.decode("utf-8", "replace")) for x in {raw[s:e] for s, e in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist())}}
            stems = {w[:n] + "*" for w in seen if w.isalpha() for n in range(STEM, min(STEMS + 1, len(w)))}
            for t in seen | stems:
                if t and len(t) <= LONGEST:
                    total.setdefault(t, [0, 0])[int(toxic[d])] += 1
        if len(total) > 1 << 18:
            yield _counted(total)
            total = {}
    yield _counted(total)


def _counted(total: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["term", "clean", "toxic"])


def _hits(model):
    """Context words and features of labelled texts, for fitting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            words = Words(offs, data, TOKEN)
            near: dict[int, set] = {}
            loose: dict[int, set] = {}
            for d, _, term, cost, *_, words_near in hits_of(words, data, offs, model.value.lexicon, {}):
                if cost:
                    loose.setdefault(d, set()).add(term)
                else:
                    near.setdefault(d, set()).update(words_near)
            at = sorted(near.keys() | loose.keys())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(at, pa.int64())), pa.array([sorted(loose.get(d, ())) for d in at], pa.list_(pa.int64())), pa.array([sorted(near.get(d, ())) for d in at], pa.list_(pa.string()))], ["toxic", "loose", "near"])

    return run


def _rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            x = model.value.rows(offs, data)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """Labelled texts of the sample, the numbers of labelled rows, the shares drawn. The
    sampled labels have a bound and are broadcast."""
    labels = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, sample / 2 / n) for k, n in count.items()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) / float(1 << 30)
    of = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(s)) for k, s in share.items()], F.lit(0.0))
    few = labels.where(draw < of).limit(2 * sample)
    return docs.join(F.broadcast(few), "id").select("toxic", "text"), count, share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: the rows that may be learned from."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    texts, count, share = sampled(docs, labels, sample)
    empty = Model(Lexicon({}), {}, np.zeros(FEATURES), 0.0, False)
    if not (count.get(0) and count.get(1)):
        return empty
    few = {k: max(1.0, n * share[k]) for k, n in count.items()}
    terms = texts.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / few[1]
    precision = rate * count[1] / (rate * count[1] + (F.col("clean") + 1.0) / few[0] * count[0])
    terms = terms.withColumn("precision", precision).where((F.col("toxic") >= MIN_TEXTS) & (precision >= MIN_PRECISION))
    found = terms.orderBy(F.desc("toxic"), "term").collect()  # the sample has a bound
    lexicon = Lexicon(shortest({r.term: (r.toxic, r.precision) for r in found}))
    first = Model(lexicon, {}, np.zeros(FEATURES), 0.0, True)
    # context words of hits, then the features with them
    got = Scratch(spark, "toxicity").write(texts.mapInArrow(_hits(spark.sparkContext.broadcast(first)), "toxic int, loose array<long>, near array<string>"), "hits")
    of = lambda k: F.count_if(F.col("toxic") == k).alias(("clean", "bad")[k])
    inexact = {r.t: (r.clean, r.bad) for r in got.select("toxic", F.explode("loose").alias("t")).groupBy("t").agg(of(0), of(1)).collect()}
    exact = {r.term: r.toxic for r in found}
    scale = {k: count[k] / few[k] for k in (0, 1)}
    none = (0, 0)
    lexicon.loose = {t for t, x in enumerate(lexicon.terms) if (inexact.get(t, none)[0] + 1) * scale[0] <= LOOSE * (exact[x] + inexact.get(t, none)[1]) * scale[1]}
    size = got.agg(of(0), of(1)).first()
    size = [max(1, size.clean), max(1, size.bad)]
    near = got.select("toxic", F.explode("near").alias("w")).groupBy("w").agg(of(0), of(1)).where("clean + bad >= 10 and clean > 0").collect()
    context = {r.w: math.log((r.bad + 1) / (size[1] + 2)) - math.log((r.clean + 1) / (size[0] + 2)) for r in near}
    second = Model(lexicon, context, np.zeros(FEATURES), 0.0, True)
    rows = texts.mapInArrow(_rows(spark.sparkContext.broadcast(second)), "toxic int, x array<double>").collect()  # FEATURES numbers for each row of the sample
    rows.sort(key=lambda r: (r.toxic, r.x))
    w = logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    second.weights, second.bias = w[:-1], w[-1] + math.log(share[0] / share[1])
    return second


def shortest(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Drops beginnings of words that a single word or a shorter beginning explains."""
    out, most = {}, {}
    for w, (m, _) in found.items():
        if not w.endswith("*"):
            for k in range(STEM, len(w) + 1):
                if m > most.get(w[:k], 0):
                    most[w[:k]] = m
    for t, (n, p) in found.items():
        if t.endswith("*"):
            stem = t[:-1]
            if any(found.get(stem[:k] + "*", (0, 0))[0] >= n for k in range(STEM, len(stem))):
                continue
            if most.get(stem, 0) >= 0.9 * n:
                continue
        out[t] = math.log(p / (1.001 - p))
    return out


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, "text"):
            score = model.value.score(model.value.rows(offs, data))
            names = ["_uid", "doc_id", "held_out"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c in batch.schema.names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*(c for c in names if c in batch.schema.names), "score", "predicted"])

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    tune(spark)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scoring(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, data in pieces(batches, text_col):
            score = held.value.score(held.value.rows(offs, data))
            yield batch.take(pa.array(np.flatnonzero(score < THRESHOLD)))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 3) != 1))
    return scores(docs, model, held_out=remainder("doc_id", 3) == 1)
