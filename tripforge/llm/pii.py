"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are spans of four kinds: matches of the exact patterns (base spans), matches
that fail the pattern's own check (a digit sum, a range), and matches of wider patterns
for other spellings of the same things. Labelers vote on each: its form, its check, a
gazetteer (top-level domains, reserved networks, issuers, calling codes), words before it,
and the characters around it. Votes yes, no or none of five labelers make a pattern;
counts of patterns, at most KINDS x 3**5 rows, reach the driver. Expectation-maximisation
estimates there, for each kind, how reliable every labeler is, and the probability of each
pattern. With these as soft labels Spark counts the values of each candidate's features
(hashed to BUCKETS), and their log odds, shrunk to the share of the kind, are the final
span classifier. It covers all rows; no step samples.

Base spans always stay. A span of a wider pattern is added if it passes its check, the
classifier gives it THRESHOLD or more and it overlaps no base span and no added one before.

Texts are searched once for each pattern. Patterns take runs of characters possessively
and start at the edge of a run, so time is linear in the text, also for one endless word.
Offsets are in code points; they are running sums over the pieces between matches, by
doubling, n log n for n matches.

Defined cases: a null text is empty, an empty text has no spans; rows with equal or null
ids keep a row each; other columns aren't read. A control character U+0001 in a text
counts as U+0002 in the search, which no pattern sees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
LABELERS, SLOTS, BUCKETS, THRESHOLD, ROUNDS, LEFT = 5, 7, 256, 0.9, 40, 40
MARK, BASE, WIDER, FAILED = "\u0001", 0, 1, 2

#: The exact patterns, with possessive runs, which match the same spans in linear time.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BRACKET, _DOT, _LABEL, _GAP = r"\x20?[(\[{](?:at|AT|@)[)\]}]\x20?", r"\x20?[(\[{](?:dot|DOT|\.)[)\]}]\x20?", r"[A-Za-z0-9-]++", r"[\x20./_\x{A0}\x{2013}-]{1,3}+"
_LOCAL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++"
#: Other spellings of the same things.
WIDE = {
    "email": rf"{_LOCAL}(?:{_BRACKET}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})++|\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL})++|@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9])[0-9]{{4}}(?:(?:{_GAP}[0-9]{{4}}){{3}}|{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![\p{L}0-9+])(?:00[1-9][0-9]{0,2}[\x20.-])?+(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a pattern to be worth a search.
WORTH = {
    ("email", BASE): "@", ("ip", BASE): r"[0-9]\.[0-9]", ("card", BASE): r"[0-9](?:[\x20-]?[0-9]){11}", ("phone", BASE): r"\+[0-9]",
    ("email", WIDER): r"[(\[{](?:at|AT|@)[)\]}]|\x20dot\x20|[^\x00-\x7F]@|@[^\x00-\x7F]|@[A-Za-z0-9.-]+[^\x00-\x7F]|[^\x00-\x7F][A-Za-z0-9._%+-]+@",
    ("ip", WIDER): r"[0-9](?:\[\.\]|\(\.\)|\[dot\])[0-9]|(?:[0-9A-Fa-f]{1,4}:){7}", ("card", WIDER): rf"[0-9]{{4}}{_GAP}[0-9]{{4}}", ("phone", WIDER): r"[0-9]\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3}",
}
#: Gazetteers and words of context.
DOMAINS = "com org net edu gov mil int info biz io dev app me tv eu de at ch fr be nl es pt it uk ie se no dk fi pl cz gr ru ua tr us ca mx br ar cl au nz jp cn kr tw in id za".split()
RESERVED = r"^0*(?:0|127|22[4-9]|2[345][0-9])[^0-9]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
CALLING = r"^\+?(?:00)?(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-9]|6[0-9]|8[1-9]|9[0-9])"
CUES = {"email": "mail|contact|write|reply|courriel|correo|kontakt", "ip": r"\bip\b|host|server|addr|client|from|ping", "card": "card|visa|master|amex|carte|karte|tarjeta|paid|pay", "phone": "tel|phone|call|fax|mobil|cell|anruf|llam"}
AGAINST = r"version|isbn|serial|order|invoice|commit|hash|token|build|issue|figure|section"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combinations of an array, by doubling the reach."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def doubled(now: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(now, lambda x, i: F.when(i >= back, combine(x, F.get(now, i - back))).otherwise(x))

    return F.aggregate(steps, values, doubled)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether 12 to 19 digits have a right check digit."""
    digit = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), part), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def _check(kind: str, m: Column) -> Column:
    """The kind's own check. Emails have none: any match of their pattern counts."""
    if kind == "card":
        return let(_digits(m), luhn)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    part = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (m.rlike(f"^{part}(?:[^0-9:]+{part}){{3}}$") | m.contains(":")) if kind == "ip" else F.lit(True)


def _known(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"[\p{L}\p{N}-]+$", 0)).isin(DOMAINS)
    if kind == "ip":
        return ~m.rlike(RESERVED)
    return _digits(m).rlike(ISSUERS) if kind == "card" else m.rlike(CALLING) | m.startswith("(")


def _side(c: Column) -> Column:
    return F.when(c == "", "").when(c.rlike(r"^\s"), " ").when(c.rlike(r"^\p{L}"), "a").when(c.rlike(r"^\p{N}"), "9").otherwise(c)


def _candidates(text: Column, kind: str, wide: bool) -> Column:
    """Structs of kind, start, end, origin, pattern (of votes) and values (of features)."""
    number, pattern = KINDS.index(kind), (WIDE if wide else EXACT)[kind]

    def at(p: Column, ends: Column, i: Column) -> Column:
        m, before, after = p[i], F.right(p[i - 1], F.lit(LEFT)), F.substring(p[i + 1], 1, 1)

        def judged(ok: Column) -> Column:
            prior, cue = F.lower(before), lambda r: F.lower(before).rlike(r)
            edge = F.right(before, F.lit(1))
            form = F.lit(0) if wide else F.when(ok, 1).otherwise(-1)
            known = F.when(_known(kind, m), 1).otherwise(-1)
            said = F.when(cue(AGAINST), -1).when(cue(CUES[kind]), 1).otherwise(0)
            free = F.when(edge.rlike(r"[\p{L}\p{N}_=/#]") | after.rlike(r"[\p{L}\p{N}_=/#]"), -1).otherwise(1)
            votes, code = (form, F.when(ok, 1).otherwise(-1), known, said, free), F.lit(number)
            for v in votes:
                code = code * 3 + v + 1
            shape = F.left(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"\p{L}+", "a"), F.lit(32))
            word = F.regexp_extract(prior, r"(\p{L}+)[^\p{L}]*$", 1)
            values = (shape, F.least(F.length(m), F.lit(BUCKETS)).cast("string"), _side(edge), _side(after), word, ok.cast("string"), known.cast("string"))
            origin = F.lit(WIDER) if wide else F.when(ok, BASE).otherwise(FAILED)
            return F.struct(F.lit(number).alias("kind"), ends[i - 1].alias("start"), ends[i].alias("end"), origin.alias("origin"), ok.alias("ok"), code.cast("int").alias("pattern"), F.array(*[F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int") for v in values]).alias("values"))

        return let(_check(kind, m), judged)

    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    ends = lambda p: scan(F.transform(p, F.length), lambda x, y: x + y)
    found = let(pieces, lambda p: F.when(F.size(p) > 1, let(ends(p), lambda e: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: at(p, e, i)))))
    return F.when(text.rlike(WORTH[kind, WIDER if wide else BASE]), found)


CANDIDATE = "array<struct<kind:int,start:int,end:int,origin:int,ok:boolean,pattern:int,values:array<int>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id and all candidates, without text."""
    text = docs.select(F.col(id_col).alias("_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, "\u0002").alias("_t"))
    lists = [F.coalesce(_candidates(F.col("_t"), k, wide).cast(CANDIDATE), F.array().cast(CANDIDATE)) for wide in (False, True) for k in KINDS]
    return text.select("_id", F.concat(*lists).alias("_all"))


def reliabilities(counts: dict[int, int]) -> tuple[dict[int, float], dict[str, list]]:
    """Expectation-maximisation over counts of vote patterns (kind * 3**LABELERS + votes as
    base-3 digits). Gives each pattern's probability and each kind's share of true spans
    with its labelers' vote shares for true and for other spans. A prior worth a twentieth
    of the votes holds that labelers are right more often than wrong."""
    votes = lambda c: [c // 3**j % 3 for j in range(LABELERS - 1, -1, -1)]
    out, found = {}, {}
    for number, kind in enumerate(KINDS):
        own = {c: n for c, n in counts.items() if c // 3**LABELERS == number}
        if not own:
            continue
        of = {c: votes(c) for c in own}
        p = {c: (1 + v.count(2)) / (2 + v.count(2) + v.count(0)) for c, v in of.items()}
        trust = max(1.0, 0.05 * sum(own.values()))
        for _ in range(ROUNDS):
            true, every = sum(n * p[c] for c, n in own.items()), sum(own.values())
            share = (true + 1) / (every + 2)
            tables = []
            for yes in (True, False):
                total = (true if yes else every - true) + trust
                told = [[trust * w / 6 for w in ((1, 2, 3) if yes else (3, 2, 1))] for _ in range(LABELERS)]
                for c, n in own.items():
                    for j, v in enumerate(of[c]):
                        told[j][v] += n * (p[c] if yes else 1 - p[c])
                tables.append([[x / total for x in t] for t in told])
            odds = {c: math.log(share / (1 - share)) + sum(math.log(tables[0][j][v] / tables[1][j][v]) for j, v in enumerate(of[c])) for c in own}
            p = {c: 1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for c, x in odds.items()}
        out |= p
        found[kind] = [share, *tables]
    return out, found


def _constant(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def fit(found: DataFrame) -> tuple[list[float], list[float], dict[str, list]]:
    """From stored candidates: the classifier's log odds for each kind and for each
    (kind, slot, value), and what the labelers' reliabilities are."""
    spans = found.select(F.explode("_all").alias("c")).select("c.*")
    counts = {r.pattern: r["n"] for r in spans.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, labelers = reliabilities(counts)
    true = F.get(_constant([p.get(c, 0.0) for c in range(len(KINDS) * 3**LABELERS)]), F.col("pattern"))
    told = spans.select("kind", true.alias("p"), F.posexplode("values").alias("slot", "value")).groupBy("kind", "slot", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    prior, weights = [0.0] * len(KINDS), [0.0] * (len(KINDS) * SLOTS * BUCKETS)
    for k in range(len(KINDS)):
        own = [r for r in told if r.kind == k]
        yes, no = (1 + sum(r[x] for r in own if r.slot == 0) for x in ("yes", "no"))
        prior[k] = math.log(yes / no)
        for r in own:
            weights[(k * SLOTS + r.slot) * BUCKETS + r.value] = math.log((r.yes + yes / (yes + no)) / (r.no + no / (yes + no))) - prior[k]
    return prior, weights, labelers


def added(every: Column, prior: list[float], weights: list[float]) -> Column:
    """The spans of wider patterns that the classifier accepts and that overlap no other."""
    odds, log_odds = _constant(weights), _constant(prior)
    need = math.log(THRESHOLD / (1 - THRESHOLD))
    score = lambda c: F.get(log_odds, c["kind"]) + F.aggregate(F.transform(c["values"], lambda v, j: F.get(odds, (c["kind"] * SLOTS + j) * BUCKETS + v)), F.lit(0.0), lambda a, x: a + x)
    good = F.filter(every, lambda c: (c["origin"] == WIDER) & c["ok"] & (score(c) >= need))

    def free(spans: Column) -> Column:
        """Of spans by start, base ones and those that begin after all others' ends before them and end before the next base span."""
        is_base = lambda c: c["origin"] == BASE
        reach = lambda s: scan(F.transform(s, lambda c: c["end"]), F.greatest)
        nearest = lambda s: F.reverse(scan(F.reverse(F.transform(s, lambda c: F.when(is_base(c), c["start"]).otherwise(2**31 - 1))), F.least))
        return let(reach(spans), lambda far: let(nearest(spans), lambda near: F.filter(spans, lambda c, i: (c["origin"] == WIDER) & (F.coalesce(F.get(far, i - 1), F.lit(0)) <= c["start"]) & (near[i] >= c["end"]))))

    order = lambda s: F.array_sort(F.transform(s, lambda c: F.struct(c["start"], c["kind"], c["end"], c["origin"])))
    both = F.concat(F.filter(every, lambda c: c["origin"] == BASE), good)
    return F.when(F.size(good) > 0, let(order(both), free))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, base and added spans as arrays of start, kind (number), end."""
    keep = Scratch(docs.sparkSession, "pii")
    found = keep.write(candidates(docs, id_col, text_col), "candidates")
    prior, weights, _ = fit(found)
    plain = lambda s: F.array_sort(F.transform(s, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    base = plain(F.filter("_all", lambda c: c["origin"] == BASE))
    more = added(F.col("_all"), prior, weights)
    kind = "array<struct<start:int,kind:int,end:int>>"
    return found.select(F.col("_id").alias(id_col), base.cast(kind).alias("base"), F.coalesce(plain(more).cast(kind), F.array().cast(kind)).alias("added"))


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the numbers of base spans by kind, a digest of them, and all spans."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda s: F.array_join(F.transform(s, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    count = [of(k).alias(f"n_{x}") for k, x in enumerate(KINDS)]
    found = spans(docs, id_col, text_col)
    return found.select(id_col, *count, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))
