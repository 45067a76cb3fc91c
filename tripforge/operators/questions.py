"""Evaluation of many questions: each is a row that holds its candidates as arrays, so that
no row per candidate is shuffled or sorted, and only sums leave a task.

What a question's candidates share is joined by its context (cell, origin, period, class of
day), by its rider, and, for B, by rider and period; each task works on a bounded number of
questions at a time as matrices, question by candidate. The rules are those of `evaluate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tripforge.functions.geo import EARTH_RADIUS_KM, ROAD_FACTOR
from tripforge.functions.scoring import habits
from tripforge.operators import evaluate, spatial
from tripforge.sources.scratch import stored

CONTEXT = ["origin_id", "period", "weekday_class"]
#: Elements of a matrix at most, or one question; elements of a table that is broadcast.
CELLS, FEW = 1 << 17, 1 << 19
NULL, OUT = -1.0, -2.0  # scores are 0 or more; null ones come last, what is no candidate never
SUMS = ("questions", "verified", "covered", "hit5", "hit10", "mrr5", "ndcg5", "km", "items")


def _few(df: DataFrame, column: str) -> DataFrame:
    """A stored table, broadcast if its arrays hold few elements."""
    n = df.agg(F.sum(F.size(column))).first()[0] or 0
    return F.broadcast(df) if n <= FEW else df


def asked(questions: DataFrame, areas: DataFrame, overall: DataFrame, origin: DataFrame, scored: DataFrame, terms: DataFrame, visits: DataFrame, zero: DataFrame | None = None, seen: DataFrame | None = None, far: float = 30.0) -> DataFrame:
    """questions (trip_id, rider_id, period, weekday_class, origin_id, actual, lat, lng) with
    arrays: cand, a_lat, a_lng, global_score, origin_score, a_score of the areas of its cell;
    v_area, v_n, the rider's visits; b_area, b_score, and b_zero if there is B. overall and
    origin: counts g and o; terms: as `evaluate.rider_terms` gives them."""
    km = far / ROAD_FACTOR * (1 + 1e-9)
    held = spatial.held(questions, km)
    cell = [*CONTEXT, "_row", "_cell"]
    there = spatial.spread(areas.select(F.col("area_id").alias("candidate"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng")), km)
    rows = stored(held.select(*cell).distinct(), "contexts").join(there, ["_row", "_cell"])
    has = origin.select(*CONTEXT, F.lit(True).alias("has")).distinct()
    rows = rows.join(overall, [*CONTEXT[1:], "candidate"], "left").join(origin, [*CONTEXT, "candidate"], "left").join(has, CONTEXT, "left").join(scored, ["candidate", *CONTEXT[1:]])
    g = F.coalesce("g", F.lit(0)).cast("double")
    own = F.when(F.col("has"), F.coalesce("o", F.lit(0)).cast("double")).otherwise(g)
    each = F.struct(F.col("candidate").alias("cand"), "a_lat", "a_lng", g.alias("global_score"), own.alias("origin_score"), "a_score")
    names = ["cand", "a_lat", "a_lng", "global_score", "origin_score", "a_score"]
    of = rows.groupBy(*cell).agg(F.array_sort(F.collect_list(each)).alias("c")).select(*[F.col(x).alias(f"_k{x}") for x in cell], *[F.col(f"c.{x}").alias(x) for x in names])
    found = terms.join(_lists(visits.select("rider_id", F.col("area_id").alias("v_area"), F.col("visits").cast("double").alias("v_n")), ["rider_id"], ["v_area", "v_n"]), "rider_id", "left")
    out = held.join(_few(stored(found, "terms"), "v_area"), "rider_id", "left")
    if seen is not None:
        told = _lists(seen.select("rider_id", "period", F.col("area_id").alias("b_area"), "b_score"), ["rider_id", "period"], ["b_area", "b_score"])
        out = out.join(zero, "rider_id", "left").join(_few(stored(told, "seen"), "b_area"), ["rider_id", "period"], "left")
    of = _few(stored(of, "candidates"), "cand")
    same = None
    for x in cell:
        e = F.col(x).eqNullSafe(F.col(f"_k{x}"))
        same = e if same is None else same & e
    n, ratio = F.col("_n"), F.coalesce(*[F.when(F.col("period") == p, F.col(f"{p}_ratio")) for p in ("morning", "lunch", "afternoon", "dinner", "night")])
    habit, of_day = habits(ratio, F.col("weekend_ratio"), n, F.col("weekday_class"))
    more = ["b_area", "b_score", "b_zero"] if seen is not None else []
    return out.join(of, same).select("trip_id", "actual", "period", "weekday_class", F.coalesce("level", F.lit("cold")).alias("level"), "lat", "lng", habit.alias("habit"), of_day.alias("of_day"), F.coalesce("most", F.lit(0)).cast("double").alias("most"), "_25", "_75", "_90", "v_area", "v_n", *more, *names)


def _lists(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("x")).select(*by, *[F.col(f"x.{c}").alias(c) for c in columns])


def _doubles(x) -> np.ndarray:
    return pc.fill_null(x.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def _flat(col: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and elements of lists, null ones being empty."""
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64), col.flatten()


def _codes(*parts: pa.Array) -> list[np.ndarray]:
    """Ids as whole numbers in their order; -1 for null."""
    known = [p.drop_null().to_numpy(zero_copy_only=False) for p in parts]
    every = np.concatenate(known)
    if len(every) and every.dtype.kind == "i":
        low = every.min()
        if int(every.max()) - int(low) < 1 << 31:
            return [_spread(p, k - low) for p, k in zip(parts, known, strict=True)]
    names = np.unique(every)
    return [_spread(p, np.searchsorted(names, k)) for p, k in zip(parts, known, strict=True)]


def _spread(p: pa.Array, code: np.ndarray) -> np.ndarray:
    out = np.full(len(p), -1, np.int64)
    out[pc.is_valid(p).to_numpy(zero_copy_only=False)] = code
    return out


class Slice:
    """Some questions as matrices: cand (codes), kept, distance, and the scores, NaN for null."""

    def __init__(self, t: pa.RecordBatch, near: float, far: float, least: int):
        size, cand = _flat(t["cand"])
        v_size, v_area = _flat(t["v_area"])
        b = "b_area" in t.schema.names
        b_size, b_area = _flat(t["b_area"]) if b else (np.zeros(len(size), np.int64), cand.slice(0, 0))
        codes, v_codes, b_codes, self.actual = _codes(cand, v_area, b_area, t["actual"])
        self.ids, wide = cand, size.max()
        begin = np.cumsum(size) - size
        self.at = np.minimum(begin[:, None] + np.arange(wide), max(0, len(cand) - 1))
        there = np.arange(wide) < size[:, None]
        of = lambda c: t[c].flatten().to_numpy(zero_copy_only=False)[self.at]
        span = 2 + max((int(x.max()) for x in (codes, v_codes, b_codes, self.actual) if len(x)), default=0)
        self.cand = np.where(there, codes[self.at], span - 1)  # ascending in a row, as arrays are sorted
        self.span = span
        col = lambda c: _doubles(t[c])[:, None]
        lat, lng = np.radians(col("lat")), np.radians(col("lng"))
        a_lat, a_lng = np.radians(of("a_lat")), np.radians(of("a_lng"))
        x = np.sin((a_lat - lat) / 2) ** 2 + np.cos(lat) * np.cos(a_lat) * np.sin((a_lng - lng) / 2) ** 2
        self.distance = d = 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, x))) * ROAD_FACTOR
        there &= d <= far
        self.kept = there & (((d <= near) & there).sum(1)[:, None] < least) | (there & (d <= near))
        self.hit = self.kept & (self.cand == self.actual[:, None]) & (self.actual[:, None] >= 0)
        places = (np.arange(len(size))[:, None] * span + self.cand).ravel()

        def held(sizes: np.ndarray, keys: np.ndarray, values: np.ndarray, other: np.ndarray | float) -> np.ndarray:
            """The value of each candidate that is among a question's keys, or the other one."""
            out = np.array(np.broadcast_to(other, self.cand.shape)).ravel()
            want = (np.repeat(np.arange(len(sizes)), sizes) * span + keys)[keys >= 0]
            at = np.minimum(np.searchsorted(places, want), len(places) - 1)
            same = places[at] == want
            out[at[same]] = values[keys >= 0][same]
            return out.reshape(self.cand.shape)

        known = held(v_size, v_codes, np.log1p(_doubles(t["v_n"].flatten())), 0.0)
        p25, p75, p90, most = col("_25"), col("_75"), col("_90"), col("most")
        unit = lambda x: np.minimum(1.0, np.maximum(0.0, x))  # noqa: E731  NaN stays
        with np.errstate(all="ignore"):
            beyond = 0.65 * np.exp(-np.where(p90 == 0, np.nan, (d - p90) / p90))
            fit = np.where(d < p25, unit(0.35 + 0.65 * (d / p25)), np.where(d <= p75, 1.0, np.where(d <= p90, 1.0 - 0.35 * ((d - p75) / (p90 - p75)), unit(beyond))))
            affinity = np.where(most > 0, known / np.log1p(most), 0.0)
            c = unit(0.50 * fit + 0.20 * col("habit") + 0.15 * col("of_day") + 0.15 * affinity)
        self.score = {"global_score": of("global_score"), "origin_score": of("origin_score"), "a_score": of("a_score"), "c_score": c}
        if b:
            self.score["b_score"] = held(b_size, b_codes, _doubles(t["b_score"].flatten()), col("b_zero"))
        else:
            self.score["b_score"] = np.full(d.shape, np.nan)


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """The score in units of its last digit."""
    return np.floor(s * 10.0**digits + 0.5)


def _slices(batches: Iterator[pa.RecordBatch], near: float, far: float, least: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for batch in batches:
        if batch.num_rows:
            wide = max(1, pc.max(pc.list_value_length(batch["cand"])).as_py())
            step = max(1, CELLS // wide)
            for i in range(0, batch.num_rows, step):
                t = batch.slice(i, step)
                q = Slice(t, near, far, least)
                if q.kept.any():
                    yield t, q


def outcome_sums(rows: DataFrame, weights: dict[str, tuple[float, float, float]], groups: list[str], digits: int, near: float = 20.0, far: float = 30.0, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of questions as `asked` gives them, by model and groups: SUMS over the questions, and
    how often a candidate was among the first five (candidate, n)."""
    kind = rows.schema["cand"].dataType.elementType
    models = ["global_popularity", "origin_period", "area_a", *weights]
    schema = "model string, " + "".join(f"{g} string, " for g in groups) + f"candidate {kind.simpleString()}, " + ", ".join(f"{x} double" for x in SUMS) + ", n long"

    def scores(q: Slice) -> Iterator[np.ndarray]:
        yield from (q.score[x] for x in ("global_score", "origin_score", "a_score"))
        for w in weights.values():
            total, weight = np.zeros(q.cand.shape), np.zeros(q.cand.shape)
            for x, name in zip(w, ("a_score", "b_score", "c_score"), strict=True):
                s = q.score[name] if name == "a_score" or x > 0 else np.full(q.cand.shape, np.nan)
                some = ~np.isnan(s)
                total, weight = total + np.where(some, x * s, 0.0), weight + np.where(some, x, 0.0)
            with np.errstate(all="ignore"):
                yield np.minimum(1.0, np.maximum(0.0, np.where(weight == 0, np.nan, total / weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shown = {}, {}
        out = lambda: _sums_batch(sums, shown, groups, pa_kind)
        pa_kind = None
        for t, q in _slices(batches, near, far, least):
            pa_kind = q.ids.type
            live = q.kept.any(1)
            group, every = _grouped([t[g] for g in groups])
            covered, verified = q.hit.any(1), q.actual >= 0
            row, at_id = np.arange(len(group)), lambda i, ids=q.ids: ids[i].as_py()
            for model, s in zip(models, scores(q), strict=True):
                s = np.where(q.kept, np.where(np.isnan(s), NULL, _rounded(s, digits)), OUT)
                mine = np.where(q.hit, s, OUT).max(1)[:, None]
                ahead = (s > mine) | ((s == mine) & q.kept & (q.cand < q.actual[:, None]))
                place = np.where(covered, ahead.sum(1) + 1, np.inf)
                km, items, picked, places = np.zeros(len(row)), np.zeros(len(row)), [], []
                for _ in range(min(5, s.shape[1])):  # columns are in the order of candidates, so ties go to the smaller one
                    top = s.argmax(1)
                    ok = s[row, top] > OUT
                    km += np.where(ok, q.distance[row, top], 0.0)
                    items += ok
                    picked.append((group * q.span + q.cand[row, top])[ok])
                    places.append(q.at[row, top][ok])
                    s[row, top] = OUT
                for g, at, k in _counted(np.concatenate(picked), np.concatenate(places), q.span):
                    key = (model, every[g], at_id(at))
                    shown[key] = shown.get(key, 0) + k
                first = place <= 5
                per = (live, verified & live, covered & live, first, place <= 10, np.where(first, 1.0 / place, 0.0), np.where(first, 1.0 / np.log2(place + 1.0), 0.0), km, items)
                added = np.stack([np.bincount(group[live], v[live], len(every)) for v in per], axis=1)
                for g in np.flatnonzero(added[:, 0]).tolist():
                    sums[model, every[g]] = sums.get((model, every[g]), 0.0) + added[g]
            if len(shown) > 1 << 18:
                yield out()
                sums.clear(), shown.clear()
        if sums:
            yield out()

    got = stored(rows.mapInArrow(run, schema), "sums")
    by = ["model", *groups]
    return got.where("questions is not null").groupBy(*by).agg(*[F.sum(x).alias(x) for x in SUMS]), got.where("questions is null").groupBy(*by, "candidate").agg(F.sum("n").alias("n"))


def _grouped(columns: list[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """Each row's group, and the groups' values."""
    code, every = np.zeros(len(columns[0]), np.int64), [()]
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        names = d.dictionary.to_pylist()
        code, every = code * len(names) + d.indices.to_numpy(), [(*e, x) for e in every for x in names]
    return code, every


def _counted(keys: np.ndarray, places: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
    """(group, a place of the key, rows) of each key: a group times span and a code."""
    if len(keys) and keys.max() < 1 << 20:
        count = np.bincount(keys)
        pick, at = np.flatnonzero(count), np.empty(len(count), np.int64)
        at[keys] = places
        return zip((pick // span).tolist(), at[pick].tolist(), count[pick].tolist(), strict=True)
    pick, first, count = np.unique(keys, return_index=True, return_counts=True)
    return zip((pick // span).tolist(), places[first].tolist(), count.tolist(), strict=True)


def _sums_batch(sums: dict, shown: dict, groups: list[str], kind: pa.DataType) -> pa.RecordBatch:
    keys = [*[(m, g, None) for m, g in sums], *shown]
    cols = {"model": pa.array([k[0] for k in keys], pa.string())} | {g: pa.array([k[1][i] for k in keys], pa.string()) for i, g in enumerate(groups)} | {"candidate": pa.array([k[2] for k in keys], kind)}
    cols |= {x: pa.array([*[float(v[i]) for v in sums.values()], *[None] * len(shown)], pa.float64()) for i, x in enumerate(SUMS)}
    return pa.RecordBatch.from_pydict(cols | {"n": pa.array([*[None] * len(sums), *shown.values()], pa.int64())})


def tune(rows: DataFrame, strict: bool = False, digits: int = 9, near: float = 20.0, far: float = 30.0, least: int = 10) -> DataFrame:
    """As `evaluate.tune`, of questions as `asked` gives them."""
    grid = evaluate.weight_grid()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(grid)))
        for _, q in _slices(batches, near, far, least):
            a, b, c = (q.score[x] for x in ("a_score", "b_score", "c_score"))
            none = ~q.kept
            before = q.kept & (q.cand < q.actual[:, None])
            column = q.hit.argmax(1)
            row, is_there = np.arange(len(column)), q.hit.any(1)
            some = {x: bool((~np.isnan(s) & q.kept).any()) for x, s in (("b", b), ("c", c))}
            for i, (_, wa, wb, wc) in enumerate(grid):
                if (wb and not some["b"]) or (wc and not some["c"]):
                    continue
                s = wa * a
                for w, x in ((wb, b), (wc, c)):
                    if w:
                        s = s + w * x
                s = _rounded(np.minimum(1.0, np.maximum(0.0, s)), digits)
                s[none] = np.nan
                n = s.shape[1] - np.isnan(s).sum(1)
                its = np.where(is_there, s[row, column], np.nan)
                with np.errstate(invalid="ignore"):
                    ahead = ((s > its[:, None]) | ((s == its[:, None]) & before)).sum(1)
                missing = np.isnan(its)
                place = np.where(missing, np.inf if strict else n + 1, ahead + 1)
                used = n > 0
                first = used & (place <= 5)
                sums[:, i] += used.sum(), first.sum(), (1.0 / place[first]).sum()
        at = np.flatnonzero(sums[0])
        if len(at):
            yield pa.RecordBatch.from_pydict({"i": pa.array(at.astype(np.int32)), "n": pa.array(sums[0, at].astype(np.int64)), "hit": pa.array(sums[1, at]), "mrr": pa.array(sums[2, at])})

    got = rows.mapInArrow(run, "i int, n long, hit double, mrr double").groupBy("i").agg(F.sum("n").alias("questions"), F.sum("hit").alias("hit"), F.sum("mrr").alias("mrr"))
    names = rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(grid)], "i int, model string, a double, b double, c double")  # 35 rows
    found = got.join(F.broadcast(names), "i").select("model", "a", "b", "c", "questions", (F.col("hit") / F.col("questions")).alias("hit5"), (F.col("mrr") / F.col("questions")).alias("mrr5"))
    return evaluate.best_weights(found)
