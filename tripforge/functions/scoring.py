"""Scores of areas, riders and places, as column expressions. Division is guarded
throughout, as ANSI mode raises on a zero divisor."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

A_WEIGHTS = {"visit_heat": 0.30, "period_lift": 0.25, "cross_area_ratio": 0.15, "source_diversity": 0.15, "return_rate": 0.15}


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def robust_minmax(x: Column, p5: Column, p95: Column) -> Column:
    return F.when(F.abs(p95 - p5) <= 1e-12, 0.0).otherwise(clip(F.try_divide(x - p5, p95 - p5)))


def distance_bin(km: Column) -> Column:
    return F.when(km < 2.0, "0-2").when(km < 5.0, "2-5").when(km < 10.0, "5-10").otherwise("10+")


def personalization_level(trips: Column, full: int = 10, light: int = 3) -> Column:
    return F.when(trips >= full, "full").when(trips >= light, "light").otherwise("cold")


def rider_key(rider_id: Column, salt: str) -> Column:
    """HMAC-SHA256 of the id as text: two nested hashes over the padded key, no UDF."""
    if not salt:
        raise ValueError("a salt must be configured")
    raw = salt.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    message = F.encode(rider_id.cast("long").cast("string"), "UTF-8")
    return F.concat(F.lit("rider_"), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def event_id(request_id: Column, place_key: Column, action: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", request_id, place_key, action), 256), 1, 32))


def _piecewise(d: Column, p25: Column, p75: Column, p90: Column, below: Column, shoulder: Column, beyond: Column) -> Column:
    return F.when(d < p25, clip(below)).when(d <= p75, 1.0).when(d <= p90, shoulder).otherwise(clip(beyond))


def distance_fit(d: Column, p25: Column, p75: Column, p90: Column) -> Column:
    """The scalar form: percentiles are floored."""
    d, p25 = F.greatest(d, F.lit(0.0)), F.greatest(p25, F.lit(0.1))
    p75 = F.greatest(p75, p25)
    p90 = F.greatest(p90, p75 + 0.1)
    return _piecewise(d, p25, p75, p90, 0.35 + 0.65 * F.try_divide(d, p25), 1.0 - 0.35 * F.try_divide(d - p75, p90 - p75), 0.65 * F.exp(-F.try_divide(d - p90, p90)))


def distance_fit_batch(d: Column, p25: Column, p75: Column, p90: Column) -> Column:
    """The form that evaluation uses: raw percentiles."""
    return _piecewise(d, p25, p75, p90, 0.35 + 0.65 * F.try_divide(d, p25), 1.0 - 0.35 * F.try_divide(d - p75, p90 - p75), 0.65 * F.exp(-F.try_divide(d - p90, p90)))


def distance_fit_serving(d: Column, p25: Column, p75: Column, p90: Column) -> Column:
    """The form that requests use: divisors are floored at 0.01."""
    least = lambda x: F.greatest(x, F.lit(0.01))
    shoulder = F.greatest(F.lit(0.0), 1.0 - 0.35 * (d - p75) / least(p90 - p75))
    return _piecewise(d, p25, p75, p90, 0.35 + 0.65 * d / least(p25), shoulder, 0.65 * F.exp(-(d - p90) / least(p90)))


def habits(period_ratio: Column, weekend_ratio: Column, trips: Column, day: Column) -> tuple[Column, Column]:
    """Of the time of day and of the weekday."""
    of_day = F.when(day == "weekend", weekend_ratio).otherwise(1.0 - weekend_ratio)
    return (period_ratio * trips + 1.0) / (trips + 5.0), (of_day * trips + 1.0) / (trips + 2.0)


def mobility_score(fit: Column, period_ratio: Column, weekend_ratio: Column, trips: Column, day: Column, visits: Column, most_visits: Column) -> Column:
    """C: distance, habit of time and weekday, affinity to the area."""
    habit, weekday_fit = habits(period_ratio, weekend_ratio, trips, day)
    affinity = F.when(most_visits > 0, F.try_divide(F.log1p(visits.cast("double")), F.log1p(most_visits.cast("double")))).otherwise(0.0)
    return clip(0.50 * fit + 0.20 * habit + 0.15 * weekday_fit + 0.15 * affinity)


def combine(*parts: tuple[float | Column, Column]) -> Column:
    """Weighted mean over the components that aren't null; null if none is there."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, x in parts:
        total += F.when(x.isNotNull(), num(w) * x).otherwise(0.0)
        weight += F.when(x.isNotNull(), num(w)).otherwise(0.0)
    return F.try_divide(total, weight)


def distance_budget_km(level: Column, median_km: Column, cold: float = 8.0, least: float = 6.0, most: float = 10.0) -> Column:
    usable = level.isNotNull() & (level != "cold") & (median_km > 0)
    return F.when(usable, F.bround(F.least(F.lit(most), F.greatest(F.lit(least), 1.5 * median_km)), 3)).otherwise(cold)


def proximity_fit(km: Column, budget: Column) -> Column:
    slope = F.bround(F.greatest(F.lit(0.15), 0.85 - 0.70 * F.try_divide(km - 3.0, budget - 3.0)), 6)
    return F.when(km <= 3.0, 1.0).when((budget <= 3.0) | (km >= budget), 0.15).otherwise(slope)


def area_blend(base: Column, proximity: Column, weight: float = 0.20) -> Column:
    return F.when(proximity.isNull(), base).otherwise((1.0 - weight) * base + weight * proximity)


def contextual_fit(minutes: Column, km: Column, typical_minutes: Column, p90_km: Column, light_p90: Column) -> tuple[Column, Column, Column]:
    """(fit, time fit, ride worthiness) of a route."""
    typical = F.when(typical_minutes > 0, typical_minutes).otherwise(20.0)
    over = minutes - typical
    time = F.when(minutes <= typical, 1.0).when(minutes <= typical * 1.5, 1.0 - 0.35 * over / F.greatest(typical * 0.5, F.lit(1.0))).otherwise(0.65 * F.exp(-(minutes - typical * 1.5) / F.greatest(typical, F.lit(1.0))))
    liked = F.when(p90_km > 0, p90_km).otherwise(F.coalesce(light_p90, F.lit(10.0)))
    near = F.least(F.lit(10.0), liked)
    worth = F.when(km < 1.0, 0.10 + 0.45 * km).when(km <= near, 1.0).otherwise(F.exp(-(km - near) / F.greatest(liked, F.lit(1.0))))
    time, worth = F.bround(clip(time), 6), F.bround(clip(worth), 6)
    return F.bround(0.60 * time + 0.40 * worth, 6), time, worth


def poi_quality(rating: Column, reviews: Column, most_reviews: Column) -> Column:
    confidence = F.when((most_reviews > 0) & reviews.isNotNull(), clip(F.try_divide(F.log1p(F.greatest(reviews, F.lit(0)).cast("double")), F.log1p(most_reviews.cast("double")))))
    return F.bround(combine((0.70, clip(rating / 5.0)), (0.30, confidence)), 6)


def restaurant_score(area: Column, context: Column, quality: Column) -> Column:
    return F.round(combine((0.60, area), (0.20, context), (0.20, quality)), 6)


def explanation(period: Column, mobility: Column) -> Column:
    reason = F.when(mobility.isNull(), "popular nearby").when(mobility >= 0.7, "close to your habits").otherwise("a change from your habits")
    return F.substring(F.concat(F.lit("For "), period, F.lit(": "), reason), 1, 60)
