"""What requests and providers send, read as column expressions: times with their own
offset, checks of a request's fields, settings from JSON, durations and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripforge.config import ACTIONS, ALIAS, REQUEST
from tripforge.functions.calendar import serving_period_of_hour

#: A date, a time, and an offset, which a request has to have.
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})$"
#: Where locations may be, lengths of names, and weights by default.
LATITUDES, LONGITUDES, NAMES = (24.8, 25.4), (121.3, 122.1), (1, 80)
WEIGHTS = {"a": 0.30, "c": 0.70}
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def own_time(text: Column) -> Column:
    """struct(at, day, hour, offset_min): the instant, and the date and hour on the clock of
    the text's own offset; null without an offset, or if there is no such time. Neither the
    date nor the hour depends on the session's zone."""
    date, clock = F.substring(text, 1, 10), F.substring(text, 12, 5)
    zone = F.regexp_replace(F.regexp_extract(text, r"([Zz]|[+-]\d{2}:?\d{2})$", 1), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(F.upper(zone) == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    day = F.try_to_date(date, "yyyy-MM-dd")
    hour, minute = F.substring(clock, 1, 2).try_cast("int"), F.substring(clock, 4, 2).try_cast("int")
    rest = F.coalesce(F.regexp_extract(text, r"^.{16}:(\d{2}(?:\.\d{1,6})?)", 1).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    real = text.rlike(STAMP) & day.isNotNull() & (hour < 24) & (minute < 60) & (rest < 60) & (F.abs(minutes) < 1440)
    micros = (F.unix_date(day).cast("long") * 86_400 + (hour * 60 + minute - minutes) * 60).cast("long") * 1_000_000 + (rest * 1_000_000).cast("long")
    return F.when(real, F.struct(F.timestamp_micros(micros).alias("at"), day.alias("day"), hour.alias("hour"), minutes.alias("offset_min")))


def own_context(time: Column) -> tuple[Column, Column]:
    """(period, weekday class) of an `own_time`, on its own clock."""
    day = F.when(F.weekday(time["day"]) < 5, "weekday").when(time["day"].isNotNull(), "weekend")
    return F.when(time["hour"].isNotNull(), serving_period_of_hour(time["hour"])), day


def _listed(checks: dict[str, Column]) -> Column:
    """The names of what isn't right, in order; null counts as wrong."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def location_checks(name: Column, lat: Column, lng: Column, prefix: str = "location") -> dict[str, Column]:
    return {f"{prefix}.name": F.length(name).between(*NAMES), f"{prefix}.latitude": lat.between(*LATITUDES), f"{prefix}.longitude": lng.between(*LONGITUDES)}


def recommendation_errors(alias: Column, name: Column, lat: Column, lng: Column, time: Column) -> Column:
    """Fields of a recommendation request that its contract rejects; time as text."""
    return _listed({"rider_alias": alias.rlike(f"^{ALIAS.pattern}$"), **location_checks(name, lat, lng), "datetime": own_time(time).isNotNull()})


def ride_errors(request_id: Column, place_key: Column, origin: tuple[Column, Column, Column], destination: tuple[Column, Column, Column], time: Column) -> Column:
    """Likewise of a ride estimate; places as name, lat, lng."""
    ends = {**location_checks(*origin, "origin"), **location_checks(*destination, "destination")}
    return _listed({"request_id": request_id.rlike(f"^{REQUEST.pattern}$"), "place_key": F.length(place_key).between(*NAMES), **ends, "datetime": own_time(time).isNotNull()})


def feedback_errors(request_id: Column, place_key: Column, action: Column) -> Column:
    return _listed({"request_id": request_id.rlike(f"^{REQUEST.pattern}$"), "place_key": F.length(place_key).between(*NAMES), "action": action.isin(*ACTIONS)})


def serving_config(text: Column) -> Column:
    """struct(weights: map, cohort: map) of a release's settings. Text that is no JSON object
    has no settings: both are empty, as where one is missing. Weights that are there but are
    no object are the default ones; such a cohort is empty."""
    whole = F.try_parse_json(text)
    field = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    told = lambda name: F.try_variant_get(whole, f"$.{name}", "map<string,variant>")
    number = lambda m: F.map_filter(F.transform_values(m, lambda _, v: F.try_variant_get(v, "$", "double")), lambda _, v: v.isNotNull())
    none = F.create_map().cast("map<string,double>")
    default = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.struct(
        F.when(field("weights").isNull(), none).when(told("weights").isNull(), default).otherwise(number(told("weights"))).alias("weights"),
        F.when(told("cohort_distance_reference").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.transform_values(told("cohort_distance_reference"), lambda _, v: F.to_json(v))).alias("cohort"),
    )


def weight(config: Column, name: str) -> Column:
    """A weight of a `serving_config`, by default if it isn't there."""
    return F.coalesce(F.try_element_at(config["weights"], F.lit(name)), F.lit(WEIGHTS[name]))


def duration_seconds(text: Column) -> Column:
    """Seconds of a text like 600s or 12.5s, rounded half to even; null if it is none."""
    bare = F.regexp_replace(text, "s+$", "")
    return F.when(bare.rlike(_NUMBER), F.bround(F.trim(bare).try_cast("double"), 0).cast("long"))


def route_minutes(duration: Column) -> Column:
    """Whole minutes, at least one; null without a duration."""
    seconds = duration_seconds(duration)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(1).cast("long"), F.bround(seconds / F.lit(60.0), 0).cast("long")))


def route_km(metres: Column) -> Column:
    return F.bround(metres.try_cast("double") / F.lit(1000.0), 2)


def open_status(now: Column) -> Column:
    """open, closed, or unknown where it isn't told."""
    return F.when(now, "open").when(~now, "closed").otherwise("unknown")
