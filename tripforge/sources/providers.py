"""Places and routes of outside providers as tables. Off by default: without a key nothing
is asked, and every request stands as unanswered, for which the services have fallbacks.

Requests are rows, spread like any others; a task asks for its own, one after the other.
Bodies are built, and answers read, by Spark's JSON functions, so what a provider said is a
table (a text for each request) that can be stored and read again without asking. A
request is tried a second time after a timeout or an answer of 408, 429 or 5xx, but not
more often; whatever fails then is unanswered. Rows that a task asked for again after it
was lost are asked for again, so endpoints have to bear repeated questions.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripforge.functions.requests import open_status, route_km, route_minutes

#: The widest circle in metres, places of an answer, and what is asked for.
WIDEST, PLACES = 50_000, 15
PLACE_FIELDS = "places.id,places.displayName,places.location,places.rating,places.userRatingCount,places.priceLevel,places.primaryType,places.formattedAddress,places.currentOpeningHours.openNow"
MATRIX_FIELDS = "originIndex,destinationIndex,duration,distanceMeters,status,condition"
ANSWER = "places array<struct<id:string,displayName:struct<text:string>,location:struct<latitude:double,longitude:double>,rating:double,userRatingCount:long,priceLevel:string,primaryType:string,formattedAddress:string,currentOpeningHours:struct<openNow:boolean>>>"
MATRIX = "array<struct<destinationIndex:int,condition:string,status:map<string,string>,distanceMeters:string,duration:string>>"
ROUTE = "routes array<struct<distanceMeters:string,duration:string>>"


def place_body(lat: Column, lng: Column, radius_m: Column) -> Column:
    """The question for restaurants in a circle, of which the radius is kept in bounds."""
    centre = F.struct(lat.alias("latitude"), lng.alias("longitude"))
    circle = F.struct(centre.alias("center"), F.least(F.greatest(radius_m, F.lit(1)), F.lit(WIDEST)).alias("radius"))
    return F.to_json(F.struct(F.array(F.lit("restaurant")).alias("includedTypes"), F.lit(PLACES).alias("maxResultCount"), F.lit("DISTANCE").alias("rankPreference"), F.struct(circle.alias("circle")).alias("locationRestriction")))


def matrix_body(origin: tuple[Column, Column], destinations: Column) -> Column:
    """The question for the routes from one origin. destinations: array of structs lat, lng."""
    way = lambda lat, lng: F.struct(F.struct(F.struct(F.struct(lat.alias("latitude"), lng.alias("longitude")).alias("latLng")).alias("location")).alias("waypoint"))
    return F.to_json(F.struct(F.array(way(*origin)).alias("origins"), F.transform(destinations, lambda d: way(d["lat"], d["lng"])).alias("destinations"), F.lit("DRIVE").alias("travelMode"), F.lit("TRAFFIC_AWARE").alias("routingPreference"), F.lit("METRIC").alias("units")))


def post(url: str, body: str, headers: dict[str, str], timeout: float) -> str | None:
    """The text of a good answer, or None."""
    for attempt in range(2):
        try:
            call = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(call, timeout=timeout) as got:
                return got.read().decode()
        except urllib.error.HTTPError as x:
            again = x.code in (408, 429) or x.code >= 500
        except TimeoutError:
            again = True
        except urllib.error.URLError as x:
            again = isinstance(x.reason, TimeoutError)
        except (OSError, ValueError):
            again = False
        if not again or attempt:
            return None
        time.sleep(random.uniform(0.01, 0.03))
    return None


def ask(requests: DataFrame, url: str, key: str | None, fields: str, key_header: str = "X-Api-Key", fields_header: str = "X-FieldMask", timeout: float = 2.5) -> DataFrame:
    """requests: body and others -> with answer instead of body; null where there is none."""
    if not key:
        return requests.withColumn("answer", F.lit(None).cast("string")).drop("body")
    kept = [c for c in requests.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [None if b is None else post(url, b, {key_header: key, fields_header: fields}, timeout) for b in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(said, pa.string())], [*kept, "answer"])

    return requests.mapInArrow(run, requests.drop("body").withColumn("answer", F.lit(None).cast("string")).schema)


def places(answers: DataFrame, by: list[str]) -> DataFrame:
    """by (a request's key), seq (order in the answer, from 0), place_id, name, lat, lng and
    more: places with an id, a name and a place, each once in an answer."""
    rows = answers.select(*by, F.posexplode(F.from_json("answer", ANSWER)["places"]).alias("seq", "p"))
    p = F.col("p")
    rows = rows.select(
        *by, "seq", p["id"].alias("place_id"), p["displayName"]["text"].alias("name"), p["location"]["latitude"].alias("lat"), p["location"]["longitude"].alias("lng"), p["rating"].alias("rating"),
        p["userRatingCount"].alias("review_count"), p["priceLevel"].alias("price_level"), p["primaryType"].alias("primary_type"), p["formattedAddress"].alias("formatted_address"), open_status(p["currentOpeningHours"]["openNow"]).alias("open_status"),
    )
    rows = rows.where("length(place_id) > 0 AND length(name) > 0 AND lat IS NOT NULL AND lng IS NOT NULL")
    first = Window.partitionBy(*by, "place_id").orderBy("seq")
    return rows.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn")


def matrix_routes(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, slot (of the destination, from 1), condition, status, km, minutes: as
    `serve.with_routes` takes them; of several for a slot the last."""
    rows = answers.select(*by, F.posexplode(F.from_json("answer", MATRIX)).alias("pos", "r"))
    r = F.col("r")
    rows = rows.select(*by, "pos", (r["destinationIndex"] + 1).alias("slot"), r["condition"].alias("condition"), F.when(r["status"].isNotNull(), "ok").alias("status"), route_km(r["distanceMeters"]).alias("km"), route_minutes(r["duration"]).alias("minutes"))
    good = (F.col("condition") == "ROUTE_EXISTS") & F.col("status").isNotNull()
    rows = rows.where(good & F.col("slot").isNotNull() & F.col("km").isNotNull() & F.col("minutes").isNotNull())
    last = Window.partitionBy(*by, "slot").orderBy(F.desc("pos"))
    return rows.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn", "pos")


def single_route(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, km, minutes of the first route; null where the answer has none."""
    r = F.get(F.from_json("answer", ROUTE)["routes"], F.lit(0))
    km, minutes = route_km(r["distanceMeters"]), route_minutes(r["duration"])
    both = km.isNotNull() & minutes.isNotNull()
    return answers.select(*by, F.when(both, km).alias("km"), F.when(both, minutes).alias("minutes"))


def unanswered(answers: DataFrame, by: list[str], warning: str) -> DataFrame:
    """by, seq, warning: for requests without an answer, as `service.warnings` takes them."""
    return answers.where("answer IS NULL").select(*by, F.lit(0).alias("seq"), F.lit(warning).alias("warning"))
