"""Density areas: hierarchical density clustering (HDBSCAN, public algorithm of Campello,
Moulavi and Sander 2013), prediction for new points, and a grid of candidates.

A fit works on a sample of bounded size within one task, with memory linear in the points
(minimum spanning tree by Prim's method on mutual reachability); the candidates of a grid
are fitted in parallel, a task each. A point counts as its own first neighbour. Points are
radians; distances are kilometres on the sphere. Prediction follows the published rule: a
new point joins the tree beside its nearest neighbour by mutual reachability. Where it comes
in later than that neighbour left its branch, it belongs to the branch above that was there
already; its label is that of the chosen cluster which holds that branch, or noise. Labels
of other implementations may differ in details, as in how equal distances are ordered.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.functions.geo import EARTH_RADIUS_KM, OTHER_REGION, region_bucket
from tripforge.sources.scratch import delete


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between rows of (lat, lng) in radians."""
    lat, lng = b[:, 0] - a[:, None, 0], b[:, 1] - a[:, None, 1]
    x = np.sin(lat / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[:, 0]) * np.sin(lng / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, x)))


def vectors(points: np.ndarray) -> np.ndarray:
    """Unit vectors; the chord between two grows with their distance."""
    lat, lng = points[:, 0], points[:, 1]
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])


def core_distances(points: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Distance to the k-th neighbour. Blocks of close points meet only the points in the
    box around them that a first, too large, k-th distance allows."""
    n = len(points)
    k, out, v = min(k, n), np.empty(n), vectors(points)
    strips = max(1, int(np.sqrt(n / block)))
    strip = np.empty(n, int)
    strip[np.argsort(points[:, 0], kind="stable")] = np.arange(n) * strips // n
    order = np.lexsort((points[:, 1], strip))
    kth = lambda own, near: np.partition(distances(points[own], points[near]), k - 1, axis=1)[:, k - 1]
    for i in range(0, n, block):
        own = order[i : i + block]
        lo = max(0, min(i - block, n - k))
        far = kth(own, order[lo : max(i + 2 * block, lo + k)]).max()
        chord = 2 * np.sin(min(far / (2 * EARTH_RADIUS_KM), np.pi / 2)) * (1 + 1e-9) + 1e-12
        low, high = v[:, own].min(1) - chord, v[:, own].max(1) + chord
        near = np.flatnonzero(((v >= low[:, None]) & (v <= high[:, None])).all(0))
        for j in range(0, len(own), max(1, (1 << 23) // len(near))):
            part = own[j : j + max(1, (1 << 23) // len(near))]
            out[part] = kth(part, near)
    return out


def spanning_tree(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree, by weight. Prim's method on
    squared chords; points that are done leave the arrays when half of them are."""
    n = len(points)
    out = np.zeros((n - 1, 3))
    v, reach = vectors(points), (2 * np.sin(np.minimum(core / (2 * EARTH_RADIUS_KM), np.pi / 2))) ** 2
    own, best, via, at = np.arange(n), np.full(n, np.inf), np.zeros(n, int), 0
    done = np.zeros(n, bool)
    for i in range(n - 1):
        done[at], best[at] = True, np.inf
        here, which = v[:, at].copy(), own[at]
        if 2 * np.count_nonzero(done) > len(done) > 1024 and i % 512 == 0:
            own, best, via, reach_at = own[~done], best[~done], via[~done], reach[at]
            v, reach = v[:, ~done], reach[~done]
            done = np.zeros(len(own), bool)
        else:
            reach_at = reach[at]
        d = (v[0] - here[0]) ** 2 + (v[1] - here[1]) ** 2 + (v[2] - here[2]) ** 2
        np.maximum(d, reach, out=d)
        np.maximum(d, reach_at, out=d)
        closer = np.flatnonzero((d < best) & ~done)
        best[closer], via[closer] = d[closer], which
        at = int(best.argmin())
        out[i, :2] = via[at], own[at]
    a, b = out[:, 0].astype(int), out[:, 1].astype(int)
    for i in range(0, n - 1, 1 << 16):  # the exact weights
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        h = np.sin((points[y, 0] - points[x, 0]) / 2) ** 2 + np.cos(points[x, 0]) * np.cos(points[y, 0]) * np.sin((points[y, 1] - points[x, 1]) / 2) ** 2
        out[i : i + (1 << 16), 2] = np.maximum(np.maximum(2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h))), core[x]), core[y])
    return out[np.argsort(out[:, 2], kind="stable")]


def dendrogram(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single linkage: children (n - 1, 2), distance, size of each merge (nodes n ..)."""
    parent = list(range(2 * n - 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    child, size = np.zeros((n - 1, 2), int), np.ones(2 * n - 1, int)
    for i, (a, b, _) in enumerate(edges):
        x, y = root(int(a)), root(int(b))
        parent[x] = parent[y] = n + i
        child[i], size[n + i] = (x, y), size[x] + size[y]
    return child, edges[:, 2], size


@dataclass
class Clustering:
    points: np.ndarray
    core: np.ndarray
    labels: np.ndarray
    strengths: np.ndarray
    reach: np.ndarray  # of each cluster: the largest mutual reachability at which it holds
    branch: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # that each point left last
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and at what density (1 / km)
    #: Of each branch: the one above (-1 at the root), the density at which it began, and the
    #: cluster that holds it (-1 for none).
    above: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    began: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cluster: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def predict(self, points: np.ndarray, k: int, block: int = 256) -> np.ndarray:
        if not len(self.branch) or not len(points):
            return np.full(len(points), -1)
        near, reach = nearest_reach(points, self.points, self.core, k, block)
        density, at = 1 / np.maximum(reach, 1e-12), self.branch[near].copy()
        climbs = self.left[near] > density
        while (up := climbs & (self.above[at] >= 0) & (self.began[at] >= density)).any():
            at[up] = self.above[at[up]]
        return self.cluster[at]


def nearest_reach(points: np.ndarray, sample: np.ndarray, core: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the sample's nearest one by mutual reachability (the first of equals),
    and that reach; a point's own core distance is that to the k-th of the sample. Blocks of
    close points first bound both among the sample's points of like latitude, and then look
    only at those in the box around the block that the bound allows."""
    n, m = len(sample), len(points)
    k, v, w = min(k, n), vectors(sample), vectors(points)
    by_lat = np.argsort(sample[:, 0], kind="stable")
    strips = max(1, int(np.sqrt(m / block)))
    strip = np.empty(m, int)
    strip[np.argsort(points[:, 0], kind="stable")] = np.arange(m) * strips // m
    order = np.lexsort((points[:, 1], strip))
    found, reach = np.zeros(m, int), np.zeros(m)
    for i in range(0, m, block):
        own = order[i : i + block]
        lo, hi = np.searchsorted(sample[by_lat, 0], [points[own, 0].min(), points[own, 0].max()])
        lo, hi = max(0, lo - block - k), min(n, hi + block + k)
        rows = by_lat[lo:hi] if hi - lo <= 4096 + 2 * k else by_lat[lo:hi][:: max(1, (hi - lo) // (2048 + 2 * k))]
        d = distances(points[own], sample[rows])
        kth = np.partition(d, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1] if len(rows) >= k else np.full(len(own), np.pi * EARTH_RADIUS_KM)
        most = np.maximum(kth, np.maximum(np.maximum(d, kth[:, None]), core[rows]).min(1)).max()
        chord = 2 * np.sin(min(most / (2 * EARTH_RADIUS_KM), np.pi / 2)) * (1 + 1e-9) + 1e-12
        low, high = w[:, own].min(1) - chord, w[:, own].max(1) + chord
        near = np.flatnonzero(((v >= low[:, None]) & (v <= high[:, None])).all(0))
        for j in range(0, len(own), max(1, (1 << 22) // len(near))):
            part = own[j : j + max(1, (1 << 22) // len(near))]
            d = distances(points[part], sample[near])
            mine = np.partition(d, k - 1, axis=1)[:, k - 1]
            both = np.maximum(np.maximum(d, mine[:, None]), core[near])
            at = both.argmin(1)
            found[part], reach[part] = near[at], both[np.arange(len(part)), at]
    return found, reach


def fit(points: np.ndarray, min_cluster_size: int, min_samples: int, selection: str = "eom") -> Clustering:
    """selection: eom (excess of mass) or leaf. A cluster is never the whole tree."""
    n = len(points)
    if min_cluster_size < 2 or n < min_cluster_size:
        return Clustering(points, np.zeros(n), np.full(n, -1), np.zeros(n), np.zeros(0), np.zeros(n, int), np.zeros(n), np.full(1, -1), np.zeros(1), np.full(1, -1))
    core = core_distances(points, min_samples)
    child, dist, size = dendrogram(spanning_tree(points, core), n)
    lam = 1 / np.maximum(dist, 1e-12)
    # condensed tree: (parent, child or point, lambda, size); clusters are numbered from n
    rows, clusters, todo = [], [2 * n - 2], [(2 * n - 2, 0)]

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            stack.extend(child[x - n]) if x >= n else out.append(x)
        return out

    birth, up = {0: 0.0}, {0: -1}
    while todo:
        node, c = todo.pop()
        a, b = child[node - n]
        at = lam[node - n]
        big = [x for x in (a, b) if size[x] >= min_cluster_size]
        for x in (a, b):
            if size[x] < min_cluster_size:
                rows += [(c, p, at, 1) for p in leaves(x)]
        if len(big) == 2:
            for x in big:
                k = len(clusters)
                clusters.append(x)
                birth[k], up[k] = at, c
                rows.append((c, -k, at, size[x]))
                if x >= n:
                    todo.append((x, k))
        elif big and big[0] >= n:
            todo.append((big[0], c))
    stability = np.zeros(len(clusters))
    for c, _, at, s in rows:
        stability[c] += (at - birth[c]) * s
    kids: dict[int, list[int]] = {k: [] for k in up}
    for k, p in up.items():
        if p >= 0:
            kids[p].append(k)
    chosen, value = dict.fromkeys(up, False), stability.copy()
    for k in sorted(up, reverse=True):
        below = sum(value[j] for j in kids[k])
        if k and (not kids[k] or (selection == "eom" and stability[k] >= below)):
            chosen[k] = True
        else:
            value[k] = below
    final: dict[int, int] = {}
    for k in sorted(up):  # the topmost chosen one holds
        above = final.get(up[k], -1) if k else -1
        final[k] = above if above >= 0 else (k if chosen[k] else -1)
    names = {c: i for i, c in enumerate(sorted({c for c in final.values() if c >= 0}))}
    labels, strengths, most = np.full(n, -1), np.zeros(n), np.zeros(len(names))
    branch, left = np.zeros(n, int), np.zeros(n)
    for c, p, at, s in rows:
        if p < 0 or s > 1:
            continue
        branch[p], left[p] = c, at
        if final[c] >= 0:
            k = names[final[c]]
            labels[p], strengths[p] = k, at
            most[k] = max(most[k], at)
    member = labels >= 0
    strengths[member] = np.minimum(1, strengths[member] / np.maximum(most[labels[member]], 1e-12))
    reach = np.array([1 / max(birth[c], 1e-12) for c in sorted(names)])
    tree = [np.array([x[c] for c in sorted(up)]) for x in (up, birth, {c: names.get(final[c], -1) for c in up})]
    return Clustering(points, core, labels, strengths, reach, branch, left, *tree)


POINTS, REACH = "seq long, lat double, lng double, core double, label long, strength double, branch long, left double", "cluster int, reach double"
TREE = "branch long, above long, began double, cluster long"
GRID = "policy string, size int, min_cluster_size int, min_samples int, status string, clusters int, noise_ratio double, size_p50 double, size_p90 double, radius_p50_km double, radius_p90_km double, coverage map<string,double>, message string"


def metrics(points: np.ndarray, labels: np.ndarray, regions: np.ndarray | None = None) -> dict:
    """Clusters, noise, quantiles of cluster sizes and of their 90 percent radii (km), and,
    where regions are known, the share of each region's points in some cluster."""
    k = int(labels.max() + 1) if len(labels) else 0
    sizes = np.bincount(labels[labels >= 0], minlength=max(k, 1))
    radii = [float(np.quantile(distances(own, own.mean(0)[None]), 0.9)) for own in (points[labels == c] for c in range(k))]
    q = lambda x, p: float(np.quantile(x, p)) if len(x) else None
    held = None if regions is None else {str(r): float((labels[regions == r] >= 0).mean()) for r in sorted(set(regions))}
    return {"clusters": k, "noise_ratio": float((labels < 0).mean()), "size_p50": q(sizes, 0.5), "size_p90": q(sizes, 0.9), "radius_p50_km": q(radii, 0.5), "radius_p90_km": q(radii, 0.9), "coverage": held}


def policy_deltas(grid: DataFrame, base: str, other: str) -> DataFrame:
    """What the policy `other` changes against `base`, by size and parameters where both
    have been fitted: clusters, noise_ratio, and coverage by region."""
    keys, of = ["size", "min_cluster_size", "min_samples"], grid.where("status = 'ok'")
    side = lambda policy, tag: of.where(F.col("policy") == policy).select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in ("clusters", "noise_ratio", "coverage")])
    both = side(base, "a").join(side(other, "b"), keys)
    cover = F.map_zip_with("a_coverage", "b_coverage", lambda _, a, b: b - a)
    return both.select(*keys, (F.col("b_clusters") - F.col("a_clusters")).alias("clusters_delta"), (F.col("b_noise_ratio") - F.col("a_noise_ratio")).alias("noise_ratio_delta"), cover.alias("coverage_delta"))


def experiment(points: DataFrame, candidates: DataFrame, most: int | None = None) -> DataFrame:
    """points: policy, seq (sample order), lat, lng; candidates: policy, size,
    min_cluster_size, min_samples; points may have a region. A row per candidate; samples larger than the pool are
    skipped, and those above `most` if it is given; a failure doesn't stop the others."""
    large = F.lit(False) if most is None else F.col("size") > most
    sized = candidates.where(~large)
    rows = sized.join(points, "policy").where(F.col("seq") < F.col("size"))
    keys = ["policy", "size", "min_cluster_size", "min_samples"]
    measured = ["clusters", "noise_ratio", "size_p50", "size_p90", "radius_p50_km", "radius_p90_km", "coverage"]
    blank = dict.fromkeys(measured)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        try:
            if len(pdf) < head["size"]:
                return pd.DataFrame([head | {"status": "skipped"} | blank | {"message": "sample exceeds the pool"}])
            pdf = pdf.sort_values("seq")
            at = np.radians(pdf[["lat", "lng"]].to_numpy())
            labels = fit(at, int(head["min_cluster_size"]), int(head["min_samples"])).labels
            found = metrics(at, labels, pdf["region"].to_numpy() if "region" in pdf else None)
            return pd.DataFrame([head | {"status": "ok"} | found | {"message": None}])
        except Exception as x:  # a candidate's failure is its result
            return pd.DataFrame([head | {"status": "failed"} | blank | {"message": str(x)[:200]}])

    done = rows.groupBy(*keys).applyInPandas(run, GRID)
    types = dict(done.dtypes)
    skipped = candidates.join(done.select(*keys), keys, "left_anti")
    none = [F.lit(None).cast(types[c]).alias(c) for c in measured]
    return done.unionByName(skipped.select(*keys, F.lit("skipped").alias("status"), *none, F.when(large, "sample exceeds the limit").otherwise("sample exceeds the pool").alias("message")))


def save(spark: SparkSession, model: Clustering, path: str, contract: dict) -> None:
    """The model as tables; the contract, which makes it valid, comes last."""
    delete(spark, f"{path}/contract")
    rows = pd.DataFrame({"seq": np.arange(len(model.points)), "lat": model.points[:, 0], "lng": model.points[:, 1], "core": model.core, "label": model.labels, "strength": model.strengths, "branch": model.branch, "left": model.left})
    spark.createDataFrame(rows, POINTS).write.mode("overwrite").parquet(f"{path}/points")
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.reach)], REACH).write.mode("overwrite").parquet(f"{path}/reach")
    tree = [(i, int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(model.above, model.began, model.cluster, strict=True))]
    spark.createDataFrame(tree, TREE).write.mode("overwrite").parquet(f"{path}/tree")
    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "contract string").write.mode("overwrite").parquet(f"{path}/contract")


def load(spark: SparkSession, path: str, contract: dict) -> Clustering | None:
    """The stored model if it was made by the same contract, or None. Its points are the
    bounded sample that it was fitted on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/contract")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    kept = spark.read.schema("contract string").parquet(f"{path}/contract").first()
    if kept is None or kept.contract != json.dumps(contract, sort_keys=True):
        return None
    p = spark.read.schema(POINTS).parquet(f"{path}/points").orderBy("seq").toPandas()
    reach = spark.read.schema(REACH).parquet(f"{path}/reach").orderBy("cluster").toPandas()
    tree = spark.read.schema(TREE).parquet(f"{path}/tree").orderBy("branch").toPandas()
    return Clustering(p[["lat", "lng"]].to_numpy(), *(p[c].to_numpy() for c in ("core", "label", "strength")), reach["reach"].to_numpy(), p["branch"].to_numpy(), p["left"].to_numpy(), *(tree[c].to_numpy() for c in ("above", "began", "cluster")))


def fit_once(sample: DataFrame, path: str, contract: dict, min_cluster_size: int, min_samples: int) -> Clustering:
    """The stored model of the contract, or a new one of the sample (lat, lng, seq), stored.
    The contract has to name the sample (a digest) and what else the areas depend on; the
    parameters are added to it."""
    spark, full = sample.sparkSession, contract | {"min_cluster_size": min_cluster_size, "min_samples": min_samples}
    if (model := load(spark, path, full)) is None:
        model = fit(np.radians(sample.orderBy("seq").select("lat", "lng").toPandas().to_numpy()), min_cluster_size, min_samples)
        save(spark, model, path, full)
    return model


def assign(points: DataFrame, model: Clustering, min_samples: int, region: str = "Taipei", prefix: str = "area-") -> DataFrame:
    """points with lat, lng -> area_id, assignment (density or fallback), region. Points
    that the model leaves out, or outside the region, get their region's fallback area."""
    sent = points.sparkSession.sparkContext.broadcast(model)  # core points of a bounded sample

    @F.pandas_udf("long")
    def label(lat: pd.Series, lng: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.radians(np.c_[lat, lng]), min_samples))

    rows = points.withColumn("_label", label("lat", "lng")).withColumn("region", region_bucket(F.col("lat"), F.col("lng")))
    inside = (F.col("_label") >= 0) & (F.col("region") == region)
    fallback = F.concat(F.lit(f"{prefix}fallback-"), F.when(F.col("region") == OTHER_REGION, "other").otherwise(F.lower("region")))
    return rows.withColumn("area_id", F.when(inside, F.concat(F.lit(prefix), F.format_string("%04d", "_label"))).otherwise(fallback)).withColumn("assignment", F.when(inside, "density").otherwise("fallback")).drop("_label")


def assign_trips(trips: DataFrame, model: Clustering, min_samples: int, **more) -> DataFrame:
    """Both ends of trips in one pass over them: pickup_ and dropoff_ area_id, assignment and
    region, from pickup_lat, pickup_lng, dropoff_lat, dropoff_lng."""
    for side in ("pickup", "dropoff"):
        own = trips.withColumns({"lat": F.col(f"{side}_lat"), "lng": F.col(f"{side}_lng")})
        trips = assign(own, model, min_samples, **more).withColumnsRenamed({c: f"{side}_{c}" for c in ("area_id", "assignment", "region")}).drop("lat", "lng")
    return trips
