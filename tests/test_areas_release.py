import numpy as np
import pytest

from tripforge import config
from tripforge.operators import density, release


def blobs(seed=0, n=60):
    r = np.random.default_rng(seed)
    centres = np.array([[25.03, 121.5], [25.08, 121.56], [25.01, 121.45]])
    return np.concatenate([c + r.normal(0, 0.002, (n, 2)) for c in centres] + [r.uniform([24.9, 121.3], [25.2, 121.7], (15, 2))])


def test_clusters_of_blobs():
    p = np.radians(blobs())
    c = density.fit(p, 20, 5)
    assert len(c.reach) == 3
    groups = [set(c.labels[i * 60 : (i + 1) * 60]) - {-1} for i in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert (c.labels[180:] == -1).mean() > 0.7
    same = c.predict(p, 5)
    assert (same == c.labels)[c.labels >= 0].mean() > 0.95
    assert c.predict(np.radians([[24.0, 120.0]]), 5)[0] == -1


def test_spanning_tree_against_brute_force():
    p = np.radians(blobs(1, 8))
    core = density.core_distances(p, 3)
    d = np.maximum(np.maximum(density.distances(p, p), core[:, None]), core[None, :])
    assert np.allclose(core, np.sort(density.distances(p, p), 1)[:, 2])
    edges = sorted((d[i, j], i, j) for i in range(len(p)) for j in range(i))
    parent, total = list(range(len(p))), 0.0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, i, j in edges:
        if root(i) != root(j):
            parent[root(i)] = root(j)
            total += w
    assert density.spanning_tree(p, core)[:, 2].sum() == pytest.approx(total)


def test_too_few_points():
    assert (density.fit(np.radians(blobs()[:3]), 5, 2).labels == -1).all()


def test_grid_goes_on_after_skips(spark):
    pts = blobs()
    points = spark.createDataFrame([("all", i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "policy string, seq int, lat double, lng double")
    grid = spark.createDataFrame([("all", 150, 20, 5), ("all", 10**6, 20, 5), ("all", 500, 20, 5)], "policy string, size int, min_cluster_size int, min_samples int")
    got = {r["size"]: r for r in density.experiment(points, grid, most=1000).collect()}
    assert got[150].status == "ok" and got[150].clusters >= 2 and got[500].status == "skipped" and got[10**6].status == "skipped"


def test_grid_skips_only_what_exceeds_the_pool(spark):
    r = np.random.default_rng(3)
    pts = np.concatenate([c + r.normal(0, 0.004, (7000, 2)) for c in ([25.03, 121.5], [25.08, 121.56], [25.01, 121.45])])
    points = spark.createDataFrame([("all", i, float(a), float(b)) for i, (a, b) in enumerate(r.permutation(pts))], "policy string, seq int, lat double, lng double")
    grid = spark.createDataFrame([("all", 21_000, 500, 5), ("all", 21_001, 500, 5), ("none", 10, 5, 2)], "policy string, size int, min_cluster_size int, min_samples int")
    got = {x["size"]: x for x in density.experiment(points, grid).collect()}
    assert got[21_000].status == "ok" and got[21_000].clusters == 3
    assert {got[k].status for k in (10, 21_001)} == {"skipped"} and {got[k].message for k in (10, 21_001)} == {"sample exceeds the pool"}
    assert density.experiment(points, grid.where("size = 21000"), most=5).first().message == "sample exceeds the limit"


@pytest.mark.parametrize("where", ["city", "sphere"])
def test_boxes_and_tree_against_brute_force(where):
    r = np.random.default_rng(5)
    p = np.radians(np.concatenate([blobs(2, 900), blobs(2, 40)]) if where == "city" else r.uniform([-90, -180], [90, 180], (2500, 2)))
    d = density.distances(p, p)
    core = density.core_distances(p, 7)
    assert np.allclose(core, np.sort(d, 1)[:, 6])
    m, free, total, best = np.maximum(np.maximum(d, core[:, None]), core[None, :]), np.ones(len(p), bool), 0.0, np.full(len(p), np.inf)
    at = 0
    for _ in range(len(p) - 1):
        free[at] = False
        best = np.minimum(best, m[at])
        at = int(np.where(free, best, np.inf).argmin())
        total += best[at]
    assert density.spanning_tree(p, core)[:, 2].sum() == pytest.approx(total)


def test_assignment_falls_back(spark):
    c = density.fit(np.radians(blobs()), 20, 5)
    rows = spark.createDataFrame([(25.03, 121.5), (25.3, 121.9), (24.0, 120.5), (0.0, 0.0)], "lat double, lng double")
    got = [(r.area_id, r.assignment) for r in density.assign(rows, c, 5).collect()]
    assert got[0][1] == "density" and got[1:] == [("area-fallback-taipei", "fallback"), ("area-fallback-taichung", "fallback"), ("area-fallback-other", "fallback")]


def test_load_is_idempotent(spark, tmp_path):
    version = release.version_of("ab" * 32)
    areas = spark.createDataFrame([(1, "x")], "area_id long, name string")
    assert release.load(spark, str(tmp_path), version, "ab" * 32, {"areas": areas})
    assert not release.load(spark, str(tmp_path), version, "ab" * 32, {"areas": areas})
    assert release.read(spark, str(tmp_path), "areas", version).count() == 1
    assert release.latest(spark.read.parquet(f"{tmp_path}/model_releases")).first().model_version == version


def test_nulls_are_filled(spark):
    old = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    new = spark.createDataFrame([(1, 7), (2, 9), (3, 1)], "k long, v long")
    assert sorted(map(tuple, release.filled(old, new, ["k"], ["v"]).collect())) == [(1, 7), (2, 5)]
    assert [r.k for r in release.new_rows(new, old, ["k"]).collect()] == [3]


def test_personas_take_the_largest_key(spark):
    p = spark.createDataFrame([("rider_a", "full", 50), ("rider_b", "full", 12), ("rider_c", "light", 4)], "rider_key string, level string, trip_count long")
    got = {r.alias: (r.rider_key, r.trip_count) for r in release.personas(p).collect()}
    assert got == {"demo_rider_full": ("rider_b", 12), "demo_rider_light": ("rider_c", 4), "demo_rider_cold": (None, 0)}


def test_model_selection():
    row = lambda m, h, r: {"model": m, "hit5": h, "mrr5": r}
    base = [row("global_popularity", 0.2, 0.1), row("origin_period", 0.3, 0.2), row("area_a", 0.1, 0.1), row("area_a_plus_b", 0.9, 0.9)]
    got = release.select_model([*base, row("area_a_plus_c", 0.4, 0.3), row("area_a_plus_b_plus_c", 0.4, 0.2)])
    assert got == {"selected_model": "area_a_plus_c", "b_enabled": False, "personalization_beats_origin": True}
    assert release.select_model([*base, row("area_a_plus_c", 0.4, 0.3), row("area_a_plus_b_plus_c", 0.4, 0.31)])["selected_model"] == "area_a_plus_b"


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert release.content_digest(a).first() == release.content_digest(a.orderBy("a", ascending=False)).first()


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nRAW_DATA_PATH='x.csv'\n")
    (tmp_path / "x.csv").write_text("1")
    monkeypatch.delenv("RAW_DATA_PATH", raising=False)
    assert config.choose_input(tmp_path).name == "x.csv"
    (tmp_path / "e").write_text("# A=1\nB = 'two words'\nC=\"x\"\nD=\nno setting\n")
    assert config.env_file(tmp_path / "e") == {"B": "two words", "C": "x", "D": ""} and config.env_file(tmp_path / "none") == {}
    m = config.manifest([tmp_path / "x.csv"], {}, {})
    assert not config.matches(tmp_path / "m.json", m)
    config.write_json(tmp_path / "m.json", m)
    assert config.matches(tmp_path / "m.json", m)
    with pytest.raises(ValueError):
        config.matches(tmp_path / "m.json", m | {"inputs": {}})
    with pytest.raises(ValueError):
        config.validate_feedback("rec_1", "p", "impression")
    config.validate_feedback("rec_" + "0" * 16, "p", "impression")


def test_tuning_sample(spark):
    import hashlib

    from tripforge.operators.evaluate import in_tuning_sample

    got = spark.range(200).where(in_tuning_sample("id")).collect()
    assert [r.id for r in got] == [i for i in range(200) if int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=4).digest(), "big") % 8 == 0]


def test_a_broken_load_is_replaced_and_a_known_version_filled(spark, tmp_path):
    version, root = release.version_of("cd" * 32), str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "area_id int, x string")
    rows((1, "half")).write.parquet(f"{root}/areas/model_version={version}")  # what a load left that broke off
    assert release.load(spark, root, version, "cd" * 32, {"areas": rows((1, "a"), (2, None))})
    assert sorted((r.area_id, r.x) for r in release.read(spark, root, "areas", version).collect()) == [(1, "a"), (2, None)]
    assert not release.load(spark, root, version, "cd" * 32, {"areas": rows((1, "z"), (2, "b"))}, {"areas": ["area_id"]})
    assert sorted((r.area_id, r.x) for r in release.read(spark, root, "areas", version).collect()) == [(1, "a"), (2, "b")]


def test_a_load_that_stops_anywhere_leaves_the_old_state(spark, tmp_path, monkeypatch):
    version, root = release.version_of("ef" * 32), str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "area_id int, x string")
    tables = lambda v: {"areas": rows((1, v), (2, None)), "stats": rows((7, v))}
    keys = {"areas": ["area_id"], "stats": ["area_id"]}
    state = lambda: [sorted((r.area_id, r.x) for r in release.read(spark, root, t, version).collect()) for t in ("areas", "stats")]
    assert release.load(spark, root, version, "ef" * 32, {"areas": rows((1, None), (2, None)), "stats": rows((7, None))}, keys)
    real, old = release._staged, state()
    for stop in range(3):
        calls = iter(range(9))

        def staged(df, *where, stop=stop, calls=calls):
            if next(calls) == stop:
                raise RuntimeError("power cut")
            out = real(df, *where)
            return out

        def no_row(*a, **k):
            raise RuntimeError("power cut")

        monkeypatch.setattr(release, "_staged", staged)
        if stop == 2:  # both tables are written, the row isn't
            monkeypatch.setattr(release.F, "current_timestamp", no_row)
        with pytest.raises(RuntimeError):
            release.load(spark, root, version, "ef" * 32, tables("a"), keys)
        monkeypatch.undo()
        assert state() == old
    assert not release.load(spark, root, version, "ef" * 32, tables("a"), keys)
    assert state() == [[(1, "a"), (2, None)], [(7, "a")]]
    assert not release.load(spark, root, version, "ef" * 32, {**tables("b"), "fares": rows((5, "f"))}, {})
    assert state()[0] == [(1, "a"), (2, None)] and release.read(spark, root, "fares", version).count() == 1


def test_reports_are_checked_before_a_load(spark, tmp_path):
    report = {"scope": "demo", "locked_config": {"selected_model": "area_a_plus_c", "weights": {"area_a_plus_c": [0.3, 0.7]}}, "n": 1.5, "text": "é"}
    report["report_hash"] = release.report_digest(report)
    areas = {"areas": spark.createDataFrame([(1,)], "area_id int")}
    bad = [({"scope": "all"}, "WRONG_SCOPE"), ({"locked_config": {"selected_model": "area_a"}}, "WRONG_MODEL"), ({"n": 2}, "WRONG_HASH")]
    for change, code in bad:
        with pytest.raises(release.ServiceError) as x:
            release.load_report(spark, str(tmp_path), report | change, areas)
        assert x.value.code == code
    with pytest.raises(release.ServiceError):
        release.load_report(spark, str(tmp_path), report, areas, fares={"artifact_type": "train_fare_estimates", "split": "test"})
    version, new = release.load_report(spark, str(tmp_path), report, areas, fares={"artifact_type": "train_fare_estimates", "split": "train"})
    row = release.releases(spark, str(tmp_path)).first()
    assert new and row.model_version == version == "trip-serving-v1-" + report["report_hash"][:16]
    assert row.selected_model == "area_a_plus_c" and '"weights": [0.3, 0.7]' in row.serving_config_json
    with pytest.raises(release.ServiceError):
        release.read(spark, str(tmp_path), "none", version)


def test_a_batch_is_there_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root, kind = str(tmp_path), "request_id string, n int"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    assert release.appended(spark, root, "items", kind).count() == 0
    assert release.append(spark, root, {"requests": rows(("a", 1)), "items": rows(("a", 1), ("a", 2))}, "first")
    assert not release.append(spark, root, {"requests": rows(("a", 1)), "items": rows(("a", 1))}, "first")
    real = release._staged

    def staged(df, root, name, part):
        if name == "items":
            raise RuntimeError("power cut")
        return real(df, root, name, part)

    monkeypatch.setattr(release, "_staged", staged)
    with pytest.raises(RuntimeError):
        release.append(spark, root, {"requests": rows(("b", 1)), "items": rows(("b", 1))}, "second")
    monkeypatch.undo()
    assert [r.request_id for r in release.appended(spark, root, "requests", kind).collect()] == ["a"]
    assert release.append(spark, root, {"requests": rows(("b", 1)), "items": rows(("b", 1))}, "second")
    assert release.appended(spark, root, "requests", kind).count() == 2 and release.appended(spark, root, "items", kind).count() == 3


def test_prediction_walks_up_the_tree():
    r = np.random.default_rng(3)
    at = np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (((25.0, 121.5), 0.01, 150), ((25.02, 121.53), 0.004, 80), ((25.3, 121.9), 0.02, 120), ((24.9, 121.2), 0.2, 100))])
    new = np.concatenate([at[::3] + r.normal(0, 0.003, at[::3].shape), r.uniform((24.5, 121.0), (25.6, 122.2), (150, 2)), [[-30.0, 10.0]]])
    for size, k, selection in ((15, 5, "eom"), (15, 5, "leaf"), (40, 10, "eom")):
        c = density.fit(np.radians(at), size, k, selection)
        got = c.predict(np.radians(new), k, block=16)
        d = density.distances(np.radians(new), np.radians(at))
        for i in range(len(new)):
            own = np.sort(d[i])[k - 1]
            reach = np.maximum(np.maximum(d[i], own), c.core)
            near = int(reach.argmin())
            branch, density_ = int(c.branch[near]), 1 / reach[near]
            if c.left[near] > density_:
                while c.above[branch] >= 0 and c.began[branch] >= density_:
                    branch = int(c.above[branch])
            assert got[i] == c.cluster[branch]
        assert len(set(got)) > 2 and got[-1] == -1
        assert all(c.labels[p] == c.cluster[c.branch[p]] for p in range(len(at)))


def test_prediction_of_nothing():
    c = density.fit(np.radians([[25.0, 121.5]]), 5, 2)
    assert c.predict(np.radians([[25.0, 121.5]]), 2).tolist() == [-1] and c.predict(np.zeros((0, 2)), 2).tolist() == []
