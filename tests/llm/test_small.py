"""Each operator on small tables: brute force, nulls, empty tables, repeated rows, extra
columns with clashing names."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripforge.llm import ctw, decontaminate, exact_dedup, html_extract, langid, mixing, near_join, repeats, toxicity, warc
from tripforge.llm.textvec import word_list

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _uid long, size long"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); with extra columns that operators use too."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, 7, 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "a  b"), (4, "a  b"), (5, "x" * 5000), (6, "ä\x00ö 　")]


@pytest.fixture(params=["odd", "empty"])
def strange(request, spark):
    return docs(spark, ODD if request.param == "odd" else [])


def by_id(rows):
    return {r.doc_id: r for r in rows}


# exact dedup


def test_exact_groups(spark, strange):
    got = exact_dedup.groups(strange).collect()
    assert len(got) == strange.count()
    if got:
        same = [r for r in got if r.text_sha256 == hashlib.sha256(b"a b").hexdigest()]
        assert len(same) == 3 and {r.keep_id for r in same} == {4} and [r.kept for r in same].count(True) == 1 and same[0].group_size == 3
        assert by_id(got)[1].keep_id == 1 and by_id(got)[2].keep_id == 1 and by_id(got)[3].keep_id == 3
    assert exact_dedup.dedup(strange).columns == strange.columns


def test_tree_merge_over_many_lanes(spark):
    rows = docs(spark, [(i, f"text {i % 50}") for i in range(2000)]).repartition(13)
    kept = exact_dedup.tree_merge(exact_dedup.digests(rows, "doc_id", "text"), 100, fan_in=3).collect()
    assert sorted((r._id, r._n) for r in kept) == [(i, 40) for i in range(50)]


# near join


def test_links_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 9)):
            x = base[:]
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append((len(rows), " ".join(x)))
    rows += [(1000, "one two"), (1001, "One, two!"), (1002, ""), (1003, None)]
    got = by_id(near_join.join(docs(spark, rows)).collect())
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := word_list(t or "")) else frozenset() for i, t in rows}
    links, parent = Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: got[i].n_links for i in sets} == {i: links[i] for i in sets}
    assert {i: got[i].class_id for i in sets} == {i: root(i) for i in sets}
    kept = near_join.dedup(docs(spark, rows))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({root(i) for i in sets})


def test_large_component_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:100], f"x{i}", *base[100:]])) for i in range(40)]
    got = near_join.join(docs(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_near_join_odd_tables(spark, strange):
    got = near_join.join(strange).collect()
    assert len(got) == strange.count() and near_join.dedup(strange).columns == strange.columns


def test_bands_reach_the_recall():
    b, r = near_join.bands(0.8, 0.999, 256)
    assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_measured_recall_near_the_threshold(spark):
    r = random.Random(12)
    rows, pairs = [], 0
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(r.randint(60, 150))]
        other = base[:]
        for _ in range(max(1, len(base) // 60)):
            other[r.randrange(4, len(base) - 4)] = "changed"
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, other)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.9:
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
            pairs += 1
    found = sum(x.n_links for x in near_join.join(docs(spark, rows)).collect()) / 2
    assert pairs > 100 and found / pairs >= 0.99


def test_chained_buckets_are_verified_apart(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 4)
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    rows, at = [], r.sample(words, 120)
    for i in range(60):  # each text is like the next ones, but not like those far from it
        at = at[6:] + r.sample(words, 6)
        rows.append((i, " ".join(at)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = [sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = by_id(near_join.join(docs(spark, rows)).collect())
    assert [got[i].n_links for i in range(60)] == want and max(want) > 0


def test_a_block_may_be_empty():
    one = np.ones(3, np.int64)
    assert near_join.links(np.arange(3), one, one, np.ones((3, 2), np.int64), [np.arange(10)] * 3, -1, True, 0.8) == ([], [])


def test_pairs_belong_to_their_first_band():
    uid, weight, block = np.arange(3), np.ones(3, np.int64), np.zeros(3, np.int64)
    bands = np.array([[1, 2, 3], [9, 2, 3], [8, 7, 3]])
    sets = [np.arange(10)] * 3
    count = lambda at: dict(near_join.links(uid, weight, block, bands, sets, at, False, 0.8)[0])
    assert count(-1) == {0: 2, 1: 2, 2: 2} and count(0) == {} and count(1) == {0: 1, 1: 1} and count(2) == {0: 1, 1: 1, 2: 2}


# row numbers


@pytest.mark.parametrize("operator", [near_join.dedup, exact_dedup.dedup, lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")), mixing.select, lambda d: repeats.remove_repeats(d, length=8)])
def test_rows_are_the_same_when_cores_come_and_go(spark, tmp_path, operator):
    from tripforge.llm import common

    r = random.Random(4)
    rows = [(i % 90, " ".join(f"w{r.randint(0, 30)}" for _ in range(20)) if i % 3 else "same text here", None, "ab"[i % 2]) for i in range(300)]
    docs(spark, rows).repartition(7).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    cores, write = "spark.sql.leafNodeDefaultParallelism", common.Scratch.write

    def run(change):
        count = iter(range(10_000))

        def written(self, df, what):
            if change:
                spark.conf.set(cores, (1, 5, 2)[next(count) % 3])
            return write(self, df, what)

        common.Scratch.write = written
        try:
            return Counter(str(x) for x in operator(table).drop("_uid").collect())
        finally:
            common.Scratch.write = write
            spark.conf.unset(cores)

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        steady = run(False)
        assert steady == run(True) and steady
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


# decontamination


def brute_hits(items, text, n=10):
    words = word_list(text or "")
    hit, found = set(), set()
    for item, t in items:
        w = word_list(t or "")
        for i in range(max(1, len(w) - n + 1) if w else 0):
            win = w[i : i + n]
            for s in range(len(words) - len(win) + 1):
                if words[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(item)) if item is not None else None
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_hits_against_brute_force(spark, block):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25)))) for i in range(8)] + [(8, "w1 W2"), (9, None), (10, "--"), (None, "w3 w4 w5 w6 w7"), (8, "zz yy xx")]
    rows = [(i, " ".join(r.choice(vocabulary + ["q"]) for _ in range(r.randint(0, 60))) + " - " + (items[i % 8][1] if i % 3 == 0 else "")) for i in range(40)] + [(100, None), (100, None), (101, "W1;w2")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, _uid long")
    got = Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.report(docs(spark, rows), bench, block_bytes=block).collect())
    assert got == Counter((i, *brute_hits(items, t)) for i, t in rows)


def test_decontamination_of_odd_tables(spark, strange):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(strange, none).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(strange, none).count() == strange.count()
    some = spark.createDataFrame([(1, "A b")], "item_id long, text string")
    assert decontaminate.drop_contaminated(strange, some).count() == max(0, strange.count() - 3)


# repeats


def brute_repeats(texts, n):
    seen = Counter(x[s : s + n] for x in texts for s in range(len(x) - n + 1))
    out = []
    for x in texts:
        hit = np.zeros(len(x), bool)
        for s in range(len(x) - n + 1):
            if seen[x[s : s + n]] > 1:
                hit[s : s + n] = True
        runs = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(x) else 0
        out.append((len(x), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~hit])).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 5, 24, 60])
def test_repeats_against_brute_force(spark, n):
    r = random.Random(n)
    text = "".join(r.choice("abcd ") for _ in range(700))
    texts = ["ab" * 100, "a" * 250, None, "", text, text[50:200] + "!" + text[100:500], text, "é" * 90, text[300:], "z" * (n - 1)]
    got = repeats.remove_repeats(docs(spark, list(enumerate(texts))), length=n).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == brute_repeats([(t or "").encode() for t in texts], n)


def test_repeats_in_odd_tables(spark, strange):
    got = repeats.remove_repeats(strange).collect()
    assert len(got) == strange.count()


# WARC


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (5, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, "http://b/\r\nx: y", None), (4, "u", ""), (None, "u", "only"), (7, "u", "x" * 100_000), (7, "u", "x" * 100_000)]
    path = warc.write_archives(page_table(spark, rows))
    got = warc.read_archives(spark, path).collect()
    assert all(r.reason is None for r in got) and len(got) == len(rows)
    full = {r.page_id: r for r in got if r.record_type == "response"}
    assert bytes(full[5].payload).decode() == rows[0][2] and full[4].payload_bytes == 0
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 5), (3, 4), (7, 7)}
    for r in got:
        text = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode() and r.payload_bytes == len(text.encode())
    few = warc.read_archives(spark, warc.write_archives(page_table(spark, rows), min_bytes=1)).collect()
    assert sum(r.record_type == "revisit" for r in few) == 2
    assert warc.read_archives(spark, warc.write_archives(page_table(spark, []))).count() == 0


@pytest.mark.parametrize("packed", [[True] * 6, [False] * 6, [True, False, True, False, True, False]])
def test_salvage_loses_only_what_is_damaged(packed):
    records = [warc.member({"WARC-Type": "resource", "WARC-Page-ID": str(i)}, f"text {i} WARC/1.1\r\n".encode() * 30, z) for i, z in enumerate(packed)]
    at = np.cumsum([0, *map(len, records)])
    raw = bytearray(b"".join(records))
    raw[at[1] + 90] ^= 0x55
    raw[at[3] : at[3] + 4] = b"\0\0\0\0"
    raw = bytes(raw[: at[5] + len(records[5]) // 2])
    found = list(warc.salvage(raw))
    good = [f.header["warc-page-id"] for f in found if f.reason is None]
    assert good == ["0", "2", "4"]
    edges = sorted((f.start, f.stop) for f in found)
    assert edges[0][0] == 0 and edges[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_damage_costs_one_record_of_a_written_archive(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, f"http://{i}/", " ".join(str(r.random()) for _ in range(400))) for i in range(40)] + [(99, "u", "x" * (17 << 20))]
    path = warc.write_archives(page_table(spark, rows).coalesce(1), f"file://{tmp_path}/out", archive_bytes=1 << 40)
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    assert sum(x.reason is None for x in warc.salvage(raw)) == 41 and gzip.decompress(raw).count(b"WARC-Payload-Length: ") == 41
    assert all(x.reason is None for x in warc.salvage(raw)) and warc.read_archives(spark, path).count() == 41
    whole = [x for x in warc.salvage(raw) if x.stop - x.start < 1 << 16]
    hurt = bytearray(raw)
    hurt[(whole[20].start + whole[20].stop) // 2] ^= 0x55
    kept = {x.header["warc-page-id"] for x in warc.salvage(bytes(hurt)) if x.reason is None}
    assert kept == {x.header["warc-page-id"] for x in warc.salvage(raw)} - {whole[20].header["warc-page-id"]}


def test_headers_have_no_limit(spark):
    pages = page_table(spark, [(1, "http://a/" + "u" * (2 << 20), "text"), (2, "u", "more")])
    got = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert set(got) == {1, 2} and got[1].reason is None and len(got[1].url) == 9 + (2 << 20)


def test_query_keeps_pages_with_long_urls(spark, tmp_path):
    page_table(spark, [(1, "http://a/" + "u" * (3 << 20), "text"), (2, "u", "text")]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (4, "revisit", 2), 2: (4, "response", None)}


@pytest.mark.parametrize("end", [b"", b"no colon\r\n", b"\r\n", b"Content-Length: 9\r\n\r\n", b"Content-Length: 0\r\n\r\n"])
def test_headers_are_read_once(end):
    lost = b"WARC/1.1\r\n" + b"a:WARC/1.1\r\n" * 4000 + b"b:" + b"x" * (2 << 20)
    kept = [warc.member({"WARC-Page-ID": "1"}, b"text"), warc.member({"WARC-Page-ID": "2", "a": "x" * (2 << 20)}, b"text", False)]
    began = time.time()
    # a packed record within the lost lines, a plain one with a long line after them
    found = list(warc.salvage(lost + b"\r\n" + end + kept[0] + lost + kept[0] + b"\r\n" + end + kept[1]))
    assert time.time() - began < 4
    assert [x.header["warc-page-id"] for x in found if x.reason is None] == ["1", "1", "2"]
    assert all(a.stop == b.start for a, b in zip(found, found[1:]))


def test_output_before_the_damage_is_kept():
    records = [warc.member({"WARC-Type": "resource", "WARC-Page-ID": str(i)}, random.Random(i).randbytes(2000), False) for i in range(20)]
    raw = gzip.compress(b"".join(records))
    for at, least in ((len(raw) // 2, 9), (len(raw) - 6, 20)):  # in the stream, in the CRC
        hurt = bytearray(raw)
        hurt[at] ^= 0x55
        assert sum(x.reason is None for x in warc.salvage(bytes(hurt))) >= least


# mixing


def test_targets_stop_at_three_times_the_size():
    sizes = {"a": 10, "b": 100, "c": 890}
    got = mixing.targets(sizes, mixing.cycled_weights(list(sizes)), 1000)
    assert got["a"] == 30 and got["b"] == 300 and got["c"] == pytest.approx(670)
    assert mixing.cycled_weights(["b", None, "a"]) == {"a": 1, "b": 2, None: 3}


def test_flow_prefers_fresh_words():
    # the shared pattern has to serve b, as a can live on its own
    got = mixing.min_cost_flow({("a",): 100, ("a", "b"): 50}, {"a": 100, "b": 50})
    assert got == {(("a",), "a"): 100, (("a", "b"), "a"): 0, (("a", "b"), "b"): 50}
    assert sum(mixing.min_cost_flow({("a",): 10}, {"a": 100}).values()) == 30


def test_flow_is_optimal():
    import itertools

    r = random.Random(6)
    for _ in range(25):
        names = "abc"[: r.randint(2, 3)]
        patterns = r.sample([p for k in (1, 2, 3) for p in itertools.combinations(names, k)], 3)
        supply, quota = {p: r.randint(1, 3) for p in patterns}, {s: r.randint(0, 6) for s in names}
        arcs, best = [(p, s) for p in patterns for s in p], (-1, 0)
        for flow in itertools.product(*[range(min(3 * supply[p], quota[s]) + 1) for p, s in arcs]):
            out = {p: sum(f for f, a in zip(flow, arcs) if a[0] == p) for p in patterns}
            into = {s: sum(f for f, a in zip(flow, arcs) if a[1] == s) for s in names}
            if all(out[p] <= 3 * supply[p] for p in patterns) and all(into[s] <= quota[s] for s in names):
                cost = sum(mixing.REPETITION[k // supply[p]] for p in patterns for k in range(out[p]))
                best = max(best, (sum(flow), -cost))
        got = mixing.min_cost_flow(supply, quota)
        used = {p: sum(n for (q, _), n in got.items() if q == p) for p in patterns}
        assert (sum(got.values()), -sum(mixing.REPETITION[k // supply[p]] for p in patterns for k in range(used[p]))) == best


def test_mix_uses_documents_again_to_close_a_gap(spark):
    rows = [(i, "w " * n, None, s) for i, (n, s) in enumerate([(1000, "a"), (5, "a"), (4, "a"), (1200, "b")])]
    got = mixing.mix(docs(spark, rows), weights={"a": 17, "b": 2192}).collect()
    assert sum(x.taken for x in got if x.pattern == ["a"]) in (17, 18) and all(x.taken <= 3 * x.size for x in got)


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    with pytest.raises(ValueError, match="sets of sources"):
        mixing.mix(docs(spark, [(i, "a", None, str(i)) for i in range(5)]))


def test_mix_meets_its_targets(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), None, r.choice(["a", "a", "a", "b", None])) for i in range(600)] + [(1000, None, None, "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert Counter((x.doc_id, x.taken) for x in got) == Counter((x.doc_id, x.taken) for x in again)
    taken, target = defaultdict(int), {}
    for x in got:
        assert x.taken <= 3 * x.size and x.size == len((dict((i, t) for i, t, *_ in rows)[x.doc_id] or "").split())
        taken[x.pattern[0]] += x.taken
        target[x.pattern[0]] = x.target
    assert len(target) == 3 and all(abs(taken[s] - target[s]) <= 2 for s in target)


@pytest.mark.parametrize("walk", [1 << 16, 1])
def test_mix_passes_over_documents_that_do_not_fit(spark, monkeypatch, walk):
    monkeypatch.setattr(mixing, "WALK", walk)
    r = random.Random(8)
    size = {"z": [10] * 2000} | {f"s{k}": [2000] + [r.randint(3, 10) for _ in range(150)] for k in range(6)}
    rows = [(i, "w " * n, None, s) for i, (s, n) in enumerate((s, n) for s in size for n in size[s])]
    weights = {s: 600 for s in size} | {"z": sum(map(sum, size.values())) - 3600}
    taken, free = defaultdict(int), defaultdict(list)
    for x in mixing.mix(docs(spark, rows), weights=weights).collect():
        taken[x.pattern[0]] += x.taken
        free[x.pattern[0]] += [x.size] * (x.repeats == 0)
    for s in size:
        assert abs(taken[s] - weights[s]) <= 10 and all(n > weights[s] - taken[s] for n in free[s])


def test_walk_is_greedy():
    r = random.Random(2)
    rows = [(r.randrange(9), r.randrange(40), r.choice([None, 1, 2]), i, r.randint(1, 60)) for i in range(400)]
    t = pa.table({"pattern": [["a"]] * 400, "gap": [1500] * 400, "begin": [0] * 400} | {c: pa.array([x[k] for x in rows], pa.int64()) for k, c in enumerate((*mixing.KEY, "size"))})
    got = mixing.walked(t)
    gap, want = 1500, set()
    order = lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3])
    for x in sorted(rows, key=order):
        if x[4] <= gap:
            gap -= x[4]
            want.add(x[3])
    place = lambda d: order([d[c] for c in mixing.KEY])
    parts = got["parts"][0].as_py()
    assert got["gap"][0].as_py() == gap and len(parts) > 1
    assert {x[3] for x in rows if any((p["lo"] is None or order(x) > place(p["lo"])) and order(x) <= place(p["hi"]) and x[4] <= p["most"] for p in parts)} == want


def test_mixing_odd_tables(spark, strange):
    assert mixing.mix(strange).count() == strange.count()


# context-tree weighting


def brute_ctw(train, texts, depth):
    """Probabilities by the definition, with a dictionary per node."""
    from math import exp, lgamma, log, log10, pi

    counts = defaultdict(lambda: [0, 0])

    def coded(t):
        b = [0xFF] * depth + list((t or "").encode()) + [0xFF]
        for i in range(depth, len(b)):
            yield tuple(b[i - depth : i]), b[i]

    def nodes(ctx, byte):
        node = 1
        for k in range(7, -1, -1):
            yield node, byte >> k & 1
            node = node * 2 + (byte >> k & 1)

    for t in train:
        for ctx, byte in coded(t):
            for node, bit in nodes(ctx, byte):
                for d in range(depth + 1):
                    counts[ctx[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for ctx, node in counts:
        if ctx:
            children[ctx[1:], node].add(ctx)
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*counts[ctx, node])
            if len(ctx) < depth:
                below = sum(weighted(c, node)[0] for c in list(children[ctx, node]))
                m = max(own, below)
                memo[ctx, node] = log(0.5) + m + log(exp(own - m) + exp(below - m)), 1 / (1 + exp(min(700, below - own)))
            else:
                memo[ctx, node] = own, 1.0
        return memo[ctx, node]

    out = []
    for t in texts:
        total = 0.0
        for ctx, byte in coded(t):
            for node, bit in nodes(ctx, byte):
                p = 0.5
                for d in range(depth, -1, -1):
                    c = ctx[depth - d :]
                    if (c, node) in counts:
                        a, b = counts[c, node]
                        w = weighted(c, node)[1]
                        p = w * (b + 0.5) / (a + b + 1) + (1 - w) * p
                    elif d == 0:
                        p = 0.5 * 0.5 + 0.5 * p
                total += log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_ctw_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["ab", "abc", "ba ", "é", "A", "\n"]) for _ in range(r.randint(0, 25)))) for i in range(40)] + [(40, None), (41, "zq\x00"), (41, "zq\x00")]
    held = F.col("doc_id") % 3 == 2
    got = ctw.score(docs(spark, rows), held, shard_bytes=4096, head_size=3).collect()
    train = [t for i, t in rows if i % 3 != 2]
    want = brute_ctw(train, [t for _, t in rows], ctw.DEPTH)
    assert sorted(zip([r[0] for r in rows], np.round(want, 3))) == sorted((x.doc_id, round(x.score, 3)) for x in got)
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for t in train for w in low(t))
    n, v = sum(c.values()), len(c)
    base = sorted((i, len(low(t)), sum(w in c for w in low(t)), round(float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in low(t))), 6)) for i, t in rows)
    assert base == sorted((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got)
    assert {x.train_tokens for x in got} == {n}


def test_ctw_probabilities_add_up():
    import pyarrow as pa
    from types import SimpleNamespace

    text = np.frombuffer(b"abracadabra, a banana; \xc3\xa9t\xc3\xa9 " * 3, np.uint8)
    context, byte, _ = ctw.marked(np.array([0, len(text)]), text)
    strings, n = np.unique(context << 8 | byte, return_counts=True)
    groups = [np.flatnonzero(strings >> 8 & 0xFFFF == c) for c in np.unique(strings >> 8 & 0xFFFF)]
    groups = [pa.table({"key": strings[g], "n": n[g]}) for g in groups]
    by_one = {}
    for row in (ctw.upward(g) for g in groups):
        by_one.setdefault(row["c1"][0].as_py(), []).append(row)
    rows = [ctw.upward1(pa.concat_tables(v)).to_pylist()[0] for v in by_one.values()]
    top = ctw.Top([SimpleNamespace(**r) for r in rows])
    got = pa.concat_tables(ctw.downward(SimpleNamespace(value=top))(g) for g in groups).sort_by([("depth", "ascending"), ("key", "ascending")])
    levels = {}
    for d in range(2, ctw.DEPTH + 1):
        t = got.filter(pa.compute.equal(got["depth"], d))
        levels[d] = t["key"].to_numpy(), t["whole"].to_numpy(), np.stack([t[b].to_numpy() for b in ctw.BITS], 1)
    shard = ctw.Shard(levels, np.ones(65536, bool), top.defaults())
    some = [*np.unique(context)[:40].tolist(), 0, int.from_bytes(b"abr", "big")]
    for c in some:
        assert np.isclose((10 ** shard.find(c << 8 | np.arange(256))).sum(), 1, atol=1e-4)


def test_ctw_odd_tables(spark, strange):
    assert ctw.score(strange, F.lit(False)).count() == strange.count()
    assert ctw.score(strange, F.lit(True)).count() == strange.count()


# toxicity


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_against_edit_distance():
    terms = ["worthless", "idiot", "scum", "moron"]
    lexicon, r = toxicity.Lexicon(dict.fromkeys(terms, 1.0)), random.Random(4)
    for _ in range(3000):
        t = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i, k = r.randrange(len(t) + 1), r.random()
            t[i : i + (k > 0.4)] = [r.choice("abcdiotwrs")] if k < 0.7 else []
        t = "".join(t)
        want = min((lev(t, x) for x in terms if lev(t, x) <= toxicity.edits(x)), default=None)
        k, cost = lexicon.match(t)
        assert (want is None) == (k < 0) and (want is None or cost == want)


def labelled(spark, n=600):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ra", "lo", "mi", "ten", "so"]) for _ in range(r.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.2
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["worthless", "blockhead", "scoundrel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_words_and_misspellings(spark):
    rows, labels = labelled(spark)
    fit = docs(spark, rows)
    model = toxicity.fit(fit, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    test = [(1, "ra lo worthless mi"), (2, "ra lo mi ten so"), (3, None), (4, "ra wortless lo mi"), (5, ""), (5, ""), (None, "scoundrel " + "ra " * 20_000)]
    got = toxicity.scores(docs(spark, test), model).collect()
    score = {r.doc_id: r.predicted for r in got}
    assert score[1] == 1 and score[2] == 0 and score[3] == 0 and score[4] == 1 and score[5] == 0 and len(got) == len(test)
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted(str(x.doc_id) for x in toxicity.drop_toxic(docs(spark, test), model).collect()) == ["2", "3", "5", "5", *(["None"] if not score[None] else [])]


def test_no_term_is_lost_to_beginnings_of_others(spark):
    r = random.Random(9)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(320)]
    rows = [(i, f"some plain words {' '.join(long[k] for k in range(i % 20, 320, 20))}") for i in range(120)]
    rows += [(i, "some plain words zzrarest") for i in range(200, 204)] + [(i, "some plain words") for i in range(300, 600)]
    labels = [(i, int(i < 300)) for i, _ in rows]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {*long, "zzrarest"} <= set(model.lexicon.terms) and not any(t.endswith("*") and any(w.startswith(t[:-1]) for w in long) for t in model.lexicon.terms)


def test_quotation_is_seen():
    text = 'he said "you are worthless" to them\nworthless here'
    data = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(data)])
    words = toxicity.Words(offs, data, toxicity.TOKEN)
    assert [h[4] for h in toxicity.hits_of(words, data, offs, toxicity.Lexicon({"worthless": 1.0}), {})] == [True, False]


def test_quotation_is_counted_from_the_start_of_the_line():
    lexicon = toxicity.Lexicon({"grobble": 2.0})
    far, near = "far words " * 60, "near " * 70
    texts = {
        f'"{far}grobble': True, f'"{far}" grobble': False, f'"far" "{"x " * 60}" {near}grobble': False, f'"{"x " * 60}" {near}grobble': False,
        f"«{far}grobble": True, f"“{far}” grobble": False, f"„{far}grobble": True, f'"{far}\n{far}grobble': False, "é": None, "“": None, 'grobble "': False,
    }
    raw = [t.encode() for t in texts]
    offs, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    got = {h[0]: h[4] for h in toxicity.hits_of(toxicity.Words(offs, data, toxicity.TOKEN), data, offs, lexicon, {})}
    assert got == {i: q for i, q in enumerate(texts.values()) if q is not None}


def test_toxicity_without_labels(spark, strange):
    model = toxicity.fit(strange, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scores(strange, model).collect()} <= {0.0}


# language


def test_languages(spark):
    r = random.Random(8)
    make = {"en": ["the", "and", "ing", "with", "on"], "de": ["der", "und", "ung", "sch", "ein"], "fr": ["le", "eux", "que", "é", "ou"]}
    rows = [(i, " ".join("".join(r.choice(make[k]) for _ in range(2)) for _ in range(r.randint(4, 40))), k) for i, k in enumerate(r.choice(list(make)) for _ in range(300))]
    model = langid.fit(docs(spark, [*rows, (900, None, "en"), (901, "the the", None)]), sample=150)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(docs(spark, [*rows, (1000, None), (1001, ""), (1002, "123 - ?"), (1003, "Δ")]), model).collect()
    by = by_id(got)
    assert np.mean([by[i].lang_pred == k for i, _, k in rows]) > 0.98
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1003].lang_pred != "und" and all(0 <= x.score <= 1 for x in got)


def test_kernel_is_the_blended_spectrum():
    texts = ["abc", "abd", "zz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    x = langid.presence(offs, data)
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    k = langid.kernel(x.astype(float), x.astype(float))
    assert k[0, 1] == pytest.approx(len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1]))) and k[0, 2] == 0


def test_langid_odd_tables(spark, strange):
    model = langid.fit(strange)
    got = langid.identify(strange, model).collect()
    assert len(got) == strange.count() and {r.lang_pred for r in got} <= {"und"}


# pages

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></nav>'
    '<div class="ad">Buy this now, it is good.</div><article><h1>The  title &amp; more</h1><p><b>First sentence here.<br><p>Second one,\n with a break. It goes on.</p><p>Short.</article>'
    '<div id="comments"><p>I liked this very much.</p></div><form><p>Name</p><input></form><footer>&copy; nobody 2020</footer></body>'
)


@pytest.fixture(scope="module")
def extractor():
    return html_extract.train(html_extract.labelled_pages(500))


def test_main_text(extractor):
    assert extractor.extract(PAGE) == ["The title & more", "First sentence here.", "Second one, with a break. It goes on.", "Short."]


def test_broken_pages(extractor):
    assert extractor.extract(None) == [] and extractor.extract("") == []
    assert extractor.extract(PAGE[: PAGE.index("<div id")])[-1] == "Short."
    assert extractor.extract("<article><p>One &lt two.</p><p>Three</article><foot")[0] == "One < two."


@pytest.mark.parametrize("page, want", [
    ('<div x-label="a">hi</div>', ["hi"]), ("<p class=it's>hello</p>", ["hello"]), ('<p class="x>hello</p>', ["hello"]), ('<p title="a>b">x</p><p>y', ["x", "y"]),
    ("<head><title>t</title><p>text", ["text"]), ("<!-->shown<!-- > hid -->", ["shown"]), ("a < b <3 </ x>z", ["a < b <3 z"]), ("<p>cut <b tit", ["cut"]), ("a<![CDATA[<b>]]>", ["a<b>"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<script>if (a</b) x</script>y", ["y"]),
])
def test_tags_as_browsers_read_them(page, want):
    assert [x.text for x in html_extract.parse(page) if x.tag == "#text"] == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</p>" * 100_000, "</x>" * 250_000, "<" * 1_000_000, '<a b="' * 150_000, "<!--" * 250_000, "<p a=" * 200_000, "<style>" * 100_000, "<li>" * 120_000])
def test_parsing_is_linear(page):
    began = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - began < 8  # seconds for about 1 MB; quadratic reading takes minutes


@pytest.mark.parametrize("names", [' class="user-opinions"', ' id="zq-77"', ""])
def test_comments_without_a_listed_name(extractor, names):
    w = html_extract._Writer(3)
    article = "<article><h1>" + w.words(3, 5) + "</h1>" + "".join(f"<p>{w.sentences(3, 6)}</p>" for _ in range(6)) + "</article>"
    comments = f"<section{names}><h3>{w.words(1, 2)}</h3>" + "".join(f"<div><p>{w.sentences(1, 3)}</p></div>" for _ in range(5)) + "</section>"
    got = extractor.extract(f"<body>{article}{comments}</body>")
    assert len(got) == 7 and all(x in article for x in got)


def test_marginals_are_exact():
    r = random.Random(3)
    tags = ["#root", "div", "p", "#text"]
    nodes = [html_extract.Node("#root", -1, 0)]
    for _ in range(6):
        p = r.randrange(len(nodes))
        nodes.append(html_extract.Node(r.choice(tags[1:3]), p, 0))
    model = html_extract.Model({"tag:div": 0.7, "tag:p": -0.4}, {"*": (0.2, 0.7), "div": (0.1, 0.6)}, 0.1)
    unary = model.unary(nodes)
    assert unary[0] == pytest.approx(model.bias * html_extract.LEAF + html_extract.ROOT) and unary[1] != 0
    total, on = 0.0, np.zeros(len(nodes))
    for mask in range(1 << len(nodes)):
        y = [mask >> k & 1 for k in range(len(nodes))]
        w = np.exp(sum(u for u, v in zip(unary, y) if v))
        for k in range(1, len(nodes)):
            a, b = model.edges.get(nodes[nodes[k].parent].tag, model.edges["*"])
            q = b if y[nodes[k].parent] else a
            w *= q if y[k] else 1 - q
        total += w
        on += w * np.array(y)
    assert np.allclose(model.marginals(nodes), on / total)


def test_held_out_pages(extractor):
    right = n = 0
    for page in html_extract.labelled_pages(80, seed=77):
        nodes = html_extract.parse(page, True)
        for k, x in enumerate(nodes):
            x.label = x.label if x.label is not None else nodes[x.parent].label if k else 1
        for x, p in zip(nodes, extractor.marginals(nodes)):
            if x.tag == "#text":
                n, right = n + 1, right + ((p >= 0.5) == bool(x.label))
    assert right / n > 0.98


def test_extract_table(spark, extractor):
    got = html_extract.extract(page_table(spark, [(1, None, PAGE), (2, "u", None), (None, "u", "plain"), (1, None, PAGE)]), extractor).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 2] == [""]
    assert html_extract.extract(page_table(spark, []), extractor).count() == 0


def test_crc_split(spark):
    from tripforge.llm.common import remainder

    got = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", remainder("doc_id", 7).alias("r")).collect()
    assert all(x.r == zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 7 for x in got)
