"""Vector codes, conversation tries and personal data against brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripforge.llm import decontaminate, html_extract, mixing, pii, toxicity, trie, veccode, warc

# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, _q string, code int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """By comparing every part with every entry, in exact numbers."""
    kept = [(i, [math.floor(4096 * Fraction(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    w = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * w - len(v)), c) for i, v, c in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(v[p * w : (p + 1) * w]) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        out = [[min((far(v[p * w : (p + 1) * w], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts if r < rounds else 0):
            for j in range(len(books[p])):
                own = [v[p * w : (p + 1) * w] for (_, v, _), o in zip(kept, out, strict=True) if o[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    error = [min(sum(d for d, _ in o), top) for o in out]
    label = {c: min(sum(e for e, k in zip(error, kept, strict=True) if k[2] == c), top) for _, _, c in kept}
    return sorted((i is None, i or 0, "".join(f"{j:02x}" for _, j in o), e, label[c]) for (i, _, c), o, e in zip(kept, out, error, strict=True)), sha


def check_codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = veccode.codes(df).collect()
    rows = [tuple(r)[:3] for r in df.collect()]  # as floats hold them
    want, sha = plain_codes(rows)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_codes_with_ties_and_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, -0.25, 0.0, 0.1, 0.5]) for _ in range(16)], r.choice([None, 1, 2])) for i in range(120)]
    rows += [(i, [r.gauss(0, 1) for _ in range(16)], 3) for i in range(200, 260)]
    rows += [rows[0], (300, None, 1), (301, [1.0, None] * 8, 1), (302, [math.nan] * 16, 1), (303, [math.inf] * 16, 1), (None, [0.5] * 16, None), (304, [0.5] * 3, 9), (305, [], 9)]
    r.shuffle(rows)
    check_codes(spark, rows)


def test_codes_of_few_and_of_huge_vectors(spark):
    check_codes(spark, [(i, [0.1 * i, -0.2, 0.3], None) for i in range(5)])
    r = random.Random(6)
    check_codes(spark, [(i, [r.choice([3e38, -3e38, 1e20, 0.3, -7.1]) for _ in range(8)], i % 2) for i in range(40)])


def test_no_vector(spark):
    assert veccode.codes(spark.createDataFrame([(1, None, 1, "x", 1)], VECTORS)).count() == 0
    assert veccode.codes(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_search_compares_few_and_misses_none(seed):
    r = np.random.default_rng(seed)
    book = r.integers(-50, 50, (16, 4)) + 400 * r.integers(0, 2, (16, 1))
    x = np.repeat(book, 40, 0) + r.integers(-9, 9, (640, 4))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    s = veccode.Search(book)
    at, found = s.nearest(x, np.repeat(np.arange(16), 40))
    assert (at == d.argmin(1)).all() and (found == d.min(1)).all() and s.compared < 0.75 * d.size


# conversation tries

TURNS = "conv_id long, turn long, role string, text string, depth int, _uid int, k int"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()), (r, x)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(n))))
        out.append((
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], sum(not children[m] for m in below),
            sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


def check_trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS).repartition(3)
    got = sorted((tuple(r) for r in trie.trie(df, **more).collect()), key=lambda r: r[:2])
    assert got == plain_trie(rows)


def conversations(seed, n=60):
    r, rows = random.Random(seed), []
    for c in range(n):
        same = r.choice([0, 0, 1, 2])
        for t in range(r.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, r.choice(["user", None]) if t > 3 else "user", f"{same}-{t}" if r.random() < 0.9 else r.choice([None, "ä" * t])))
    return rows


def test_trie_against_brute_force(spark):
    rows = conversations(1) + [(7, None, "a", "first"), (7, None, "a", "first"), (7, 3, None, None), (None, 1, "a", "b"), (-3, 0, "user", "0-0"), (1000003, 5, "user", "x")]
    check_trie(spark, rows)


def test_trie_of_colliding_fingerprints(spark):
    check_trie(spark, conversations(2, 40), prime=3)


def test_trie_of_one_long_conversation(spark):
    rows = [(0, t, "user", str(t % 7)) for t in range(300)] + [(1, t, "user", str(t % 7)) for t in range(301)] + [(c, 0, "u", "hi") for c in range(20, 60)]
    check_trie(spark, rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2, 3)], TURNS)).count() == 0


# personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": "." in m and all(x.isdigit() and int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if good(k, m[0]))


def check_base(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _t string, base int")
    got = {r.doc_id: r for r in pii.personal(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t)
        told = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), (t, told, got[i])
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[3] == k for x in base) for k in KINDS]
        assert set(told) <= set(got[i].spans.split(",")), got[i]
    return got


def test_base_spans_of_odd_texts(spark):
    r = random.Random(4)
    bits = ["a@b.c", "x_", "@", ".", "-", "+1", " ", "é", "😀", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123.456-78", "1.2.3.4", "256.1.1.1", "007.1.02.3", "\u0001", "\n", "a.b@c-d.e_f@g.h", "(", "%", "0", "000000000000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(500)]
    check_base(spark, [*texts, None, "", " "])


def test_other_spellings_are_added_and_clean_texts_are_left(spark):
    r = random.Random(9)
    texts = [f"mail me at {r.choice('abc')}{i}@mail{i % 7}.example.com or call +1 (212) 555-{i:04d}, host {i % 200}.10.3.{i % 250}" for i in range(300)]
    texts += [f"order {r.randint(10**15, 10**16 - 1)} of build 300.{i}.1.2" for i in range(200)]
    other = ["write to jane [at] mail [dot] example.org", "reply to joe at mail dot example dot com today", "rené@müller.de is there", "card 4111.1111.1111.1111", "call (212) 555-0199 now", "host 10[.]1[.]2[.]3 is up"]
    clean = ["nothing here", "we met at noon. Then we left", "from 12:30 to 13:45", "version 1.2.3", "3.1415926535 and 2,000,000", "1999-2001 and 2002/2003"]
    got = check_base(spark, texts + other + clean)
    assert [got[len(texts) + i].n_added for i in range(len(other))] == [1] * len(other)
    assert all(got[len(texts) + len(other) + i].spans == "" for i in range(len(clean)))


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1 " * 300_000, "1.1." * 200_000, "a@a.a " * 50_000, "+1" * 200_000, "é" * 300_000 + "@", "a.b" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts))
    began = time.time()
    got = {r.doc_id: r for r in pii.personal(df).collect()}
    assert time.time() - began < 120 and got[3].n_email == 50_000 and got[0].spans == ""


def test_nobody_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal(empty).count() == 0
    assert [r.spans for r in pii.personal(spark.createDataFrame([(1, "clean"), (1, "clean")], "doc_id long, text string")).collect()] == ["", ""]


def test_reliabilities_of_known_labelers():
    r = random.Random(3)
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    counts, truth = defaultdict(int), defaultdict(lambda: [0, 0])
    for _ in range(40_000):
        y, c = r.random() < 0.4, 2
        for a in right:
            c = c * 3 + (2 if (r.random() < a) == y else 0)
        counts[c] += 1
        truth[c][y] += 1
    p, found = pii.reliabilities(counts)
    share, yes, no = found["card"]
    assert abs(share - 0.4) < 0.03
    for j, a in enumerate(right):
        assert abs(yes[j][2] - a) < 0.06 and abs(no[j][0] - a) < 0.06
    wrong = sum(min(n) if (p[c] >= 0.5) == (n[1] >= n[0]) else max(n) for c, n in truth.items())
    assert wrong <= 1.05 * sum(map(min, truth.values()))  # of the best rule in hindsight


# large and hostile input of earlier operators


def test_toxicity_learns_from_a_very_long_word(spark):
    rows = [(i, ("zorgwort " if i % 2 else "blume ") + "und so weiter " * 3) for i in range(80)] + [(1000, "q" * 1_000_000), (1001, "q" * 999_999 + " zorgwort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    began = time.time()
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, model).collect()}
    assert time.time() - began < 60 and got[1] == 1 and got[2] == 0 and got[1000] == 0 and got[1001] == 1


@pytest.mark.parametrize("mark", ["<!-- a -->", "<!-- a --!>", "<![CDATA[a]]>", "<!-->"])
def test_comments_in_linear_time(mark):
    began = time.time()
    html_extract.parse(mark * (1_000_000 // len(mark)))
    assert time.time() - began < 6


def test_a_second_body_goes_on_in_the_first():
    page = "<html><head><title>t</title></head><body><article><h1>Head</h1><p>One is here, and it is long enough.</p>{}<p>Two is here, and it is long enough.</p><p>Three is here, and it is long enough.</p></article></body></html>"
    texts = lambda x: [n.text for n in html_extract.parse(x) if n.tag == "#text"]
    for x in ("<body>", "<body class=x>"):
        assert html_extract.trained().extract(page.format(x)) == html_extract.trained().extract(page.format(""))
    assert texts("<body><p>a</body><body><p>b") == ["a", "b"]


def test_blocks_of_the_benchmark_are_broadcast_one_by_one(spark, monkeypatch):
    live, most = set(), []
    real = type(spark.sparkContext).broadcast

    def counted(self, value):
        b = real(self, value)
        live.add(b)
        most.append(len(live))
        gone = b.destroy
        b.destroy = lambda *a: (live.discard(b), gone(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(words[20 * i : 20 * i + 14])) for i in range(120)]
    docs = spark.createDataFrame([(i, "x y " + t[: len(t) - 5 * (i % 2)] + " z") for i, t in items] + [(999, "clean text only")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    got = {r.doc_id: r for r in decontaminate.report(docs, bench, block_bytes=size // 20).collect()}
    assert len(most) >= 38 and max(most) <= 2
    assert all(got[i].n_items == 1 and got[i].contaminated for i, _ in items) and not got[999].contaminated


def test_many_items_of_one_window():
    began = time.time()
    index = decontaminate.Index([(str(i), "yes") for i in range(100_000)], 10)
    assert len(index.items[0]) == 100_000 and time.time() - began < 3


def test_archives_of_uneven_pages_have_a_bound(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, "http://x", noise(60)) for i in range(3000)] + [(10_000 + i, "http://x", noise(200_000)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc.write_archives(pages, archive_bytes=1 << 20)
    folder = path.removeprefix("file://")
    sizes = [os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part")]
    assert max(sizes) <= 1 << 20 and sum(sizes) > 2 << 20
    found = warc.read_archives(spark, path).collect()
    assert sorted((x.page_id, x.payload.decode()) for x in found) == sorted((i, t) for i, _, t in rows) and not any(x.reason for x in found)


@pytest.mark.parametrize("data", [b"WARC/1.1\r\n" * 100_000, b"WARC/1.1\r\nA: b\r\n" * 60_000 + b"\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 30_000])
def test_salvage_of_hostile_archives_is_linear(data):
    began = time.time()
    found = list(warc.salvage(data))
    assert time.time() - began < 4 and found[-1].stop == len(data)


def test_flow_of_many_patterns():
    r = random.Random(2)
    names = [f"s{i}" for i in range(40)]
    supply = {}
    while len(supply) < mixing.PATTERNS:
        supply[tuple(sorted(r.sample(names, r.randint(1, 5))))] = r.randint(1, 1000)
    total = sum(supply.values())
    quota = {s: int(total * r.choice([0.5, 1, 2, 3]) / 40) for s in names}
    began = time.time()
    flow = mixing.min_cost_flow(supply, quota)
    assert time.time() - began < 60
    got, used = defaultdict(int), defaultdict(int)
    for (p, s), n in flow.items():
        assert s in p and n >= 0
        got[s] += n
        used[p] += n
    assert all(got[s] <= quota[s] for s in names) and all(used[p] <= 3 * n for p, n in supply.items())
    assert sum(got.values()) > 0.99 * min(sum(quota.values()), 3 * total)
