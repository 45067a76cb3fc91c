"""The pipeline on a small corpus: each stage against a plain version of it."""

import random
import re

import pytest

import corpus_pipeline
from tripforge.llm.textvec import word_list


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, d = random.Random(9), tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choice(["ra", "lo", "mi", "ten", "so", "va"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    bench = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    for i in range(500):
        w = [word() for _ in range(r.randint(20, 90))]
        bad = r.random() < 0.2
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["worthless", "blockhead", "scoundrel"]))
        rows.append([i, " ".join(w)])
        labels.append((i, int(bad)))
    clean = [row for row, (_, bad) in zip(rows, labels) if not bad]
    for k in range(20):
        rows.append([1000 + k, clean[k][1].replace(" ", "  \n")])
        w = clean[50 + k][1].split()
        w[0] = "changed"
        rows.append([2000 + k, " ".join(w)])
    rows += [[3000 + i, clean[100 + i][1] + " " + t.upper()] for i, (_, t) in enumerate(bench)] + [[4000, None], [None, "lonely text here"], [4001, ""]]
    r.shuffle(rows)
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(labels), bench


def near_copies(rows):
    """Ids of documents that aren't the smallest of those linked with them."""
    sets = {}
    for i, t in rows:
        w = word_list(t or "")
        if i is not None and w:
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    least = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and least[a] != least[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return {i for i in sets if least[i] != i}


def test_stages(spark, corpus, tmp_path):
    d, labels, bench = corpus
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [(x.doc_id, x.text) for x in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert docs.columns == columns
        now = [(x.doc_id, x.text) for x in docs.collect()]
        assert set(now) <= set(kept) and len(now) == len(set(now))
        gone = set(kept) - set(now)
        if name == "toxicity":
            assert {i for i, _ in gone} == {i for i, bad in labels.items() if bad}
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
            assert set(now) == set(first.values())
        if name == "near_dedup":
            assert {i for i, _ in gone} == near_copies(kept) and len(gone) >= 15
        if name == "decontamination":
            assert {i for i, _ in gone} == {i for i, _ in kept if i and 3000 <= i < 3005}
        kept = now
    assert docs.where("taken <> size * repeats or repeats < 1 or repeats > 3").count() == 0


def test_run_is_all_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 300 and "repeats" in out.columns
