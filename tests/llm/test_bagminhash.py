from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bagminhash as B
from tidemark.llm import common

SCHEMA = "doc_id long, text string, source string, label string, band int"


def bag(text):
    w = (text or "").lower().split()
    k = min(B.Near.shingle, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    """Union of all pairs of texts that are equal or similar."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    bags = {t: bag(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if bags[a] and bags[b] and bags[a].keys() & bags[b].keys():
                x, y = bags[a], bags[b]
                if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                    parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(t or "")
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, least.get(find(t or ""))) for i, t in rows), key=str)


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def test_signatures_estimate_weighted_similarity():
    base = text(1, 300)
    for other in (base + " " + base[:300], base[400:], base + " " + " ".join(base.split()[:150])):
        s = B.signatures([base, other], 4000, 5)
        assert abs((s[0] == s[1]).mean() - similarity(base, other)) < 0.04
        assert B.overlaps([base], [other], 5)[0] == pytest.approx(similarity(base, other))


def test_repeated_words_weigh():
    a, b = "x y " * 40, "x y " * 20
    s = B.signatures([a, b], 4000, 5)
    assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.04


def test_classes_match_brute_force(spark):
    base = text(2, 200)
    rows = [(i, base.replace(f"w{i} ", "z ")) for i in range(60)] + [(100 + i, text(i + 10, 80)) for i in range(30)]
    long = text(3, 20_000)
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "one"), (205, "ONE"), (206, long), (207, long + " tail"), (None, text(10, 80)), (100, text(10, 80)), (100, text(10, 80)), (None, text(77, 50))]
    chain = text(5, 300).split()
    rows += [(300 + k, " ".join(chain[k * 25 :] + [f"n{j}" for j in range(k * 25)])) for k in range(5)]
    df = spark.createDataFrame([(*r, "s", "l", 1) for r in rows], SCHEMA).repartition(5)
    assert got(B.near_duplicates(df)) == brute_classes(rows)


def test_one_of_each(spark):
    base = text(2, 200)
    rows = [(3, base), (1, base), (2, base + " more"), (2, base + " more"), (None, base), (9, text(4, 50)), (9, text(4, 50))]
    df = spark.createDataFrame([(*r, "s", "l", 1) for r in rows], SCHEMA)
    out = B.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 9]


def test_one_of_each_with_null_and_repeated_ids(spark):
    lone = text(31, 60)
    nulls = [(None, lone), (None, lone), (None, lone + " end"), (None, text(32, 60))]
    for more in ([], [(7, text(33, 40)), (7, text(33, 40))], [(7, text(33, 40)), (7, text(34, 40))]):
        rows = [(*r, f"s{k}", "l", k) for k, r in enumerate(nulls + more)]
        out = B.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
        kept = [r.text for r in out]
        assert len(kept) == len(set(kept)) == 2 + len({t for _, t in more})
        assert text(32, 60) in kept and sum(t.startswith(lone) for t in kept) == 1
        assert sorted(map(str, out)) == sorted(map(str, B.one_of_each(spark.createDataFrame(rows[::-1], SCHEMA)).collect()))


def test_clashing_columns_stay(spark):
    names = "key band bands label a b text doc_id _key _id _row id n"
    df = spark.createDataFrame([tuple(f"x{k}" for k in range(6)) + (t, i) + (1,) * 5 for i, t in enumerate([text(5, 60), text(5, 60), text(6, 60)])], names.split())
    assert sorted((r.doc_id, r.key, r._key) for r in B.one_of_each(df).collect()) == [(0, "x0", 1), (2, "x0", 1)]
    assert got(B.near_duplicates(df)) == [(0, 0), (1, 0), (2, 2)]


@pytest.mark.parametrize("most", [0, 200_000])
def test_large_groups_are_dealt_out(spark, monkeypatch, most):
    """Hubs, heavy buckets and heavy copies above the bound from which keys are salted, with and without broadcasts."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    base = text(21, 120)
    rows = [(i, base) for i in range(300)] + [(1000 + i, base + f" x{i}") for i in range(300)] + [(5000 + i, text(100 + i, 60)) for i in range(50)]
    df = spark.createDataFrame([(*r, "s", "l", 1) for r in rows], SCHEMA).repartition(6)
    assert got(B.near_duplicates(df)) == brute_classes(rows)
    assert sorted(r.doc_id for r in B.one_of_each(df).collect()) == [0] + [5000 + i for i in range(50)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert B.near_duplicates(df).count() == 0
    assert B.one_of_each(df).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(B.near_duplicates(docs)) == brute_classes(rows)
