import random
import re
from collections import defaultdict

from tidemark.llm import common
from tidemark.llm import decontaminate as D

from .helpers import rows

SCHEMA = "doc_id long, text string, item string, key string, windows int"
BENCH = "item_id long, text string, key string"


def tokens(text):
    text = re.sub(rf"(?i)([0-9] ?)({'|'.join(D.UNITS)})(?![^\W_])", rf"\1 {D.UNIT}\2", text or "")
    text = re.sub(r"(?<=[a-zàèéêçñóíüäöß,;:] )(?=[A-ZÀÈÉÊÇÑÓÍÜÄÖ][a-zàèéêçñóíüäöß])", D.NAME, text)
    return [t for t in re.split(rf"[^\w{D.NAME}{D.UNIT}]+", text.lower()) if t]


def kind(t):
    return 1 if t[0].isdigit() else 2 if t[0] == D.NAME else 3 if t[0] == D.UNIT else 0


def wins(toks):
    t = ["#%d" % kind(x) if kind(x) else x for x in toks]
    return {k: tuple(t[k : k + 5]) for k in range(len(t) - 4)}


def brute(docs, bench):
    out = []
    items = {i: (tokens(t), {k: w for k, w in wins(tokens(t)).items() if sum(x[0] != "#" for x in w) >= 2}) for i, t in bench}
    for d, t in docs:
        toks = tokens(t)
        at = defaultdict(list)
        for k, w in wins(toks).items():
            at[w].append(k)
        for i, (their, w) in items.items():
            offs = defaultdict(set)
            for k, x in w.items():
                for p in at.get(x, ()):
                    offs[p - k].add(k)
            if not w or len(set().union(*offs.values())) / len(w) < 0.6:
                continue
            n, off, lo, hi = max((len(s), o, min(s), max(s)) for o, s in offs.items())
            pairs = {(a, b) for a, b in zip(their[lo : hi + 5], toks[lo + off : hi + 5 + off], strict=True) if kind(a) and kind(a) == kind(b)}
            if not pairs or len({a for a, _ in pairs}) / len(pairs) >= 0.7:
                out.append((d, i))
    return sorted(out, key=str)


Q = "A train leaves Berlin at 9 and travels 120 km to the town where Anna waits with 3 friends, then 120 km back to her home before night falls over the land"
FILL = "some words that stand around the passage and say nothing of it at all "


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert want
    assert sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()), key=str) == want


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, Q, "k"), (2, "too short", "k"), (3, None, "k"), (4, "", "k"), (5, "1 2 3 4 5 6 7 8", "k"), (6, Q, "k")], BENCH)
    other = Q.replace("120", "75").replace("Anna", "Maria").replace("9", "11").replace("Berlin", "Lyon")
    mixed = Q.replace("travels 120", "travels 75").replace("Anna", "Maria").replace("3", "3")
    data = [(1, FILL + Q + " " + FILL), (2, FILL + other), (3, FILL + other.upper()), (4, FILL), (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9"), (None, Q), (1, FILL + Q + " " + FILL), (8, FILL * 3000 + other), (9, " ".join(Q.split()[:12])), (10, mixed)]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in data], SCHEMA).repartition(3)
    got = rows(D.leaks(df, bench))
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted([*brute(data, [(1, Q), (6, Q)]), (7, 5)], key=str)
    form = {r["doc_id"]: r["form"] for r in got}
    assert form[1] == "verbatim" and form[2] == form[8] == "other values"
    assert 4 not in form and 9 not in form and form[7] == "verbatim"
    clean = D.cleaned(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in data if i is not None and i not in form)


def test_inconsistent_slots_are_no_leak(spark):
    q = "first add 5 to the sum then take 5 from the sum then add 5 to the rest and take 5 from it and add 5 more"
    bench = spark.createDataFrame([(1, q, "k")], BENCH)
    numbers = iter("1234567")
    mess = re.sub("5", lambda m: next(numbers), q)
    df = spark.createDataFrame([(1, q.replace("5", "8"), "a", "b", 1), (2, mess, "a", "b", 1)], SCHEMA)
    assert [r.doc_id for r in D.leaks(df, bench).collect()] == [1]


def test_every_offset_is_judged(spark):
    q = "first add 5 to the sum then take 5 from the sum then add 5 to the rest and take 5 from it and add 5 more"
    numbers = iter("12346789123467891234678912346789")
    messes = [re.sub("5", lambda m: next(numbers), q) for _ in range(3)]
    bench = spark.createDataFrame([(1, q, "k")], BENCH)
    data = [(1, " and ".join([FILL, q, FILL, messes[0]])), (2, " and ".join([messes[0], q, messes[1], messes[2]])), (3, " and ".join(messes)), (4, " and ".join([messes[0], q.replace("5", "8"), messes[1]]))]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in data], SCHEMA).repartition(2)
    assert sorted((r.doc_id, r.form) for r in D.leaks(df, bench).collect()) == [(1, "verbatim"), (2, "verbatim"), (4, "other values")]
    assert [r.doc_id for r in D.cleaned(df, bench).collect()] == [3]


def test_items_without_templates_are_found_as_they_stand(spark):
    dense, names = "12 + 7 * 3 = 33 and 5 * 9 = 45", "Anna, Boris, Clara, David, Emma, Frank"
    bench = spark.createDataFrame([(1, dense, "k"), (2, "Who wrote Emma?", "k"), (3, "1 2 3 4 5 6 7 8", "k"), (4, names, "k"), (5, "...", "k"), (6, "Xylophone", "k"), (7, Q, "k")], BENCH)
    data = [(1, FILL + dense + " " + FILL), (2, FILL + "who wrote emma"), (3, "1 2 3 4 5 6 7 8 9"), (4, FILL + names.upper()), (5, "..."), (6, "a xylophone."), (7, Q), (8, FILL + "who wrote Anna"), (9, FILL + dense.replace("7", "8").replace("5", "6")), (10, FILL + "Emma wrote who")]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in data], SCHEMA).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["form"] for r in rows(D.leaks(df, bench))}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 7)}
    assert set(got.values()) == {"verbatim"}
    assert sorted(r.doc_id for r in D.cleaned(df, bench).collect()) == [5, 8, 9, 10]


def test_copies_in_another_case(spark):
    q = "the guide says that Anna met Boris in Lyon before Clara and David went to Rome with Emma"
    bench = spark.createDataFrame([(1, q, "k"), (2, Q, "k")], BENCH)
    data = [(1, q), (2, FILL + q.lower()), (3, q.upper()), (4, Q.lower()), (5, Q.upper()), (6, Q.lower().replace("120", "75")), (7, q.replace("Anna", "Maria").replace("Rome", "Paris")), (8, q.lower().replace("anna", "maria").replace("clara", "eva").replace("lyon", "bonn")), (9, q.replace("Anna", "anna").replace("Clara", "CLARA"))]
    data += [(100 + k, "word " * (D.PART - 12 + k) + q.lower()) for k in range(16)]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in data], SCHEMA).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["form"] for r in rows(D.leaks(df, bench))}
    assert got == {(k, 2 if 4 <= k <= 6 else 1): "other values" if k in (6, 7) else "verbatim" for k in (1, 2, 3, 4, 5, 6, 7, 9, *range(100, 116))}


def test_beyond_the_broadcasts(spark, sf, monkeypatch):
    """Shuffled joins, with heavy windows, items and copies dealt out, give the same rows."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    first = bench.orderBy("item_id").first()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.range(300).selectExpr("id + 100000", f"'{first.text.replace(chr(39), ' ')}'")).union(spark.range(300).selectExpr("id + 200000", f"concat(id, ' ', '{first.text.replace(chr(39), ' ')}')"))
    want = sorted(map(str, D.leaks(docs, bench).collect()))
    assert len(want) > 600
    kept = D.cleaned(docs, bench).count()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "ITEM_BYTES", 0)
    for most in (0, 10**6):
        monkeypatch.setattr(D, "MOST_HASHES", most)
        assert sorted(map(str, D.leaks(docs, bench).collect())) == want
    assert D.cleaned(docs, bench).count() == kept


def test_recall_of_replaced_values_on_the_benchmark(spark):
    """Items of the test tables, which hold no values, get numbers, units and names between their words; with others in their
    places, each the same throughout, in the middle of documents, nine in ten are found, and no document without them."""
    rng = random.Random(8)
    names = ["Anna", "Boris", "Clara", "David", "Emma", "Frank"]
    old, new = {}, {}
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        who = rng.sample(names, 3)
        numbers = rng.sample(range(10, 99), 3)
        other = dict(zip(who, rng.sample(["Gustav", "Helga", "Igor", "Johanna"], 3), strict=True)) | {str(n): str(n + 100) for n in numbers}
        words = []
        for k, w in enumerate(r.text.split()):
            words.append(w)
            if k % 7 == 6:
                words.append(str(rng.choice(numbers)) + rng.choice(["", " km", " kg"]))
            if k % 11 == 10 and w[-1].islower():
                words.append(rng.choice(who))
        old[r.item_id] = " ".join(words)
        new[r.item_id] = re.sub("|".join(other), lambda m, other=other: other[m[0]], old[r.item_id])
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(len(old)).select("text").collect()]
    data = [(i, f"{d} {new[i]} {d}", "a", "b", 1) for i, d in zip(old, docs, strict=True)] + [(10_000 + k, d, "a", "b", 1) for k, d in enumerate(docs)]
    got = [(r.doc_id, r.item_id, r.form) for r in D.leaks(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(i, t, "k") for i, t in old.items()], BENCH)).collect()]
    print(len(got), len(old))
    assert len(got) >= 0.9 * len(old) and all(d == i and form == "other values" for d, i, form in got)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, Q, "a", "k"), (2, FILL, "b", "k")], "doc_id long, text string, _k string, _key string")
    assert [tuple(r) for r in D.cleaned(df, spark.createDataFrame([(1, Q, "k")], BENCH)).collect()] == [(2, FILL, "b", "k")]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, Q, "a", "b", 1)], SCHEMA), spark.createDataFrame([(1, Q, "k")], BENCH)
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.cleaned(docs, bench.limit(0)).count() == 1
