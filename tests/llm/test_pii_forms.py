"""Forms that the trees were never taught, at the smallest size, and the kinds that may add spans there."""

import random
import re

import pytest

from tidemark.llm import pii_boost as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def judge(spark):
    return P.fitted(spark.read.parquet(f"{SF}/documents.parquet"), P.Boost())


def test_all_kinds_are_on_at_any_size(spark, judge):
    assert set(judge.thresholds) == set(range(5))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert set(P.fitted(empty, P.Boost()).thresholds) == set(range(5))


def card(rng):
    d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return d + next(c for c in "0123456789" if P.luhn(d + c))


def unseen(kind, rng):
    n = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    if kind == P.EMAIL:
        return rng.choice(["jo.{0}@x at host{0} dot org", "ann{0} at mail dot firm{0} dot com", "k{0} <at> web{0} <dot> net", "lee{0}＠site{0}。org"]).format(rng.randrange(100)).replace("@x", "")
    quad = [str(rng.randrange(256)) for _ in range(4)]
    if kind == P.IP:
        return rng.choice(["·", "․", " dot ", "{.}"]).join(quad)
    if kind == P.CARD:
        c = card(rng)
        return rng.choice(["‑", "·", "–"]).join(c[k : k + 4] for k in range(0, 16, 4))
    return rng.choice([f"0049/{n(3)}/{n(5)}", f"({n(3)}) {n(3)}–{n(4)}", f"0{n(2)}·{n(4)}·{n(3)}"])


HINTS = {P.EMAIL: "mail", P.IP: "host", P.CARD: "card", P.PHONE: "call"}


@pytest.mark.parametrize("kind", HINTS)
def test_nine_in_ten_of_unseen_forms_are_found(spark, judge, kind):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    rng, found, n = random.Random(kind), 0, 200
    for _ in range(n):
        words = rng.choice(texts).split()[:40]
        at = rng.randrange(len(words) + 1)
        before = " ".join([*words[:at], HINTS[kind], ""])
        value = unseen(kind, rng)
        t = before + value + " " + " ".join(words[at:])
        base, every = P.spans_of(t, judge)
        found += any(k == kind and s <= len(before) and e >= len(before) + len(value) for s, k, e in every)
    assert found >= 0.9 * n, found


def test_clean_documents_get_nothing_added(spark, judge):
    """Documents without a digit or an at sign hold nothing; prose with 'at' and numbers neither."""
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        clean = re.sub(r"[0-9@＠=:]", "", r.text or "")
        assert P.spans_of(clean, judge)[1] == []
    for t in ("We met at noon. Then at dot matrix shows all was well", "in 1,234,567 cases out of 89,000,123", "on 2024-10-11 12:30:45 at the harbour", "sections 3.1.4 and 10.2"):
        assert P.spans_of(t, judge)[1] == [], t


def test_one_label_alone(spark):
    """Texts that each hold one spelled-out address, and nothing else."""
    df = spark.createDataFrame([(i, f"write to user{i} [at] mail [dot] org soon") for i in range(40)], "doc_id long, text string")
    assert all(r.spans.startswith("email:9:") for r in P.found(df).collect())
