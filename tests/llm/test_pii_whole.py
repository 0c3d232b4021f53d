"""The trees and thresholds come from all texts of a table, however many."""

import random

from pyspark.sql import functions as F

from tidemark.llm import pii_boost as P


def letters(rng):
    return "".join(rng.choice("abcdefghklmnopqrstuvw") for _ in range(rng.randint(8, 30)))


def named(rng):
    """A password that no generated text has: letters alone, so no secret."""
    return f"{letters(rng)} the password: {letters(rng)} of {letters(rng)}"


def test_examples_of_all_distinct_texts_are_counted(spark):
    rng = random.Random(9)
    texts = [f"{letters(rng)} {rng.choice(['call', 'order'])} {rng.randrange(10**9, 10**13)} today" for _ in range(25_000)]
    texts += [f"mail {letters(rng)}@{letters(rng)}.org or token = {letters(rng)}4711" for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:3000], None, "", "one and the same 12345678901", "one and the same 12345678901"]], "text string").repartition(5)
    got = {(tuple(r.x), r.label, r.kind): r.n for r in P.learned(df, P.Boost(made=0)).groupBy("x", "label", "kind").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for t in {*texts, "one and the same 12345678901"}:
        for x, label, kind in P.examples(t):
            want[tuple(x), label, kind] = want.get((tuple(x), label, kind), 0) + 1
    assert sum(want.values()) > 25_000 and got == want


def test_texts_outside_a_sample_of_20000_teach_too(spark):
    """Only texts whose hash is above what half of 40,000 texts have show that such passwords are none."""
    rng, n = random.Random(8), 40_000
    above = spark.createDataFrame([(named(rng),) for _ in range(3000)], "text string")
    above = above.where(F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 30)) >= 1 << 29).limit(600)
    docs = spark.createDataFrame([(f"plain words without a number, {letters(rng)} {letters(rng)}",) for _ in range(n - 600)], "text string").union(above)
    assert docs.count() == n
    judge = P.fitted(docs, P.Boost())
    assert P.SECRET in judge.thresholds
    assert not any(P.spans_of(named(rng), judge)[1] for _ in range(200))
