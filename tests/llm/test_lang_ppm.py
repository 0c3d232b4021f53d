import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import lang_ppm as P

from .helpers import rows

SCHEMA = "doc_id long, text string, lang string, lang_pred string, held_out int"


class Tree:
    """Byte by byte, context by context."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(4)]
        for t in texts:
            b = b"\0\0\0" + t.encode()
            for i in range(3, len(b)):
                for k in range(4):
                    self.seen[k][b[i - k : i]][b[i]] += 1

    def bits(self, text):
        b, out = b"\0\0\0" + text.encode(), 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                c = self.seen[k].get(b[i - k : i])
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    out -= math.log2(c[b[i]] / (n + d))
                    break
                out -= math.log2(d / (n + d))
            else:
                out += 8
        return out


def test_code_lengths_are_exact():
    train = {"a": ["the cat and the dog", "a thin theory", "x"], "b": ["der hund und die katze", "wörter mit ü", ""]}
    counts = {}
    for x, texts in train.items():
        g, n = np.unique(P.grams(*P.joined(texts)), return_counts=True)
        counts[x] = (g.astype(np.int64), n.astype(float))
    m = P.Model(counts)
    texts = ["the hund", "", "ü", "zzz 123 \U0001f600", "x", "katze the", "\0\0", "the cat and the dog " * 50, ""]
    got = m.lengths(texts)
    for j, x in enumerate(m.langs):
        tree = Tree(train[x])
        assert got[:, j] == pytest.approx([tree.bits(t) for t in texts], rel=1e-12, abs=1e-9)


def test_long_texts_are_looked_up_in_slices(monkeypatch):
    g, n = np.unique(P.grams(*P.joined(["the cat and the dog"])), return_counts=True)
    m = P.Model({"a": (g.astype(np.int64), n.astype(float))})
    texts = ["", "the cat " * 9, "", "x", "dog and cat " * 7, ""]
    whole = m.lengths(texts)
    monkeypatch.setattr(P, "SLICE", 7)
    assert m.lengths(texts) == pytest.approx(whole)


def test_tables_are_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, small = P.learned(docs, P.Ppm()), P.learned(docs, P.Ppm(table_mb=1))
    assert small.four.values.nbytes <= 1 << 20 < whole.four.values.nbytes and small.langs == whole.langs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert {r.doc_id for r in got} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_corner_cases(spark):
    data = [(i, f"the word and the thing {i}", "en", "x", 1) for i in range(20)] + [(100 + i, f"der hund und die welt {i}", "de", "x", 1) for i in range(20)]
    data += [(500, None, "en", "x", 1), (501, "", "en", "x", 1), (502, "123 !?", None, "x", 1), (503, "the " * 50_000, None, "x", 1), (None, "und die welt", "de", None, None), (1, data[1][1], "en", "x", 1), (504, "\U0001f600²", "en", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = rows(P.predicted(df))
    assert len(got) == len(data)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(pred[i] == ("und", 0.0) for i in (500, 501, 502, 504))
    assert pred[503][0] == "en" and pred[None][0] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in rows(P.predicted(df.where("doc_id > 499")))} <= {"und", "en"}
    assert P.predicted(df.limit(0)).count() == 0
