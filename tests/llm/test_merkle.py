import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import duck, rows, same
from tidemark.llm import merkle_manifest as M
from tidemark.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, add=0):
    n = None if r["n_chars"] is None else r["n_chars"] + add
    return h("".join(map(field, [r["doc_id"], r["source"], r["lang"], n, r["text"]])))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append((j < i, level[j] if j < len(level) else ""))
        i //= 2
    return out


def brute(docs):
    by = defaultdict(list)
    for r in docs:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = path(trees[lang], i) + path(top, k)
            at = leaf(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else leaf(r)
            for left, s in steps:
                at = h(s + at if left else at + s)
            root = top[-1][0]
            out.append({"doc_id": r["doc_id"], "leaf": leaf(r), "subroot": trees[lang][-1][0], "root": root, "proof_sha256": h("".join(s for _, s in steps)), "folded_root": at, "verified": at == root})
    return out


def test_query_equals_brute_force_and_sql(spark, sf):
    got = rows(queries.op11_merkle_manifest(spark, sf))
    same(got, brute(rows(spark.read.parquet(f"{sf}/documents.parquet"))))
    same(got, duck(sf, M.SQL))


def test_bands_meet(spark, monkeypatch):
    """Trees of several bands, with a last node on its own on every level."""
    monkeypatch.setattr(M, "BAND", 2)
    monkeypatch.setattr(M, "BLOCK", 3)
    docs = [(i, f"text {i}", "a" if i % 9 else "b", "s", i) for i in range(1, 66)]
    df = spark.createDataFrame(docs, SCHEMA)
    same(rows(M.proofs(df)), brute(rows(df)))


def test_nulls_empties_ties_repeats_and_clashing_names(spark):
    docs = [(None, None, None, None, None)] * 2 + [(1, "", "", "", 0), (1, "", "", "", 0), (1, "x", "", None, None), (7, "ünï " * 9, "de", "-", -3), (-4, "é", "é", "s", 2), (10**15, "x" * 2_000_000, "de", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    clash = df.withColumns({c: F.lit(3) for c in ("leaf", "tree", "rank", "size", "root", "level", "lo", "path", "altered")})
    same(rows(M.proofs(clash)), brute(rows(df)))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(n)], SCHEMA)
    same(rows(M.proofs(df)), brute(rows(df))) if n else None
    assert M.proofs(df).count() == n


def test_nodes_cover_their_leaves_and_differences_are_found(spark, monkeypatch):
    monkeypatch.setattr(M, "BAND", 3)
    rng = random.Random(5)
    docs = [(i, f"t{rng.random()}", rng.choice(["en", "de"]), "s", 1) for i in range(200)]
    old = M.manifest(M.numbered(M.leaves(spark.createDataFrame(docs, SCHEMA)), "tree", ["doc_id", "leaf"]))
    for r in rows(old.where("level > 0")):
        assert r["lo"] % (1 << r["level"]) == 0 and r["hi"] == min(r["lo"] + (1 << r["level"]), r["size"])
    touched = {3, 77, 199}
    new = M.numbered(M.leaves(spark.createDataFrame([(d, t + "!" if d in touched else t, *x) for d, t, *x in docs], SCHEMA)), "tree", ["doc_id", "leaf"])
    found = M.changed(old, M.manifest(new)).join(new, ["tree"]).where("rank = lo")
    assert {r["doc_id"] for r in found.collect()} == touched
    assert M.changed(old, old).count() == 0
