from collections import Counter

import pytest

import corpus_pipeline as C
from tidemark.llm import common, mix_sources, toxicity_chain

from .test_bagminhash import brute_classes
from .test_decontaminate import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(C.STAGES)
    assert list(stage) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    one = stage["toxicity"](spark, docs, SF).cache()
    assert one.columns == docs.columns
    flagged = [r.doc_id for r in toxicity_chain.scored(docs, labels).where("toxic").collect()]
    assert ids(one) == sorted(set(ids(docs)) - set(flagged))

    two = stage["near_dedup"](spark, one, SF).cache()
    assert two.columns == docs.columns
    rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    assert ids(two) == sorted({c for _, c in brute_classes(rows)})

    three = stage["decontamination"](spark, two, SF).cache()
    assert three.columns == docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in brute([tuple(r) for r in two.select("doc_id", "text").collect()], bench)}
    assert ids(three) == sorted(set(ids(two)) - held)

    four = stage["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns
    want = Counter()
    for r in mix_sources.taken(three).collect():
        want[r.doc_id] += int(r.taken / r.size + 0.5) if r.size else 1
    assert Counter(ids(four)) == +want

    five = stage["sharding"](spark, four, SF).cache()
    assert Counter(ids(five)) == Counter(ids(four))
    n = Counter(r.shard for r in five.collect())
    assert max(n.values()) - min(n[s] for s in range(8)) <= 1


def test_run_is_the_stages(spark):
    a, b = (C.run(spark, SF) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert "text" not in a.columns and {"doc_id", "shard", "slot"} <= set(a.columns)


def test_stages_take_nulls_ties_and_empty_tables(spark):
    data = [(1, None, None, None, None), (None, "a b c d e f", "en", None, 1), (2, "", "en", "s", 0), (3, "same words here in both rows", "en", "s", 1), (3, "same words here in both rows", "en", "s", 1), (4, "long " * 30_000, "en", "t", 1)]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in C.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
