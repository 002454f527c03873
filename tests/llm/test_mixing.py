import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixing
from folioflow.llm.mixing import deal, mix, outcome_of, outcomes, plan, shares, shuffled, split_quotas, token_count

TARGETS = "source string, weight double, max_repeats int"


def test_tokens_as_in_the_definition(spark):
    texts = ["Two words.", "a_b1 ü-ß", "", None, "… 3,5 €", "zero​width", "tab\there\n", "soft­hyphen", "漢字 かな", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [len(re.findall(r"[^\W]+|[^\w\s]", t or "")) for t in texts]
    assert [r[0] for r in df.select(token_count()).collect()] == want


def test_splitting_tree_is_exact():
    rng = np.random.default_rng(1)
    quotas = np.array([1_000, 0, 7, 53])
    for shards in (1, 2, 5, 16):
        parts = split_quotas(quotas, shards, rng)
        assert parts.shape == (shards, 4) and (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
        sizes = parts.sum(axis=1)
        assert sizes.max() - sizes.min() <= 2 * np.ceil(np.log2(max(shards, 2)))


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, "big" if k % 3 else "mid", "one two three four five " * (1 + k % 4), "x") for k in range(900)]
    rows += [(10_000 + k, "small", "a b c.", "x") for k in range(20)] + [(20_000, None, "no source", "x"), (20_001, "other", "not asked for", "x"), (20_002, "mid", None, "x"), (20_003, "mid", "", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 2), ("mid", 0.45, 3), ("small", 0.02, 50), ("none", 0.03, 4)], TARGETS)


def test_outcomes_and_shares(spark, documents, targets):
    assert {r.source: r.outcome for r in outcomes(spark, documents, targets).collect()} == {"big": "cut", "mid": "repeated", "small": "repeated", "none": "short"}
    got = {r.source: r for r in shares(spark, documents, targets, shards=4).collect()}
    for name in ("big", "mid", "small"):
        assert got[name].wanted - 25 < got[name].got <= got[name].wanted
    assert got["none"].got == 0 and got["none"].share == 0.0 and abs(sum(r.share for r in got.values()) - 1) < 1e-9


def test_mixture_repeats_no_document_within_a_pass(spark, documents, targets):
    rows, _ = mix(spark, documents, targets, shards=4)
    assert rows.groupBy("copy", "doc_id").count().where("count > 1").count() == 0
    most = {r.source: r.n for r in rows.groupBy("source").agg((F.max("copy") + 1).alias("n")).collect()}
    assert most["big"] == 1 and most["mid"] <= 3 and most["small"] <= 50
    again, _ = mix(spark, documents.repartition(7), targets, shards=4)
    assert rows.exceptAll(again).count() == 0 == again.exceptAll(rows).count()
    laid = shuffled(rows).select("shard", "place", "doc_id", F.spark_partition_id().alias("part")).collect()
    assert laid == sorted(laid, key=lambda r: (r.part, r.shard, r.place, r.doc_id)) == sorted(laid, key=lambda r: (r.shard, r.place, r.doc_id))


def test_cases_at_the_edge(spark, documents, targets):
    empty = documents.where("false")
    assert {r.outcome for r in outcomes(spark, empty, targets).collect()} == {"short"}
    assert mix(spark, empty, targets)[0].count() == 0 and mix(spark, documents, targets.where("false"))[0].count() == 0
    odd = spark.createDataFrame([("big", None, None), ("big", 0.1, 1), (None, 0.5, 1)], TARGETS)
    assert [r.outcome for r in outcomes(spark, documents, odd).collect()] == ["cut", "cut", "short"]
    listed = {"s": [(0, 60), (3, 40)]}

    def one(weight, most):
        plans = plan(listed, spark.createDataFrame([("s", weight, most)], TARGETS))
        return outcome_of(plans, deal(listed, plans, 3, 1))[0]

    assert (one(1.0, 1), one(1.01, 2), one(2.0, 2), one(2.01, 2), one(0.1, 1), one(3.0, 3)) == ("cut", "repeated", "repeated", "short", "cut", "repeated")


def test_what_is_dealt_decides(spark, documents, targets, monkeypatch):
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, rng: np.zeros((shards, len(quotas)), dtype=np.int64))  # the tree deals nothing
    assert {r.outcome for r in outcomes(spark, documents, targets).collect()} == {"short"}


def test_dealt_blocks_are_whole_and_disjoint():
    rng = np.random.default_rng(3)
    listed = {s: [(b, int(rng.integers(1, 90))) for b in range(40)] for s in "xyz"}
    plans = [{"source": s, "wanted": w, "most": m, "known": True} for s, w, m in (("x", 700.5, 1), ("y", 4_000.0, 5), ("z", 90_000.0, 2))]
    dealt = deal(listed, plans, 7, 5)
    assert len({(u["plan"], u["copy"], u["block"]) for u in dealt}) == len(dealt)
    assert sum(u["take"] for u in dealt if u["plan"] == 0) == 700.5 and sum(u["take"] for u in dealt if u["plan"] == 1) == 4_000
    assert sum(not u["all"] for u in dealt) <= 2 and outcome_of(plans, dealt) == ["cut", "repeated", "short"]
