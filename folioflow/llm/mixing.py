"""Mixing sources to target weights.

Every source is cut into ``blocks`` hash blocks. From the token sums of the blocks (at most sources x blocks rows, whatever
the corpus holds) the driver works out how often each block is used, splits the exact block quotas of all sources among the
output shards by a multivariate-hypergeometric tree, and deals each source's permuted blocks to the shards without overlap.
The last block of a source may be needed in part only; it is cut into blocks of its own by a second hash and dealt alike. What
the shards got says whether a source was cut, repeated or fell short. The documents then only meet a broadcast table of that
bounded size and are shuffled within their shard.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage

#: A run of word characters, or any other single character but white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SEED = 20_24
BLOCKS = 512  # of a source, and of the block of it that is used in part
SHARDS = 16


def token_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def block_of(blocks: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int")


def sized(documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, block, tokens)`` of the documents of the sources in ``targets``, without their text."""
    wanted = [r[0] for r in targets.select("source").distinct().collect() if r[0] is not None]  # a row a source
    return documents.where(F.col("source").isin(wanted) if wanted else F.lit(False)).select("doc_id", "source", block_of(blocks, seed).alias("block"), token_count().alias("tokens"))


def block_sums(docs: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """``[(block, tokens)]`` by source, of :func:`sized` documents; combined on the map side, at most sources x blocks rows."""
    out: dict[str, list[tuple[int, int]]] = {}
    for r in docs.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect():
        out.setdefault(r.source, []).append((r.block, r.tokens))
    return {k: sorted(v) for k, v in out.items()}


def plan(listed: dict[str, list[tuple[int, int]]], targets: DataFrame) -> list[dict]:
    """One row per row of ``targets``: what the source has and wants, in tokens.

    A null weight or null max_repeats counts as 0 and 1; a source named twice in ``targets`` gets a row each, from the same documents.
    """
    have = {k: sum(t for _, t in v) for k, v in listed.items()}
    total = sum(have.values())
    return [
        {"source": r.source, "weight": r.weight, "known": r.source in have, "tokens": have.get(r.source, 0), "wanted": (r.weight or 0.0) * total, "most": max(r.max_repeats if r.max_repeats is not None else 1, 1)}
        for r in targets.select("source", "weight", "max_repeats").collect()
    ]


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Shares of the quotas for each shard: rows are shards, and columns sum to the quotas exactly.

    Each node of the tree draws how many of each source's blocks go left, given how many blocks in all go left.
    """
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    size = int(quotas.sum())
    take = (size * left) // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if size else quotas * 0
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def deal(listed: dict[str, list[tuple[int, int]]], plans: list[dict], shards: int, seed: int) -> list[dict]:
    """A row for each use of a block: which row of the plan, source, copy, block and shard, and the tokens taken (``all`` of the block, or the rest that is wanted).

    Whole passes over a source are dealt first, then permuted blocks until nothing is wanted any more. Amounts are exact fractions.
    """
    rng = np.random.default_rng(seed)
    uses: list[list[dict]] = []
    for k, p in enumerate(plans):
        blocks = listed.get(p["source"], [])
        have, wanted = sum(t for _, t in blocks), Fraction(p["wanted"])
        copies = min(p["most"], int(wanted // have)) if have else 0
        order = lambda: [blocks[i] for i in rng.permutation(len(blocks))]  # noqa: E731, B023
        mine = [{"plan": k, "source": p["source"], "copy": c, "block": b, "take": Fraction(t), "all": True} for c in range(copies) for b, t in order()]
        rest = wanted - copies * have
        if copies < p["most"] and rest > 0:
            for b, t in order():
                mine.append({"plan": k, "source": p["source"], "copy": copies, "block": b, "take": min(Fraction(t), rest), "all": t <= rest})
                rest -= t
                if rest <= 0:
                    break
        uses.append(mine)
    shares = split_quotas(np.array([len(u) for u in uses], dtype=np.int64), shards, rng)
    out = []
    for k, mine in enumerate(uses):
        order, at = rng.permutation(len(mine)), 0
        for shard in range(shards):
            out += [{**mine[i], "shard": shard} for i in order[at : at + shares[shard, k]]]
            at += int(shares[shard, k])
    return out


def outcome_of(plans: list[dict], dealt: list[dict]) -> list[str]:
    """For each row of the plan: ``cut`` if the shards got what it wants in one pass, ``repeated`` in several, else ``short``, also without any document."""
    got, passes = [Fraction(0)] * len(plans), [0] * len(plans)
    for u in dealt:
        got[u["plan"]] += u["take"]
        passes[u["plan"]] = max(passes[u["plan"]], u["copy"] + 1)
    return ["short" if g < Fraction(p["wanted"]) or not p["known"] else "cut" if n <= 1 else "repeated" for p, g, n in zip(plans, got, passes)]


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """The mixture ``(shard, place, source, copy, doc_id, tokens)`` and the plan it follows, with each row's outcome.

    A document is used as a whole, and its tokens are counted once. The one block of a source that is used in part is cut into
    ``blocks`` smaller ones; only in the last of these, a blocks x blocks-th part of the source, are documents ordered by a
    hash and taken while their running sum stays within what is missing, so a source falls short of its share by less than a document.
    Documents with null or other sources take no part; empty or null texts have no tokens and ride along in their block;
    equal rows are rows of their own; other columns of ``documents`` are ignored. ``place`` is a random key within a shard.
    """
    docs = cut_lineage(sized(documents, targets, blocks, seed))  # read several times; the rows hold no text
    listed = block_sums(docs)
    plans = plan(listed, targets)
    dealt = deal(listed, plans, shards, seed)
    for p, outcome in zip(plans, outcome_of(plans, dealt)):
        p["outcome"] = outcome
    partly = [u for u in dealt if not u["all"]]  # at most one for each row of the plan
    columns = "plan int, source string, copy int, block int, shard int, keep double"
    row = lambda u, block, keep: (u["plan"], u["source"], u["copy"], block, u["shard"], keep)
    whole = spark.createDataFrame([row(u, u["block"], None) for u in dealt if u["all"]], columns)
    used = docs.join(F.broadcast(whole), ["source", "block"])  # bounded by len(targets) * blocks * max_repeats rows
    small = block_of(blocks, seed + 3)
    pieces = docs.join(F.broadcast(spark.createDataFrame([row(u, u["block"], None)[:5] for u in partly], columns.rsplit(",", 1)[0])), ["source", "block"])  # a row for each row of the plan
    sums: dict[int, list] = {}
    for r in pieces.groupBy("plan", small.alias("small")).agg(F.sum("tokens").alias("tokens")).collect():  # at most len(targets) * blocks rows
        sums.setdefault(r["plan"], []).append((r.small, r.tokens))
    parts = []
    for u in partly:
        rest = u["take"]
        for b, t in sorted(sums.get(u["plan"], [])):
            if rest <= 0:
                break
            parts.append((u["plan"], b, None if t <= rest else float(rest)))
            rest -= t
    pieces = pieces.withColumn("small", small).join(F.broadcast(spark.createDataFrame(parts, "plan int, small int, keep double")), ["plan", "small"])  # bounded by len(targets) * blocks rows
    within = Window.partitionBy("plan", "small").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = pieces.where("keep is not null").withColumn("run", F.sum("tokens").over(within)).where("run <= keep")
    place = F.xxhash64(F.lit(seed + 2), "copy", "doc_id").alias("place")
    pick = lambda df: df.select("shard", place, "source", "copy", "doc_id", "tokens")
    return pick(used).unionByName(pick(pieces.where("keep is null"))).unionByName(pick(last)), plans


def shuffled(rows: DataFrame) -> DataFrame:
    """The mixture in its final order: shard after shard, each in the order of its places.

    Rows are spread by ranges of both, so a large shard is sorted by several tasks and their files follow one another.
    """
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id")


def outcomes(spark: SparkSession, documents: DataFrame, targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``(source, outcome)``: what the blocks that :func:`mix` deals to the shards amount to."""
    listed = block_sums(sized(documents, targets, blocks, seed))
    plans = plan(listed, targets)
    found = outcome_of(plans, deal(listed, plans, shards, seed))
    return spark.createDataFrame([(p["source"], o) for p, o in zip(plans, found)], "source string, outcome string")


def shares(spark: SparkSession, documents: DataFrame, targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What :func:`mix` reaches: tokens and share of each source, and over how many shards they lie."""
    rows, plans = mix(spark, documents, targets, shards)
    got = rows.groupBy("source").agg(F.sum("tokens").alias("got"), F.count_distinct("shard").alias("in_shards"), F.max("copy").alias("last_copy"))
    wish = spark.createDataFrame(
        [(p["source"], p["weight"], float(p["wanted"]), p["outcome"]) for p in plans], "source string, weight double, wanted double, outcome string"
    )
    all_got = got.agg(F.sum("got").alias("all_got"))
    return (
        wish.join(F.broadcast(got), "source", "left")  # a row per source of the targets
        .crossJoin(F.broadcast(all_got))  # one row
        .select(
            "source", "weight", "wanted", "outcome", F.coalesce("got", F.lit(0)).alias("got"),
            F.coalesce(F.col("got") / F.col("all_got"), F.lit(0.0)).alias("share"),
            F.coalesce(F.col("last_copy") + 1, F.lit(0)).alias("passes"), F.coalesce("in_shards", F.lit(0)).alias("in_shards"),
        )
    )
