import random

from pyspark.sql import functions as F

from folioflow.operators import intervals as iv

SPANS = "array<struct<start_pos:int,end_pos:int>>"


def test_checks_gaps_and_extraction(spark):
    rows = [(0, "abcdef", [(1, 3), (4, 6)]), (1, "abcdef", []), (2, "abcdef", None), (3, "abcdef", [(0, 6)]), (4, "abc", [(0, 2), (1, 3)]), (5, "abc", [(2, 9)]), (6, "", []), (7, "aä😀b", [(2, 3)])]
    df = spark.createDataFrame(rows, f"id long, text string, spans {SPANS}")
    got = {r.id: r for r in df.select("id", iv.ordered_spans(F.col("spans"), F.length("text")).alias("ok"), iv.extracted(F.col("text"), F.col("spans")).alias("rest")).collect()}
    assert [got[i].ok for i in range(8)] == [True, True, True, True, False, False, True, True]
    assert [got[i].rest for i in (0, 1, 2, 3, 6, 7)] == ["ad", "abcdef", "abcdef", "", "", "aäb"]


def test_partition_against_characters(spark):
    rng = random.Random(3)
    items, a, b, want = [], [], [], {}
    for i in range(200):
        n = rng.randint(0, 12)
        items.append((i, n))
        kinds = ["text"] * n
        for rows, kind in ((b, "protected"), (a, "syntax")):
            for _ in range(rng.randint(0, 3)):
                s = rng.randint(0, n)
                e = rng.randint(s, n)
                rows.append((i, s, e))
                for k in range(s, e):
                    kinds[k] = kind
        want[i] = [(k, len(list(g))) for k, g in __import__("itertools").groupby(kinds)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, start_pos int, end_pos int")
    found = iv.partition(spark.createDataFrame(items, "id long, n int"), "id", "n", {"syntax": frame(a), "protected": frame(b)})
    got = {}
    for r in found.orderBy("id", "part_no").collect():
        got.setdefault(r.id, []).append((r.kind, r.end_pos - r.start_pos))
    assert {i: got.get(i, []) for i, _ in items} == want


def test_merging_over_white_space_and_difference(spark):
    spans = spark.createDataFrame([(1, "aa bb, cc", 0, 2), (1, "aa bb, cc", 3, 5), (1, "aa bb, cc", 7, 9)], "id long, text string, start_pos int, end_pos int")
    assert sorted((r.start_pos, r.end_pos) for r in iv.merged_runs(spans, ["id"], "text").collect()) == [(0, 5), (7, 9)]
    cuts = spark.createDataFrame([(1, 2, 4), (1, 3, 5), (1, 8, 20)], "id long, start_pos int, end_pos int")
    whole = spark.createDataFrame([(1, 0, 10), (2, 0, 3)], "id long, start_pos int, end_pos int")
    left = sorted((r.id, r.start_pos, r.end_pos) for r in iv.difference(whole, cuts, ["id"]).collect())
    assert left == [(1, 0, 2), (1, 5, 8), (2, 0, 3)]


def test_overlap_join_keeps_the_key_as_an_equality(spark):
    a = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "id long, start_pos int, end_pos int")
    joined = iv.overlapping(a, a, ["id"])
    assert joined.count() == 2
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_laminar(spark):
    kind = "array<struct<outer_start:int,inner_start:int,inner_end:int,outer_end:int>>"
    rows = [(0, [(0, 2, 8, 10), (3, 4, 5, 6)], True), (1, [(0, 2, 8, 10), (9, 9, 11, 12)], False), (2, [(0, 1, 2, 3), (3, 4, 5, 6)], True), (3, [(3, 4, 5, 6), (0, 1, 2, 3)], False), (4, [], True), (5, [(2, 2, 2, 2)], False)]
    df = spark.createDataFrame(rows, f"id long, r {kind}, want boolean")
    assert df.where(iv.laminar(F.col("r")) != F.col("want")).count() == 0


def test_laminar_against_all_pairs(spark):
    import random

    rng = random.Random(4)

    def one():
        out = []
        for _ in range(rng.randint(0, 5)):
            a, b, c, d = sorted(rng.randint(0, 12) for _ in range(4))
            out.append((a, b, c, d))
        return sorted(out, key=lambda r: (r[0], -r[3])) if rng.random() < 0.8 else out

    def want(ranges):
        fine = all(a < d for a, _, _, d in ranges)
        return fine and all((y[0] >= x[3] or (y[0] >= x[1] and y[3] <= x[2])) and x[0] <= y[0] for k, x in enumerate(ranges) for y in ranges[k + 1 :])

    rows = [(r, want(r)) for r in (one() for _ in range(400))]
    df = spark.createDataFrame(rows, "r array<struct<outer_start:int,inner_start:int,inner_end:int,outer_end:int>>, want boolean")
    assert df.where(iv.laminar(F.col("r")) != F.col("want")).count() == 0 and {w for _, w in rows} == {True, False}
