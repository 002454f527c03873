from folioflow.functions import backends
from folioflow.operators import alignment, evaluation, odt
from folioflow.plans import aligned

EXAMPLES = "id string, category string, source string, reference string, criteria array<string>"


def examples(spark):
    rows = [(f"e{k}", "c", f"text {k}", "ref", [f"TEXT {k}", "none"]) for k in range(7)] + [("null", "c", None, None, None), ("bad", "c", "bad text", "ref", ["x"])]
    return spark.createDataFrame(rows, EXAMPLES)


def test_suites_in_one_call(spark):
    got = {r.id: r for r in evaluation.evaluate_suite(examples(spark), backends.failing("bad")).collect()}
    assert got["e3"].translated == "TEXT 3" and got["e3"].kept == [True, False]
    assert got["null"].translated is None and got["null"].kept == [] and got["bad"].error and got["bad"].translated is None and got["bad"].kept == [False]
    assert evaluation.evaluate_suite(examples(spark).where("false"), backends.upper).count() == 0


def test_reports_go_on_where_they_ended(spark, tmp_path):
    path = str(tmp_path / "report")
    assert evaluation.extend_report(examples(spark).where("id < 'e4' and id <> 'bad'"), path, backends.upper, at_a_time=2) == 4
    assert evaluation.extend_report(examples(spark), path, backends.upper, at_a_time=3) == 5
    assert evaluation.extend_report(examples(spark), path, backends.upper) == 0
    rows = spark.read.json(path)
    assert rows.count() == 9 == rows.select("id").distinct().count()


def test_inventory_of_packages(spark):
    good = odt.make_package([("heading", "head"), ("paragraph", "two"), ("paragraph", " ")])
    packages = spark.createDataFrame([(1, good), (2, b"none")], "id long, content binary")
    found = odt.odt_blocks(packages, "id", "content")
    assert [tuple(r) for r in evaluation.inventory_counts(found, "id").collect()] == [(1, 3, 2, 0, 1)]
    rows = {r.id: r for r in evaluation.evaluate_packages(found, aligned.translate_aligned_odt(packages, "id", "content", backends.failing("two")), "id").collect()}
    assert (rows[1].eligible, rows[1].retained, rows[1].formatting) == (2, 1, 0) and rows[2].error and rows[2].eligible == 0


def test_inventory_has_contexts_and_reasons(spark):
    good = odt.make_package([("heading", "head"), ("list_item", "two")])
    rows = odt.inventory(spark.createDataFrame([(1, good), (2, b"none"), (3, None)], "id long, content binary"), "id", "content").orderBy("block_no").collect()
    assert [(r.type, r.context.split("/", 2)[2], r.status) for r in rows] == [("heading", "office:text", "eligible"), ("list_item", "office:text/text:list/text:list-item", "eligible")]


def test_skipped_content_becomes_issues(spark):
    reason = sorted(odt.UNSUPPORTED)[0]
    rows = [(1, "1", "paragraph", reason, "lost words"), (1, "2", "paragraph", reason, " "), (1, "3", "paragraph", None, "fine"), (1, "4", "paragraph", "other", "not counted"), (2, None, None, None, None)]
    found = odt.skipped_issues(spark.createDataFrame(rows, "id long, segment_id string, type string, reason string, text string"), "id").collect()
    assert [(r.segment_id, r.action, r.reason, r.original) for r in found] == [("1", "skipped_content", reason, "lost words")]


def test_windows_that_meet_on_either_side(spark):
    rows = [(1, "a", 0, 5, 0, 5), (1, "b", 5, 9, 4, 9), (1, "c", 8, 12, 20, 30), (1, "d", 40, 50, 40, 50), (2, "a", 0, 5, 0, 5)]
    df = spark.createDataFrame(rows, "pair_key long, scope_id string, source_start int, source_end int, target_start int, target_end int")
    assert sorted(tuple(r) for r in alignment.window_conflicts(df).collect()) == [(1, "a", "b"), (1, "b", "a,c"), (1, "c", "b")]


def test_wrappers_are_read_where_they_were_put():
    up = backends.upper()
    assert aligned.translate_markdown("see <b>bold words</b> and <i>*all*</i> now", up) == ("SEE <b>BOLD WORDS</b> AND <i>*ALL*</i> NOW", [])
    glued = lambda texts: [("".join(t.split()), None) for t in texts]
    out, issues = aligned.translate_markdown("one _two_ three", glued)
    assert out == "onetwothree" and issues
    assert aligned.aligned_errors("a `b` <br> *c*", "x `b` <br> y") == [] and aligned.aligned_errors("a `b`", "a b") == ["rendered_alignment_mismatch"]


def test_deep_style_chains(spark):
    edges = spark.createDataFrame([(f"s{k}", f"s{k - 1}") for k in range(1, 61)] + [("x", "y"), ("y", "x"), ("s60", None), (None, "s1")], "style string, parent string")
    seeds = spark.createDataFrame([("s0",), (None,)], "style string")
    assert {r.style for r in odt.closure(edges, seeds).collect()} == {f"s{k}" for k in range(61)}
    assert odt.closure(edges.where("false"), seeds).count() == 1 and odt.closure(edges, seeds.where("false")).count() == 0


def test_fifth_marker_prefix(spark):
    import hashlib

    from pyspark.sql import functions as F

    from folioflow.operators import markers

    prefixes = ["DLM" + hashlib.sha256(f"DLM:{k}".encode()).hexdigest()[:32].upper() for k in range(8)]
    rows = [(" ".join(prefixes[:n]),) for n in range(8)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(markers.marker_prefix(F.col("t"))).collect()]
    assert got == prefixes
