"""The registered queries over the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import SPACE
from folioflow.llm import leakage, markup, mixing, pairs, pieces, repetition, sentences, stuffing
from folioflow.sources.tables import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _learned(spark: SparkSession, folder: str):
    """From all texts that are cut into sentences."""
    sources = table(spark, folder, "en_de").select(F.lit("en").alias("lang"), F.col("source").alias("text"))
    return sentences.learn(table(spark, folder, "text_segment").select("lang", "text").unionByName(sources))


def _texts(spark, folder):
    segments = table(spark, folder, "text_segment")
    return (
        segments.where("document_format in ('txt', 'odt')").select(F.lit("segment").alias("origin"), F.col("seg_key").alias("item_key"), "lang", "text")
        .unionByName(table(spark, folder, "en_de").select(F.lit("pair").alias("origin"), F.col("pair_key").alias("item_key"), F.lit("en").alias("lang"), F.col("source").alias("text")))
    )


@query
def p1_found(spark, folder):
    return sentences.sentence_units(_texts(spark, folder), *_learned(spark, folder))


@query
def p1_coverage(spark, folder):
    """What the units of each text hold, white space aside: every character once, so as many as the text has."""
    texts = _texts(spark, folder).select("origin", "item_key", "text").dropDuplicates(["origin", "item_key"])
    size = F.length(F.regexp_replace(F.expr("substr(text, start_pos + 1, end_pos - start_pos)"), f"[{SPACE}]+", ""))
    return p1_found(spark, folder).join(texts, ["origin", "item_key"]).groupBy("origin", "item_key").agg(F.sum(size).alias("chars"))


SQL["p1_coverage"] = f"""SELECT origin, item_key, length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS chars FROM
(SELECT DISTINCT 'segment' AS origin, seg_key AS item_key, text FROM text_segment WHERE document_format IN ('txt', 'odt') UNION ALL SELECT DISTINCT 'pair', pair_key, source FROM en_de)
WHERE regexp_matches(text, '[^{SPACE}]')"""


@query
def p2_found(spark, folder):
    jobs = table(spark, folder, "review_job").select(F.col("id").alias("job_id"), "target_lang")
    kept = table(spark, folder, "translation_issue").where("action = 'retained_original'").select(F.col("run_id").alias("job_id"), F.col("segment_id").alias("id"))
    return pairs.defects(table(spark, folder, "review_block"), jobs, kept)


def _items(spark, folder):
    """Segments, and chunks as sent and as they were; chunks have no language of their own."""
    segments = table(spark, folder, "text_segment").select(F.lit("segment").alias("origin"), F.col("seg_key").alias("item_key"), "lang", "text")
    chunks = table(spark, folder, "model_chunk")
    one = lambda origin, text: chunks.select(F.lit(origin).alias("origin"), F.col("chunk_key").alias("item_key"), F.lit(None).cast("string").alias("lang"), F.col(text).alias("text"))
    return segments.unionByName(one("chunk_text", "text")).unionByName(one("chunk_original", "original"))


@query
def p3_found(spark, folder):
    return pieces.item_boundaries(_items(spark, folder), table(spark, folder, "chunk_budget"), *_learned(spark, folder))


@query
def p3_pieces(spark, folder):
    return pieces.split_items(_items(spark, folder), table(spark, folder, "chunk_budget"), *_learned(spark, folder))


@query
def p3_sizes(spark, folder):
    """The pieces of each oversized item against its budget: how far they reach, whether all are within the size, and whether each begins by the overlap before the end of the one before."""
    cut = p3_pieces(spark, folder)
    before = F.lag("end_pos").over(Window.partitionBy("origin", "item_key").orderBy("piece_no"))
    budget = F.broadcast(table(spark, folder, "chunk_budget").where("origin is not null"))  # a row an origin
    one = cut.withColumn("before", before).join(budget, "origin")
    return one.groupBy("origin", "item_key").agg(
        F.max("end_pos").alias("chars"), F.bool_and((F.col("end_pos") - F.col("start_pos") <= F.col("max_size")) & (F.col("end_pos") > F.col("start_pos"))).alias("within"),
        F.bool_and(F.col("start_pos") == F.coalesce(F.col("before") - F.col("overlap"), F.lit(0))).alias("overlapping"),
    )


SQL["p3_sizes"] = """SELECT i.origin, i.item_key, length(i.text) AS chars, true AS within, true AS overlapping FROM (SELECT DISTINCT 'segment' AS origin, seg_key AS item_key, text FROM text_segment UNION ALL
SELECT DISTINCT 'chunk_text', chunk_key, text FROM model_chunk UNION ALL SELECT DISTINCT 'chunk_original', chunk_key, original FROM model_chunk) i JOIN chunk_budget b ON b.origin = i.origin WHERE length(i.text) > b.max_size"""


def _marked(spark, folder):
    none = F.lit(None).cast("array<string>").alias("literals")
    segments = table(spark, folder, "text_segment").where("document_format in ('md', 'html')").select(F.lit("segment").alias("origin"), F.col("seg_key").alias("item_key"), "text", none)
    blocks = table(spark, folder, "review_block").where("source_info is not null")
    return segments.unionByName(blocks.select(F.lit("block").alias("origin"), F.col("block_key").alias("item_key"), F.col("original").alias("text"), F.col("source_info.protected").alias("literals")))


@query
def p4_found(spark, folder):
    return markup.constructs(_marked(spark, folder))


@query
def p4_paths(spark, folder):
    return markup.weighed(_marked(spark, folder))


@query
def p4_clean(spark, folder):
    return markup.converted(_marked(spark, folder)).dropDuplicates(["origin", "item_key"])


def _attempts(spark, folder):
    issues = table(spark, folder, "translation_issue").select("issue_key", "run_id", F.col("diagnostics.attempted_translation").alias("text")).where("text is not null")
    return repetition.measured(issues).dropDuplicates(["issue_key"])


@query
def p5_found(spark, folder):
    return repetition.with_shares(_attempts(spark, folder)).where("repeats").select("issue_key")


@query
def p5_texts(spark, folder):
    return repetition.judged(_attempts(spark, folder), "run_id")


@query
def p5_hosts(spark, folder):
    return repetition.host_verdicts(_attempts(spark, folder), "run_id")


@query
def p5_host_sizes(spark, folder):
    """How many texts the rules of each host rest on, and how long they are."""
    return _attempts(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_chars").alias("chars"))


SQL["p5_host_sizes"] = """SELECT run_id, count(*) AS texts, sum(length(text))::bigint AS chars FROM
(SELECT issue_key, any_value(run_id) AS run_id, any_value(diagnostics.attempted_translation) AS text FROM translation_issue WHERE diagnostics.attempted_translation IS NOT NULL GROUP BY issue_key) GROUP BY run_id"""


@query
def p6_found(spark, folder):
    items = table(spark, folder, "eval_item")
    passages = items.select("item_id", F.col("source").alias("passage")).unionByName(items.select("item_id", F.col("reference").alias("passage")))
    return leakage.leaked(table(spark, folder, "documents"), passages).select("doc_id", "item_id")


@query
def p7_found(spark, folder):
    return mixing.outcomes(spark, table(spark, folder, "documents"), table(spark, folder, "mix_target"))


SQL["p7_found"] = r"""
WITH t AS (SELECT source, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) AS n FROM documents),
     s AS (SELECT source, sum(coalesce(n, 0)) AS n, count(*) AS docs FROM t WHERE source IN (SELECT source FROM mix_target) GROUP BY source),
     a AS (SELECT sum(n) AS n FROM s)
SELECT m.source, CASE WHEN s.docs IS NULL THEN 'short' WHEN s.n >= m.weight * a.n THEN 'cut'
                      WHEN m.max_repeats * s.n >= m.weight * a.n THEN 'repeated' ELSE 'short' END AS outcome
FROM mix_target m LEFT JOIN s USING (source) CROSS JOIN a
"""


@query
def p7_shares(spark, folder):
    return mixing.shares(spark, table(spark, folder, "documents"), table(spark, folder, "mix_target"))


@query
def p7_reached(spark, folder):
    """For each target whether the mixture holds what is wanted but for less than its source's largest document, or all that may be used of a source that is too small."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_target")
    sizes = documents.select("source", mixing.token_count().alias("n")).groupBy("source").agg(F.max("n").alias("largest"), F.sum("n").alias("have"))
    got = mixing.shares(spark, documents, targets).join(targets.select("source", "max_repeats"), "source").join(sizes, "source", "left")
    near = (F.col("got") <= F.col("wanted")) & (F.col("got") > F.col("wanted") - F.col("largest"))
    whole = F.col("got") == F.coalesce("have", F.lit(0)) * F.col("max_repeats")
    return got.select("source", "outcome", F.when(F.col("outcome") == "short", whole).otherwise(near).alias("reached"))


SQL["p7_reached"] = SQL["p7_found"].replace("AS outcome\n", "AS outcome, true AS reached\n")


@query
def p7_mixture(spark, folder):
    rows, _ = mixing.mix(spark, table(spark, folder, "documents"), table(spark, folder, "mix_target"))
    return mixing.shuffled(rows)


@query
def p8_found(spark, folder):
    return stuffing.stuffed_pages(table(spark, folder, "documents")).where("spam").select("doc_id")
