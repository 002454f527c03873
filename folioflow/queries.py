"""The registered queries over the document-processing operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import SENTENCE, SENTENCE_END, SPACE, WORD, joined
from folioflow.functions import backends
from folioflow.functions.arrow import flat_map
from folioflow.operators import alignment, chunking, evaluation, glossary, html_text, intervals, issues, markdown, markers, model_input, odt, review, text_blocks
from folioflow.plans import aligned, finalize, review_jobs, translate
from folioflow.sources.tables import latest, read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- plain text -------------------------------------------------------------------------------------------------------


def _plain_jobs(spark, folder):
    jobs = latest(table(spark, folder, "review_job").where("document_format = 'txt'").select("id", "source", "source_sha256", "loaded_at"), "id")
    return jobs.select("id", F.col("source").cast("string").alias("text"), "source_sha256")


_LINES = r"""
lines AS (SELECT id, unnest(regexp_extract_all(regexp_replace(decode(source), '^\x{feff}', ''), '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+')) AS line,
                 generate_subscripts(regexp_extract_all(regexp_replace(decode(source), '^\x{feff}', ''), '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+'), 1) AS n
          FROM (SELECT DISTINCT id, source FROM review_job WHERE document_format = 'txt')),
f0 AS (SELECT *, regexp_replace(line, '[\r\n]+$', '') AS body FROM lines),
f1 AS (SELECT *, regexp_matches(body, '(?s)^[ \t]*([-*•]|[0-9]+[.)])[ \t]+[^{S}].*$') AS item, NOT regexp_matches(line, '[^{S}]') AS blank,
              len(regexp_extract_all(line, '[^{S}]+')) AS words FROM f0),
f2 AS (SELECT *, last_value(CASE WHEN item THEN true WHEN blank THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx,
              lag(blank) OVER w AS pblank, lag(line) OVER w AS pline, lead(words) OVER w AS nwords, lead(item) OVER w AS nitem FROM f1 WINDOW w AS (PARTITION BY id ORDER BY n)),
f3 AS (SELECT *, NOT blank AND NOT item AND NOT coalesce(ctx, false) AND (coalesce(pblank, true) OR regexp_matches(regexp_replace(pline, '[{S}]+$', ''), '[.!?]$'))
              AND words BETWEEN 1 AND 6 AND length(body) <= 60 AND regexp_matches(body, '^\p{Lu}') AND NOT regexp_matches(body, '[.,;!?]$') AND coalesce(nwords >= 10 AND NOT nitem, false) AS heading FROM f2),
f4 AS (SELECT *, blank OR item OR heading OR coalesce(pblank OR lag(heading) OVER w, true) AS begins FROM f3 WINDOW w AS (PARTITION BY id ORDER BY n)),
f5 AS (SELECT *, (sum(begins::int) OVER (PARTITION BY id ORDER BY n))::bigint AS b, CASE WHEN item THEN regexp_extract(body, '^[ \t]*([-*•]|[0-9]+[.)])[ \t]+') ELSE '' END AS px FROM f4),
blocks AS (SELECT id, b AS block_no, bool_or(blank) AS blank, bool_or(heading) AS heading, max(CASE WHEN begins THEN px END) AS prefix, max(CASE WHEN begins THEN line END) AS first,
                  string_agg(CASE WHEN begins THEN substr(line, length(px) + 1) ELSE line END, '' ORDER BY n) AS whole FROM f5 GROUP BY id, b)
""".replace("{S}", SPACE)

_KIND = "CASE WHEN blank THEN NULL WHEN heading THEN 'heading' WHEN prefix = '' THEN 'paragraph' WHEN regexp_matches(prefix, '[-*•]') THEN 'bullet_item' ELSE 'numbered_item' END"


@query(f"""WITH {_LINES} SELECT id, block_no, CASE WHEN NOT blank THEN (sum((NOT blank)::int) OVER (PARTITION BY id ORDER BY block_no))::bigint END AS seg_no, {_KIND} AS type,
CASE WHEN blank THEN first ELSE prefix END AS prefix, CASE WHEN NOT blank THEN whole END AS text, CASE WHEN blank THEN '' ELSE regexp_extract(whole, '[\\r\\n]*$') END AS ending FROM blocks""")
def txt_blocks(spark, folder):
    return text_blocks.text_blocks(_plain_jobs(spark, folder), "id", "text")


@query(f"WITH {_LINES} SELECT {_KIND} AS type, count(*) AS blocks, sum(length(whole))::bigint AS chars FROM blocks WHERE NOT blank GROUP BY ALL")
def txt_block_types(spark, folder):
    blocks = text_blocks.text_blocks(_plain_jobs(spark, folder), "id", "text").where("text is not null")
    return blocks.groupBy("type").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query("SELECT DISTINCT id, true AS same FROM review_job WHERE document_format = 'txt'")
def txt_rewrite_identity(spark, folder):
    """Blocks written back with their own texts give the source again, byte for byte (its hash)."""
    jobs = _plain_jobs(spark, folder)
    blocks = text_blocks.text_blocks(jobs, "id", "text")
    written = text_blocks.rewritten(blocks, "id", F.col("text"))
    hashed = F.sha2(F.concat(F.when(F.col("text").startswith(text_blocks.BOM), text_blocks.BOM).otherwise(""), "document").cast("binary"), 256)
    return jobs.join(written, "id").select("id", (hashed == F.col("source_sha256")).alias("same"))


@query(f"""WITH {_LINES}, s AS (SELECT id AS job_id, row_number() OVER (PARTITION BY id ORDER BY block_no) AS seg_no, {_KIND} AS type, whole FROM blocks WHERE NOT blank),
r AS (SELECT DISTINCT b.job_id, b.id, b.type, b.original FROM review_block b JOIN review_job j ON j.id = b.job_id WHERE j.document_format = 'txt')
SELECT coalesce(s.job_id, r.job_id) AS job_id, count(*) FILTER (r.id IS NULL) AS missing, count(*) FILTER (s.seg_no IS NULL) AS extra,
       count(*) FILTER (s.seg_no IS NOT NULL AND r.id IS NOT NULL AND (s.type <> r.type OR s.whole <> r.original)) AS changed
FROM s FULL JOIN r ON s.job_id = r.job_id AND s.seg_no::varchar = r.id GROUP BY 1""")
def review_inventory(spark, folder):
    """Stored blocks against a fresh extraction from the snapshot, by job: both ways, so nothing is lost or added unseen."""
    blocks = text_blocks.text_blocks(_plain_jobs(spark, folder), "id", "text").where("text is not null").selectExpr("id as s_job", "cast(seg_no as string) as s_id", "type as s_type", "text as s_text")
    jobs = table(spark, folder, "review_job").where("document_format = 'txt'").select(F.col("id").alias("job_id")).distinct()
    stored = table(spark, folder, "review_block").select("job_id", "id", "type", "original").dropDuplicates(["job_id", "id"]).join(jobs, "job_id", "left_semi")
    both = blocks.join(stored, (F.col("s_job") == F.col("job_id")) & (F.col("s_id") == F.col("id")), "full_outer")
    present = F.col("s_id").isNotNull() & F.col("id").isNotNull()
    return both.groupBy(F.coalesce("s_job", "job_id").alias("job_id")).agg(
        F.count_if(F.col("id").isNull()).alias("missing"), F.count_if(F.col("s_id").isNull()).alias("extra"),
        F.count_if(present & ((F.col("s_type") != F.col("type")) | (F.col("s_text") != F.col("original")))).alias("changed"),
    )


@query()
def txt_reflow(spark, folder):
    """Proposals of plain text wrapped to the width of their sources, by jobs and blocks."""
    jobs = table(spark, folder, "review_job").where("document_format = 'txt'").select(F.col("id").alias("job_id")).distinct()
    blocks = table(spark, folder, "review_block").select("job_id", "id", "original", "proposal").dropDuplicates(["job_id", "id"]).join(jobs, "job_id", "left_semi")
    one_line = F.regexp_replace(F.col("proposal"), r"[\r\n]+", " ")
    return text_blocks.reflow(blocks.select("job_id", "id", F.col("original").alias("text"), one_line.alias("translated"), F.lit("").alias("prefix")), ["job_id", "id"])


def _delivered(spark, folder, *columns):
    """Segments as often as they were delivered; for what is mapped to small rows first and made distinct by those."""
    return table(spark, folder, "text_segment").select("seg_key", *columns)


def _segments(spark, folder, *columns):
    """Segments once each; for queries whose result is as large as the texts."""
    return _delivered(spark, folder, *columns).dropDuplicates(["seg_key"])


@query("""SELECT seg_key, run_id, seg_no, CASE WHEN type = 'paragraph' THEN (sum((type = 'paragraph')::int) OVER (PARTITION BY run_id ORDER BY seg_no))::bigint END AS paragraph_number
FROM (SELECT DISTINCT seg_key, run_id, seg_no, type FROM text_segment)""")
def paragraph_numbering(spark, folder):
    segments = _segments(spark, folder, "run_id", "seg_no", "type")
    return text_blocks.paragraph_numbers(segments, "run_id", "seg_no").drop("type")


# ---- sentences and chunks ---------------------------------------------------------------------------------------------

_PARTS = rf"""
s AS (SELECT DISTINCT seg_key, text FROM text_segment WHERE text IS NOT NULL),
x AS (SELECT seg_key, unnest(regexp_extract_all(text, '{SENTENCE.replace("'", "''")}')) AS whole, generate_subscripts(regexp_extract_all(text, '{SENTENCE.replace("'", "''")}'), 1) - 1 AS part_no FROM s),
parts AS (SELECT seg_key, part_no, CASE WHEN regexp_matches(whole, '{SENTENCE_END.replace("'", "''")}') THEN regexp_replace(whole, '[{SPACE}]+$', '') ELSE whole END AS part,
                 CASE WHEN regexp_matches(whole, '{SENTENCE_END.replace("'", "''")}') THEN regexp_extract(whole, '[{SPACE}]+$') ELSE '' END AS separator FROM x)
"""


def _parts(spark, folder):
    return chunking.sentence_parts(_segments(spark, folder, "text"), ["seg_key"], "text")


@query(f"WITH {_PARTS} SELECT * FROM parts")
def sentence_split(spark, folder):
    return _parts(spark, folder)


@query("SELECT DISTINCT seg_key, text FROM text_segment WHERE length(text) > 0")
def reassembly_identity(spark, folder):
    """The parts of each text put together again."""
    parts = _parts(spark, folder)
    return parts.groupBy("seg_key").agg(joined(F.concat("part", "separator"), F.col("part_no")).alias("text"))


@query(f"""WITH {_PARTS} SELECT lang, document_format, count(*) AS sentences, sum(length(part))::bigint AS chars, max(length(part)) AS longest
FROM parts JOIN (SELECT DISTINCT seg_key, lang, document_format FROM text_segment) USING (seg_key) GROUP BY ALL""")
def sentence_stats(spark, folder):
    """Sentences by language and format. Each text becomes three numbers where it lies; only they cross a shuffle."""
    size = F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda x: F.length(F.when(x.rlike(SENTENCE_END), F.regexp_replace(x, rf"[{SPACE}]+$", "")).otherwise(x)))
    sizes = _delivered(spark, folder, "lang", "document_format", size.alias("sizes")).where("size(sizes) > 0")
    one = sizes.select("seg_key", "lang", "document_format", F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("sum"), F.array_max("sizes").alias("most")).dropDuplicates(["seg_key"])
    return one.groupBy("lang", "document_format").agg(F.sum("n").alias("sentences"), F.sum("sum").alias("chars"), F.max("most").alias("longest"))


@query(f"""WITH {_PARTS} SELECT seg_key, part_no, ((sum(length(part) + length(separator)) OVER (PARTITION BY seg_key ORDER BY part_no)) - length(part) - length(separator))::bigint AS start_pos,
((sum(length(part) + length(separator)) OVER (PARTITION BY seg_key ORDER BY part_no)) - length(separator))::bigint AS end_pos FROM parts""")
def chunk_offsets(spark, folder):
    """From the lengths of the parts alone: they are made distinct and summed without their texts."""
    parts = chunking.sentence_parts(_delivered(spark, folder, "text"), ["seg_key"], "text")
    sizes = parts.select("seg_key", "part_no", F.length("part").alias("part"), F.length("separator").alias("separator")).dropDuplicates(["seg_key", "part_no"])
    located = chunking.chunk_offsets(sizes, ["seg_key"], "part_no", F.col("part"), F.col("separator"))
    return located.select("seg_key", "part_no", "start_pos", "end_pos")


@query()
def budget_chunks(spark, folder):
    """Sentences cut to at most 120 characters at white space; recursive, so SQL has no counterpart."""
    parts = _parts(spark, folder)
    return chunking.budget_chunks(parts, ["seg_key", "part_no"], "part", 120)


@query("SELECT DISTINCT seg_key, text, true AS fits FROM text_segment WHERE length(text) > 0")
def budget_reassembly(spark, folder):
    """Whole texts cut to at most 120 characters and put together again: nothing is lost, and every part fits."""
    cut = chunking.budget_chunks(_segments(spark, folder, "text").where("length(text) > 0"), ["seg_key"], "text", 120)
    whole = joined(F.concat(F.coalesce("part", F.lit("")), "separator"), F.col("chunk_no")).alias("text")
    return cut.groupBy("seg_key").agg(whole, F.bool_and(F.coalesce(F.length("part"), F.lit(0)) <= 120).alias("fits"))


@query(f"""SELECT seg_key, count(*) AS words, count(*) FILTER (regexp_matches(w, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')) AS letters FROM
(SELECT seg_key, unnest(regexp_extract_all(text, '{WORD}')) AS w FROM (SELECT DISTINCT seg_key, text FROM text_segment)) GROUP BY seg_key""")
def word_counts(spark, folder):
    tokens = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    counted = _delivered(spark, folder, F.size(tokens).alias("words"), F.size(F.filter(tokens, lambda w: w.rlike(r"[\p{L}\p{N}\p{M}_]"))).alias("letters"))
    return counted.dropDuplicates(["seg_key"]).where("words > 0")  # in this order, as a filter below would cut the words once more


# ---- intervals --------------------------------------------------------------------------------------------------------

_SPANS = "s AS (SELECT seg_key, any_value(text) AS text, any_value(protected_spans) AS spans FROM text_segment GROUP BY seg_key), p AS (SELECT seg_key, unnest(spans) AS x FROM s)"


def _protected(spark, folder):
    return _segments(spark, folder, "text", "protected_spans")


@query(f"""WITH {_SPANS}, q AS (SELECT seg_key, x.start_pos AS a, x.end_pos AS b, lag(x.end_pos) OVER (PARTITION BY seg_key ORDER BY x.start_pos, x.end_pos) AS before FROM p)
SELECT seg_key, length(text) AS chars, coalesce(len(spans), 0) AS spans, coalesce((SELECT bool_and(a >= 0 AND a < b AND b <= length(text) AND coalesce(before <= a, true)) FROM q WHERE q.seg_key = s.seg_key), true) AS sound FROM s""")
def span_validation(spark, folder):
    size = F.coalesce(F.size(F.when(F.col("protected_spans").isNotNull(), F.col("protected_spans"))), F.lit(0))
    rows = _delivered(spark, folder, F.length("text").alias("chars"), size.alias("spans"), intervals.ordered_spans(F.col("protected_spans"), F.length("text")).alias("sound"))
    return rows.dropDuplicates(["seg_key"])


@query(f"""WITH {_SPANS}, e AS (SELECT seg_key, x.start_pos AS a, x.end_pos AS b, 'protected' AS kind FROM p UNION ALL
SELECT seg_key, coalesce(lag(x.end_pos) OVER (PARTITION BY seg_key ORDER BY x.start_pos), 0), x.start_pos, 'text' FROM p UNION ALL
SELECT seg_key, coalesce((SELECT max(x.end_pos) FROM p WHERE p.seg_key = s.seg_key), 0), length(text), 'text' FROM s),
m AS (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY seg_key ORDER BY a), '') AS fresh FROM e WHERE a < b),
n AS (SELECT *, (sum(fresh::int) OVER (PARTITION BY seg_key ORDER BY a))::bigint AS part_no FROM m)
SELECT seg_key, part_no, min(a) AS start_pos, max(b) AS end_pos, kind FROM n GROUP BY seg_key, part_no, kind""")
def interval_partition(spark, folder):
    segments = _delivered(spark, folder, F.length("text").alias("chars"), "protected_spans").where("chars is not null").dropDuplicates(["seg_key"])
    spans = segments.select("seg_key", F.explode("protected_spans").alias("p")).select("seg_key", "p.start_pos", "p.end_pos")
    return intervals.partition(segments.select("seg_key", "chars"), "seg_key", "chars", {"protected": spans})


@query(f"""WITH {_SPANS}, e AS (SELECT seg_key, coalesce(lag(x.end_pos) OVER (PARTITION BY seg_key ORDER BY x.start_pos), 0) AS a, x.start_pos AS b FROM p UNION ALL
SELECT seg_key, coalesce((SELECT max(x.end_pos) FROM p WHERE p.seg_key = s.seg_key), 0), length(text) FROM s)
SELECT s.seg_key, string_agg(substr(s.text, e.a + 1, e.b - e.a), '' ORDER BY e.a) AS visible FROM s JOIN e USING (seg_key) WHERE len(spans) > 0 GROUP BY s.seg_key""")
def visible_text(spark, folder):
    """Texts without their protected spans, by array functions within the row: no shuffle but that for redelivered rows."""
    return _protected(spark, folder).where("size(protected_spans) > 0").select("seg_key", intervals.extracted(F.col("text"), F.col("protected_spans")).alias("visible"))


@query("""WITH c AS (SELECT DISTINCT chunk_key, run_id, segment_id, original, source_spans FROM model_chunk),
s AS (SELECT DISTINCT run_id, id, text FROM text_segment)
SELECT chunk_key, len(source_spans) AS spans, original = list_aggregate(list_transform(source_spans, lambda p: substr(text, p.start_pos + 1, p.end_pos - p.start_pos)), 'string_agg', '') AS same
FROM c JOIN s ON c.run_id = s.run_id AND c.segment_id = s.id WHERE len(source_spans) > 0""")
def chunk_sources(spark, folder):
    """Whether each chunk's original is the slices of its segment that its spans name."""
    chunks = table(spark, folder, "model_chunk").select("chunk_key", "run_id", "segment_id", "original", "source_spans").where("size(source_spans) > 0").dropDuplicates(["chunk_key"])
    segments = table(spark, folder, "text_segment").select("run_id", F.col("id").alias("segment_id"), "text").dropDuplicates(["run_id", "segment_id"])
    cut = F.array_join(F.transform("source_spans", lambda p: F.substring(F.col("text"), p["start_pos"] + 1, p["end_pos"] - p["start_pos"])), "")
    return chunks.join(segments, ["run_id", "segment_id"]).select("chunk_key", F.size("source_spans").alias("spans"), (F.col("original") == cut).alias("same"))


# ---- markers and glossary ---------------------------------------------------------------------------------------------

#: A small glossary of the test documents' trade; fixed values.
TERMS = [
    ("floor sensor", "translate", "Bodensensor"), ("signal cable", "translate", "Signalkabel"), ("relief valve", "annotate", "Überdruckventil"),
    ("valve", "translate", "Ventil"), ("power module", "translate", "Leistungsmodul"), ("memory module", "translate", "Speichermodul"), ("module", "keep", None),
    ("seal ring", "translate", "Dichtring"), ("feed pump", "translate", "Förderpumpe"), ("night crew", "annotate", "Nachtschicht"), ("shift manager", "keep", None),
    ("shift", "translate", "Schicht"), ("storage tank", "translate", "Vorratsbehälter"), ("heat exchanger", "translate", "Wärmetauscher"), ("exchanger", "translate", "Tauscher"),
]


def _glossary(spark):
    return spark.createDataFrame(TERMS, "source string, mode string, target string")


_HASHES = "list_transform([0, 1, 2, 3], lambda k: 'DLM' || upper(substr(sha256('DLM:' || k), 1, 32)))"


@query(f"""SELECT chunk_key, list_filter({_HASHES}, lambda p: NOT contains(lower(text), lower(p)))[1] AS prefix,
len(regexp_extract_all(text, 'DLM[0-9A-F]{{32}}X[0-9]+Z')) AS found FROM (SELECT DISTINCT chunk_key, text FROM model_chunk WHERE text IS NOT NULL)""")
def marker_prefixes(spark, folder):
    """The free marker prefix of each chunk, and how many markers it holds already."""
    chunks = table(spark, folder, "model_chunk").where("text is not null").select("chunk_key", "text").dropDuplicates(["chunk_key"])
    return chunks.select("chunk_key", markers.marker_prefix(F.col("text")).alias("prefix"), F.size(F.regexp_extract_all("text", F.lit("DLM[0-9A-F]{32}X[0-9]+Z"), F.lit(0))).alias("found"))


@query("""SELECT marker, count(*) AS times, count(DISTINCT chunk_key) AS chunks FROM
(SELECT chunk_key, unnest(regexp_extract_all(text, 'DLM[0-9A-F]{32}X[0-9]+Z')) AS marker FROM (SELECT DISTINCT chunk_key, text FROM model_chunk)) GROUP BY marker""")
def marker_bag_counts(spark, folder):
    found = table(spark, folder, "model_chunk").select("chunk_key", "text").dropDuplicates(["chunk_key"]).select("chunk_key", F.explode(F.regexp_extract_all("text", F.lit("DLM[0-9A-F]{32}X[0-9]+Z"), F.lit(0))).alias("marker"))
    return found.groupBy("marker").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("chunk_key").alias("chunks"))


@query("""WITH p AS (SELECT DISTINCT pair_key, source, target, markers, marker_prefix FROM en_de WHERE marker_prefix IS NOT NULL),
f AS (SELECT *, regexp_extract_all(source, marker_prefix || 'X[0-9]+Z') AS a, regexp_extract_all(target, marker_prefix || 'X[0-9]+Z') AS b FROM p)
SELECT pair_key, coalesce(len(markers), 0) AS registered, list_sort(a) = list_sort(coalesce(markers, [])) AS source_ok, list_sort(b) = list_sort(coalesce(markers, [])) AS target_ok FROM f""")
def registered_markers(spark, folder):
    """Whether both sides of a pair hold exactly the registered markers."""
    pairs = table(spark, folder, "en_de").where("marker_prefix is not null").select("pair_key", "source", "target", "markers", "marker_prefix").dropDuplicates(["pair_key"])
    known = F.coalesce("markers", F.array().cast("array<string>"))
    side = lambda c: markers.same_bag(markers.found_markers(F.col(c), F.col("marker_prefix")), known)
    return pairs.select("pair_key", F.size(known).alias("registered"), side("source").alias("source_ok"), side("target").alias("target_ok"))


_PATTERN = glossary.term_pattern([t[0] for t in TERMS])


@query(f"""SELECT seg_key, match_no, term FROM (SELECT seg_key, unnest(m) AS term, generate_subscripts(m, 1) - 1 AS match_no FROM
(SELECT seg_key, regexp_extract_all(lower(text), '{_PATTERN}') AS m FROM (SELECT DISTINCT seg_key, text FROM text_segment)))""")
def glossary_longest_match(spark, folder):
    return glossary.matched_terms(_delivered(spark, folder, "text"), ["seg_key"], "text", [t[0] for t in TERMS]).dropDuplicates(["seg_key", "match_no"])


@query(f"""SELECT term AS source, count(*) AS matches, count(DISTINCT seg_key) AS segments FROM (SELECT seg_key, unnest(regexp_extract_all(lower(text), '{_PATTERN}')) AS term
FROM (SELECT DISTINCT seg_key, text FROM text_segment)) GROUP BY term""")
def glossary_hits(spark, folder):
    """Matches by the index, which folds letters exactly; on these texts it agrees with the regular expression."""
    found = glossary.matches(_delivered(spark, folder, "text"), ["seg_key"], "text", _glossary(spark)).dropDuplicates(["seg_key", "start_pos"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("seg_key").alias("segments"))


@query("""WITH e(source, mode, target) AS (VALUES ('Valve','translate','Ventil'),('valve','keep',NULL),(' pump','translate','Pumpe'),('ring','translate',NULL),('tank','keep','Tank'),('arm','swap','Arm'),('','keep',NULL),('coil','keep',NULL)),
s AS (SELECT source, CASE WHEN trim(source) = '' THEN 'empty_source' WHEN source <> trim(source) THEN 'source_not_trimmed' WHEN mode NOT IN ('keep','translate','annotate') THEN 'unknown_mode'
 WHEN mode = 'keep' AND target IS NOT NULL THEN 'target_with_keep' WHEN mode <> 'keep' AND coalesce(trim(target), '') = '' THEN 'missing_target' END AS error FROM e)
SELECT * FROM s WHERE error IS NOT NULL UNION ALL SELECT min(source), 'duplicate_source' FROM e GROUP BY lower(source) HAVING count(*) > 1""")
def glossary_errors(spark, folder):
    entries = [("Valve", "translate", "Ventil"), ("valve", "keep", None), (" pump", "translate", "Pumpe"), ("ring", "translate", None), ("tank", "keep", "Tank"), ("arm", "swap", "Arm"), ("", "keep", None), ("coil", "keep", None)]
    return glossary.glossary_errors(spark.createDataFrame(entries, glossary.SCHEMA))


_ENTRIES = """SELECT CASE WHEN p_partkey % 13 = 0 THEN ' ' || p_brand WHEN p_partkey % 17 = 0 THEN upper(p_brand) || ' ' || p_partkey WHEN p_partkey % 19 = 0 THEN '' ELSE p_brand || ' ' || (p_partkey - p_partkey % 3) END AS source,
CASE p_partkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'annotate' WHEN 2 THEN 'swap' ELSE 'translate' END AS mode, CASE WHEN p_partkey % 7 < 3 THEN NULL WHEN p_partkey % 7 = 3 THEN ' ' ELSE p_type END AS target FROM part"""


@query(f"""WITH e AS ({_ENTRIES}), s AS (SELECT source, CASE WHEN trim(source) = '' THEN 'empty_source' WHEN source <> trim(source) THEN 'source_not_trimmed' WHEN mode NOT IN ('keep','translate','annotate') THEN 'unknown_mode'
 WHEN mode = 'keep' AND target IS NOT NULL THEN 'target_with_keep' WHEN mode <> 'keep' AND coalesce(trim(target), '') = '' THEN 'missing_target' END AS error FROM e)
SELECT * FROM s WHERE error IS NOT NULL UNION ALL SELECT min(source), 'duplicate_source' FROM e GROUP BY lower(source) HAVING count(*) > 1""")
def glossary_errors_of_parts(spark, folder):
    """A glossary of all parts, made with every kind of error."""
    table(spark, folder, "part").createOrReplaceTempView("part_rows")
    return glossary.glossary_errors(spark.sql(_ENTRIES.replace("FROM part", "FROM part_rows")))


@query(r"""SELECT seg_key, CASE WHEN regexp_matches(coalesce(visible, text), '\p{L}') THEN coalesce(replaced, upper(replace(text, 'ß', 'ss'))) ELSE text END AS translated FROM
(SELECT seg_key, any_value(text) AS text, any_value(protected_spans) AS spans FROM text_segment GROUP BY seg_key) s LEFT JOIN
(SELECT seg_key, string_agg(CASE WHEN kind THEN substr(text, a + 1, b - a) ELSE upper(replace(substr(text, a + 1, b - a), 'ß', 'ss')) END, '' ORDER BY a) AS replaced,
        string_agg(CASE WHEN kind THEN '' ELSE substr(text, a + 1, b - a) END, '' ORDER BY a) AS visible FROM
 (SELECT seg_key, text, x.start_pos AS a, x.end_pos AS b, true AS kind FROM (SELECT seg_key, any_value(text) AS text, unnest(any_value(protected_spans)) AS x FROM text_segment GROUP BY seg_key) UNION ALL
  SELECT seg_key, text, coalesce(lag(x.end_pos) OVER (PARTITION BY seg_key ORDER BY x.start_pos), 0), x.start_pos, false FROM (SELECT seg_key, any_value(text) AS text, unnest(any_value(protected_spans)) AS x FROM text_segment GROUP BY seg_key) UNION ALL
  SELECT seg_key, any_value(text), max(x.end_pos), length(any_value(text)), false FROM (SELECT seg_key, any_value(text) AS text, unnest(any_value(protected_spans)) AS x FROM text_segment GROUP BY seg_key) GROUP BY seg_key)
 WHERE a < b GROUP BY seg_key) r USING (seg_key)""")
def translated_upper(spark, folder):
    """Every segment through the whole pipeline with the upper-case double: protected content must come out untouched."""
    done = translate.translate_segments(_protected(spark, folder), ["seg_key"], backends.upper)
    return done.select("seg_key", "translated")


@query("SELECT DISTINCT seg_key, text AS translated, NULL::varchar AS action FROM text_segment")
def translated_echo(spark, folder):
    """The echo double with glossary-free masking gives every text back, with no issue."""
    return translate.translate_segments(_protected(spark, folder), ["seg_key"], backends.echo).select("seg_key", "translated", "action")


@query()
def translated_glossary(spark, folder):
    """Glossary masking around the upper-case double, sentence chunks of at most 400 characters; structures are checked after restoring."""
    segments = _segments(spark, folder, "document_format", "type", "text", "protected_spans")
    done = translate.translate_segments(segments, ["seg_key", "document_format", "type"], backends.upper, _glossary(spark), limit=400, form="document_format")
    return done.select("seg_key", "translated", "action", F.array_join("errors", "; ").alias("errors"))


# ---- alignment and formatting -----------------------------------------------------------------------------------------


def _pairs(spark, folder):
    return table(spark, folder, "en_de").dropDuplicates(["pair_key"])


_SCOPES = """p AS (SELECT DISTINCT pair_key, source, target, scopes, expected_spans FROM en_de),
sc AS (SELECT pair_key, s.id AS scope_id, s.source[1] AS a, s.source[2] AS b, s.link_target FROM (SELECT pair_key, unnest(scopes) AS s FROM p)),
lk AS (SELECT pair_key, link_no, r.start_pos AS a, r.end_pos AS b FROM (SELECT pair_key, link_no, unnest(x.source_ranges) AS r FROM
      (SELECT pair_key, unnest(expected_spans) AS x, generate_subscripts(expected_spans, 1) - 1 AS link_no FROM p) WHERE x.relation = 'correspondence'))"""


@query(f"""WITH {_SCOPES} SELECT sc.pair_key, sc.scope_id, count(DISTINCT lk.link_no) AS links, count(*) FILTER (lk.a < sc.a OR lk.b > sc.b) AS crossing
FROM sc JOIN lk ON sc.pair_key = lk.pair_key AND sc.a < lk.b AND lk.a < sc.b GROUP BY ALL""")
def scope_link_overlap(spark, folder):
    pairs = _pairs(spark, folder)
    return alignment.scope_links(alignment.scope_rows(pairs), alignment.link_rows(pairs, "source"))


@query(f"""WITH {_SCOPES} SELECT l.pair_key, l.scope_id, string_agg(DISTINCT r.scope_id, ',' ORDER BY r.scope_id) AS others FROM sc l JOIN sc r ON l.pair_key = r.pair_key AND l.scope_id <> r.scope_id
AND l.a < r.b AND r.a < l.b WHERE NOT (l.a <= r.a AND r.b <= l.b) AND NOT (r.a <= l.a AND l.b <= r.b) GROUP BY ALL""")
def scope_conflicts(spark, folder):
    return alignment.conflicts(alignment.scope_rows(_pairs(spark, folder)))


_SHIFTED = ", sh AS (SELECT * FROM sc UNION ALL SELECT pair_key, scope_id || '+', a + (b - a + 1) // 2, b + (b - a + 1) // 2, link_target FROM sc)"


@query(f"""WITH {_SCOPES}{_SHIFTED} SELECT l.pair_key, l.scope_id, string_agg(DISTINCT r.scope_id, ',' ORDER BY r.scope_id) AS others FROM sh l JOIN sh r ON l.pair_key = r.pair_key AND l.scope_id <> r.scope_id
AND l.a < r.b AND r.a < l.b WHERE NOT (l.a <= r.a AND r.b <= l.b) AND NOT (r.a <= l.a AND l.b <= r.b) GROUP BY ALL""")
def scope_conflicts_shifted(spark, folder):
    """Conflicts among scopes and their moved copies."""
    return alignment.conflicts(_shifted(_pairs(spark, folder)))


def _shifted(pairs):
    """Every scope beside a copy that is moved by half its length, so that conflicts are there to be found."""
    scopes = alignment.scope_rows(pairs)
    half = F.floor((F.col("end_pos") - F.col("start_pos") + 1) / 2).cast("int")
    moved = scopes.select("pair_key", F.concat("scope_id", F.lit("+")).alias("scope_id"), (F.col("start_pos") + half).alias("start_pos"), (F.col("end_pos") + half).alias("end_pos"), "link_target")
    return scopes.unionByName(moved)


@query(f"""WITH {_SCOPES}{_SHIFTED}, w AS (SELECT sh.pair_key, scope_id, a AS sa, b AS sb, greatest(a - 10, 0) AS ta, least(b + 30, length(target)) AS tb FROM sh JOIN p USING (pair_key))
SELECT l.pair_key, l.scope_id, string_agg(DISTINCT r.scope_id, ',' ORDER BY r.scope_id) AS conflicts_with FROM w l JOIN w r ON l.pair_key = r.pair_key AND l.scope_id <> r.scope_id
AND ((l.sa < r.sb AND r.sa < l.sb) OR (l.ta < r.tb AND r.ta < l.tb)) GROUP BY ALL""")
def window_conflicts(spark, folder):
    """Windows around scopes and their moved copies that meet on the side of the source or of the target."""
    pairs = _pairs(spark, folder)
    near = _shifted(pairs).join(pairs.select("pair_key", F.length("target").alias("t")), "pair_key")
    target = (F.greatest(F.col("start_pos") - 10, F.lit(0)).alias("target_start"), F.least(F.col("end_pos") + 30, F.col("t")).alias("target_end"))
    return alignment.window_conflicts(near.select("pair_key", "scope_id", F.col("start_pos").alias("source_start"), F.col("end_pos").alias("source_end"), *target))


@query(f"""WITH {_SCOPES} SELECT pair_key, scope_id, (SELECT max(lk.b) FROM lk WHERE lk.pair_key = sc.pair_key AND lk.b <= sc.a) AS before_end,
(SELECT min(lk.a) FROM lk WHERE lk.pair_key = sc.pair_key AND lk.a >= sc.b) AS after_start FROM sc""")
def nearest_anchor(spark, folder):
    pairs = _pairs(spark, folder)
    return alignment.nearest_anchors(alignment.scope_rows(pairs), alignment.link_rows(pairs, "source"))


@query("""SELECT pair_key, count(*) AS spans, bool_and(ok) AS sound FROM (SELECT pair_key,
list_bool_and(list_concat(list_transform(x.source_ranges, lambda r: substr(source, r.start_pos + 1, r.end_pos - r.start_pos) = r.text), [true])) AND
list_bool_and(list_concat(list_transform(x.target_ranges, lambda r: substr(target, r.start_pos + 1, r.end_pos - r.start_pos) = r.text), [true])) AND
(len(coalesce(x.target_ranges, [])) = 0) = (x.relation = 'unaligned') AS ok
FROM (SELECT pair_key, source, target, unnest(expected_spans) AS x FROM (SELECT DISTINCT pair_key, source, target, expected_spans FROM en_de))) GROUP BY pair_key""")
def expected_spans_valid(spark, folder):
    """Whether stored ranges cut their texts out of both sides and have a target unless they are unaligned."""
    spans = _pairs(spark, folder).select("pair_key", "source", "target", F.explode("expected_spans").alias("x"))
    cuts = lambda side: F.coalesce(F.forall(f"x.{side}_ranges", lambda r: F.substring(F.col(side), r["start_pos"] + 1, r["end_pos"] - r["start_pos"]) == r["text"]), F.lit(True))
    empty = F.coalesce(F.size(F.when(F.col("x.target_ranges").isNotNull(), F.col("x.target_ranges"))), F.lit(0)) == 0
    sound = cuts("source") & cuts("target") & (empty == (F.col("x.relation") == "unaligned"))
    return spans.groupBy("pair_key").agg(F.count(F.lit(1)).alias("spans"), F.bool_and(sound).alias("sound"))


_ANCHORED = f"""p AS (SELECT DISTINCT pair_key, coalesce(source, '') AS source, coalesce(target, '') AS target, coalesce(markers, []) AS t, coalesce(marker_prefix, '') AS prefix FROM en_de),
w AS (SELECT *, regexp_extract_all(source, '{WORD}') AS a, regexp_extract_all(target, '{WORD}') AS b, regexp_extract_all(source, prefix || 'X[0-9]+Z') AS fa, regexp_extract_all(target, prefix || 'X[0-9]+Z') AS fb FROM p),
c AS (SELECT *, least(len(a), len(b)) AS n, CASE WHEN prefix = '' THEN NULL
 WHEN len(list_distinct(t)) < len(t) OR NOT list_bool_and(list_concat([true], list_transform(t, lambda x: regexp_full_match(x, prefix || 'X[0-9]+Z')))) THEN 'the registered markers are not distinct markers of their namespace'
 WHEN list_sort(fa) <> list_sort(t) THEN 'missing, duplicate or unexpected marker in the source' WHEN len(string_split(lower(source), lower(prefix))) - 1 > len(fa) THEN 'damaged marker in the source'
 WHEN list_sort(fb) <> list_sort(t) THEN 'missing, duplicate or unexpected marker in the target' WHEN len(string_split(lower(target), lower(prefix))) - 1 > len(fb) THEN 'damaged marker in the target' END AS error FROM w),
k AS (SELECT *, CASE WHEN prefix = '' THEN [] ELSE list_filter(range(1, n + 1), lambda i: list_contains(t, a[i]) OR list_contains(t, b[i])) END AS touched FROM c),
aligned AS (SELECT pair_key, CASE WHEN error IS NULL THEN n - len(touched) + CASE WHEN prefix = '' THEN 0 ELSE len(t) END ELSE 0 END AS links,
 CASE WHEN error IS NULL THEN len(list_filter(a[n + 1:], lambda x: prefix = '' OR NOT list_contains(t, x))) ELSE len(a) END AS unaligned,
 CASE WHEN error IS NULL THEN len(list_filter(touched, lambda i: NOT list_contains(t, a[i]))) ELSE 0 END AS ambiguous, error IS NOT NULL AS failed, coalesce(error, '') AS errors FROM k)"""


@query(f"WITH {_ANCHORED} SELECT * FROM aligned")
def alignment_components(spark, folder):
    """Links of the positional double as connected components, with anchored markers; a union-find within each pair."""
    return alignment.align_pairs(_pairs(spark, folder))


@query(f"WITH {_ANCHORED} SELECT count(*) AS pairs, sum(links)::bigint AS links, sum(unaligned)::bigint AS unaligned, sum(ambiguous)::bigint AS ambiguous, count(*) FILTER (failed) AS failed FROM aligned")
def alignment_statistics(spark, folder):
    return alignment.statistics(alignment.align_pairs(_pairs(spark, folder)))


_PLACES = """SELECT pair_key, row_number() OVER (PARTITION BY pair_key ORDER BY i) AS k, a, b FROM (SELECT pair_key, i, x, (sum(length(x)) OVER w - length(x))::int AS a, (sum(length(x)) OVER w)::int AS b FROM
(SELECT pair_key, unnest(regexp_extract_all({side}, '{piece}')) AS x, generate_subscripts(regexp_extract_all({side}, '{piece}'), 1) AS i FROM p) WINDOW w AS (PARTITION BY pair_key ORDER BY i)) WHERE regexp_matches(x, '[^{space}]')"""


@query(f"""WITH {_SCOPES}, sw AS ({_PLACES.format(side="source", piece=f"{WORD}|[{SPACE}]+", space=SPACE)}), tw AS ({_PLACES.format(side="target", piece=f"{WORD}|[{SPACE}]+", space=SPACE)}),
t AS (SELECT sc.*, w.k, w.a AS wa, w.b AS wb, v.a AS va, v.b AS vb FROM sc LEFT JOIN sw w ON w.pair_key = sc.pair_key AND w.a < sc.b AND sc.a < w.b LEFT JOIN tw v ON v.pair_key = sc.pair_key AND v.k = w.k),
g AS (SELECT pair_key, scope_id, a, b, link_target, CASE WHEN count(k) > count(va) THEN 'unresolved_source' WHEN bool_or(va IS NOT NULL AND (wa < a OR wb > b)) THEN 'crossing_source_boundary' WHEN count(k) = 0 THEN 'no_target' END AS reason,
 string_agg('[' || greatest(wa, a) || ',' || least(wb, b) || ')', ', ' ORDER BY wa) FILTER (k IS NOT NULL AND va IS NULL) AS loose, string_agg('[' || wa || ',' || wb || ')', ', ' ORDER BY wa) FILTER (va IS NOT NULL) AS touched,
 min(va) AS start_pos, max(vb) AS end_pos FROM t GROUP BY pair_key, scope_id, a, b, link_target),
h AS (SELECT *, reason IS NULL AND link_target IS NOT NULL AND EXISTS (SELECT 1 FROM g o WHERE o.pair_key = g.pair_key AND o.scope_id <> g.scope_id AND o.reason IS NULL AND o.link_target IS NOT NULL AND o.start_pos < g.end_pos AND g.start_pos < o.end_pos) AS clash FROM g)
SELECT pair_key, scope_id, CASE WHEN reason IS NULL AND NOT clash THEN 'kept' ELSE 'dropped' END AS action, CASE WHEN clash THEN 'overlapping_links' ELSE reason END AS reason, CASE WHEN reason IS NULL AND NOT clash THEN start_pos END AS start_pos,
CASE WHEN reason IS NULL AND NOT clash THEN end_pos END AS end_pos, CASE WHEN clash THEN scope_id || ': overlapping_links' WHEN reason IS NOT NULL THEN scope_id || ': ' || reason || '; alignment_source_ranges=' ||
 CASE reason WHEN 'unresolved_source' THEN loose WHEN 'no_target' THEN '[' || a || ',' || b || ')' ELSE touched END END AS diagnostic FROM h""")
def projected_formatting(spark, folder):
    return alignment.project_pairs(_pairs(spark, folder))


@query(f"""WITH {_SCOPES}, sw AS ({_PLACES.format(side="source", piece=f"{WORD}|[{SPACE}]+", space=SPACE)}),
x AS (SELECT pair_key, unnest(expected_spans) AS x, generate_subscripts(expected_spans, 1) AS link_no FROM p),
ok AS (SELECT * FROM x WHERE x.relation = 'correspondence' AND len(x.source_ranges) > 0 AND len(x.target_ranges) > 0),
l AS (SELECT pair_key, link_no, r.start_pos AS a, r.end_pos AS b FROM (SELECT pair_key, link_no, unnest(x.source_ranges) AS r FROM ok)), m AS (SELECT pair_key, link_no, r.start_pos AS a, r.end_pos AS b FROM (SELECT pair_key, link_no, unnest(x.target_ranges) AS r FROM ok)),
loose AS (SELECT sc.pair_key, sc.scope_id, string_agg('[' || greatest(w.a, sc.a) || ',' || least(w.b, sc.b) || ')', ', ' ORDER BY w.a) AS ranges FROM sc JOIN sw w ON w.pair_key = sc.pair_key AND w.a < sc.b AND sc.a < w.b
          WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.pair_key = w.pair_key AND l.a < w.b AND w.a < l.b) GROUP BY sc.pair_key, sc.scope_id),
mine AS (SELECT DISTINCT sc.pair_key, sc.scope_id, sc.a AS sa, sc.b AS sb, l.link_no FROM sc JOIN l ON l.pair_key = sc.pair_key AND l.a < sc.b AND sc.a < l.b),
touched AS (SELECT pair_key, scope_id, bool_or(l.a < sa OR l.b > sb) AS crosses, string_agg('[' || l.a || ',' || l.b || ')', ', ' ORDER BY l.a, l.b) AS ranges FROM mine JOIN l USING (pair_key, link_no) GROUP BY pair_key, scope_id),
v AS (SELECT sc.*, CASE WHEN loose.ranges IS NOT NULL THEN 'unresolved_source' WHEN touched.crosses THEN 'crossing_source_boundary' WHEN touched.ranges IS NULL THEN 'no_target' END AS reason,
      CASE WHEN loose.ranges IS NOT NULL THEN loose.ranges WHEN touched.crosses THEN touched.ranges ELSE '[' || sc.a || ',' || sc.b || ')' END AS ranges FROM sc LEFT JOIN loose USING (pair_key, scope_id) LEFT JOIN touched USING (pair_key, scope_id)),
t AS (SELECT v.pair_key, v.scope_id, v.link_target, m.a, m.b, max(m.b) OVER (PARTITION BY v.pair_key, v.scope_id ORDER BY m.a, m.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM v JOIN mine USING (pair_key, scope_id) JOIN m ON m.pair_key = v.pair_key AND m.link_no = mine.link_no WHERE v.reason IS NULL),
u AS (SELECT t.*, sum((before IS NULL OR regexp_matches(substr(p.target, before + 1, greatest(t.a - before, 0)), '[^{SPACE}]'))::int) OVER (PARTITION BY t.pair_key, t.scope_id ORDER BY t.a, t.b) AS run FROM t JOIN p USING (pair_key)),
r AS (SELECT pair_key, scope_id, link_target, run, min(a) AS a, max(b) AS b, count(*) OVER (PARTITION BY pair_key, scope_id) AS runs FROM u GROUP BY pair_key, scope_id, link_target, run),
k AS (SELECT pair_key, scope_id, link_target, runs, a, b FROM r WHERE runs = 1 OR link_target IS NULL UNION ALL SELECT pair_key, scope_id, link_target, runs, min(a), max(b) FROM r WHERE runs > 1 AND link_target IS NOT NULL GROUP BY pair_key, scope_id, link_target, runs),
z AS (SELECT k.*, link_target IS NOT NULL AND EXISTS (SELECT 1 FROM k o WHERE o.pair_key = k.pair_key AND o.scope_id <> k.scope_id AND o.link_target IS NOT NULL AND o.a < k.b AND k.a < o.b) AS clash FROM k)
SELECT pair_key, scope_id, CASE WHEN clash THEN 'dropped' WHEN runs = 1 THEN 'kept' WHEN link_target IS NULL THEN 'split' ELSE 'expanded' END AS action, CASE WHEN clash THEN 'overlapping_links' WHEN runs > 1 THEN 'discontinuous_target' END AS reason,
CASE WHEN NOT clash THEN a END AS start_pos, CASE WHEN NOT clash THEN b END AS end_pos, CASE WHEN clash THEN scope_id || ': overlapping_links' WHEN runs > 1 THEN scope_id || ': discontinuous_target' END AS diagnostic FROM z UNION ALL
SELECT pair_key, scope_id, 'dropped', reason, NULL, NULL, scope_id || ': ' || reason || '; alignment_source_ranges=' || ranges FROM v WHERE reason IS NOT NULL""")
def projected_expected(spark, folder):
    """The same through the stored spans."""
    return alignment.project_pairs(_pairs(spark, folder), aligner="expected")


@query()
def translated_aligned(spark, folder):
    """Markdown segments through the aligned path with the upper-case double: formatting follows its words."""
    marked = _segments(spark, folder, "document_format", "text").where("document_format = 'md'")
    done = aligned.translate_aligned(marked, "seg_key", backends.upper)
    return done.select("seg_key", "translated", F.array_join("issues", "; ").alias("issues"))


@query()
def aligned_unit_counts(spark, folder):
    """Calls of the aligned path over all Markdown segments."""
    counts = aligned.unit_counts(_segments(spark, folder, "document_format", "text").where("document_format = 'md'"), "seg_key", backends.upper)
    return counts.agg(*(F.sum(c).alias(c) for c in ("translation_calls", "alignment_calls", "alignment_failures", "protected_units")))


@query("SELECT DISTINCT seg_key, true AS sound FROM text_segment WHERE document_format = 'md'")
def translated_aligned_echo(spark, folder):
    """The aligned path with the echo double gives every Markdown segment back as it is, or says in an issue what it dropped."""
    marked = _segments(spark, folder, "document_format", "text").where("document_format = 'md'")
    done = aligned.translate_aligned(marked, "seg_key", backends.echo).join(marked.select("seg_key", "text"), "seg_key")
    return done.select("seg_key", (F.col("translated").eqNullSafe(F.col("text")) | (F.size("issues") > 0)).alias("sound"))


@query("SELECT DISTINCT seg_key, text AS original FROM text_segment WHERE length(text) > 0")
def model_chunk_originals(spark, folder):
    """Segments masked and cut to 200 characters: the sources that the chunks stand for join to each text again."""
    found = model_input.model_chunks(_protected(spark, folder).where("length(text) > 0"), "seg_key", 200)
    return found.groupBy("seg_key").agg(joined(F.col("original"), F.col("chunk_no")).alias("original"))


# ---- HTML, Markdown and OpenDocument ----------------------------------------------------------------------------------


def _runs(spark, folder, form):
    """Whole documents of one format, put together from the segments of a run."""
    segments = table(spark, folder, "text_segment").where(F.col("document_format") == form).select("run_id", "seg_no", "text").dropDuplicates(["run_id", "seg_no"])
    return segments.groupBy("run_id").agg(joined(F.concat(F.lit("<p>"), "text", F.lit("</p>")) if form == "html" else F.col("text"), F.col("seg_no"), "\n\n").alias("text"))


def _slices(found, documents, key):
    """For each document whether its regions are the slices of it that they say, in order and apart."""
    before = F.lag("end_pos").over(Window.partitionBy(key).orderBy("seg_no"))
    rows = found.select(key, "seg_no", "start_pos", "end_pos", F.col("text").alias("part")).withColumn("before", before).join(documents, key)
    cut = F.expr("substr(text, start_pos + 1, end_pos - start_pos)") == F.col("part")
    checked = rows.groupBy(key).agg(F.bool_and(cut & (F.col("start_pos") >= F.coalesce("before", F.lit(0)))).alias("sound"))
    return documents.select(key).join(checked, key, "left").select(key, F.coalesce("sound", F.lit(True)).alias("sound"))


@query("SELECT DISTINCT run_id, true AS sound FROM text_segment WHERE document_format = 'html'")
def html_slices(spark, folder):
    pages = _runs(spark, folder, "html")
    return _slices(html_text.html_segments(pages, "run_id", "text"), pages, "run_id")


@query("SELECT DISTINCT id, true AS sound FROM review_job WHERE document_format = 'md'")
def markdown_slices(spark, folder):
    jobs = _marked_jobs(spark, folder)
    return _slices(markdown.markdown_regions(jobs, "id", "text"), jobs, "id")


@query()
def html_visible_text(spark, folder):
    return html_text.html_segments(_runs(spark, folder, "html"), "run_id", "text").drop("protected_spans")


@query()
def html_signatures(spark, folder):
    return html_text.signatures(_segments(spark, folder, "document_format", "text").where("document_format = 'html'"), "seg_key", "text")


@query("""SELECT seg_key, len(regexp_extract_all(text, '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);')) AS entities, len(regexp_extract_all(text, '</?[A-Za-z][^<>]*>')) AS tags
FROM (SELECT DISTINCT seg_key, text FROM text_segment WHERE document_format = 'html')""")
def html_entity_counts(spark, folder):
    pages = _delivered(spark, folder, "document_format", "text").where("document_format = 'html'")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return pages.select("seg_key", count("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);").alias("entities"), count("</?[A-Za-z][^<>]*>").alias("tags")).dropDuplicates(["seg_key"])


def _marked_jobs(spark, folder):
    jobs = latest(table(spark, folder, "review_job").where("document_format = 'md'").select("id", "source", "loaded_at"), "id")
    return jobs.select("id", F.col("source").cast("string").alias("text"))


@query()
def markdown_regions(spark, folder):
    return markdown.markdown_regions(_marked_jobs(spark, folder), "id", "text").drop("protected_spans")


@query("SELECT DISTINCT id, true AS same FROM review_job WHERE document_format = 'md'")
def markdown_rewrite_identity(spark, folder):
    """Regions spliced back with their own texts give each source again."""
    return markdown.rewrite_documents(_marked_jobs(spark, folder), "id", "text")


@query()
def markdown_layouts(spark, folder):
    found = markdown.markdown_layouts(_segments(spark, folder, "document_format", "text").where("document_format = 'md'"), "seg_key", "text")
    return found.select("seg_key", F.size("ranges").alias("wrappers"), intervals.laminar(F.col("ranges")).alias("sound"), F.array_join("signature", " | ").alias("signature"))


@query("""SELECT block_key, len(source_info.formatting) AS ranges, list_bool_and(list_concat([true], list_transform(source_info.formatting,
lambda r: 0 <= r.outer_start AND r.outer_start <= r.inner_start AND r.inner_start <= r.inner_end AND r.inner_end <= r.outer_end AND r.outer_start < r.outer_end))) AND
list_bool_and(list_concat([true], list_transform(range(1, len(source_info.formatting)), lambda j: list_bool_and(list_transform(range(0, j), lambda i:
(source_info.formatting[j + 1].outer_start >= source_info.formatting[i + 1].outer_end OR (source_info.formatting[j + 1].outer_start >= source_info.formatting[i + 1].inner_start
AND source_info.formatting[j + 1].outer_end <= source_info.formatting[i + 1].inner_end)) AND source_info.formatting[i + 1].outer_start <= source_info.formatting[j + 1].outer_start))))) AS sound
FROM (SELECT DISTINCT block_key, source_info FROM review_block WHERE source_info IS NOT NULL AND source_info.formatting IS NOT NULL)""")
def layout_validation(spark, folder):
    blocks = table(spark, folder, "review_block").where("source_info.formatting is not null").select("block_key", "source_info").dropDuplicates(["block_key"])
    return blocks.select("block_key", F.size("source_info.formatting").alias("ranges"), intervals.laminar(F.col("source_info.formatting")).alias("sound"))


def _packages(spark, folder):
    """A package for every run of OpenDocument segments, built from their texts."""
    segments = table(spark, folder, "text_segment").where("document_format = 'odt'").select("run_id", "seg_no", "type", "text").dropDuplicates(["run_id", "seg_no"])
    rows = segments.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "type", "text"))).alias("rows"))
    make = lambda: lambda row: [(row["run_id"], odt.make_package([(r["type"], r["text"] or "") for r in row["rows"]]))]
    return flat_map(rows, "run_id string, content binary", make)


@query("SELECT run_id, count(*) AS blocks, sum(length(replace(text, chr(10), '')))::bigint AS chars FROM (SELECT DISTINCT run_id, seg_no, text FROM text_segment WHERE document_format = 'odt') GROUP BY run_id")
def odt_round_trip(spark, folder):
    """Segments written as packages and read back: as many blocks and characters as before (line breaks come back as elements)."""
    found = odt.odt_blocks(_packages(spark, folder), "run_id", "content")
    plain = F.regexp_replace("text", r"<text:line-break/>", "")
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length(plain)).alias("chars"))


@query("""SELECT run_id, 'content.xml' AS part, n::int AS block_no, n::varchar AS segment_id, CASE WHEN type IN ('heading', 'list_item') THEN type ELSE 'paragraph' END AS type, NULL::varchar AS reason,
replace(text, chr(10), '<text:line-break/>') AS text, NULL::varchar AS error FROM
(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_no) AS n FROM (SELECT DISTINCT run_id, seg_no, type, coalesce(text, '') AS text FROM text_segment WHERE document_format = 'odt'))""")
def odt_blocks(spark, folder):
    return odt.odt_blocks(_packages(spark, folder), "run_id", "content").drop("protected_spans")


@query("""SELECT run_id, count(*) AS blocks, count(*) FILTER (regexp_matches(text, '\\S')) AS eligible, 0::bigint AS skipped, count(*) FILTER (NOT regexp_matches(text, '\\S')) AS blank
FROM (SELECT DISTINCT run_id, seg_no, coalesce(text, '') AS text FROM text_segment WHERE document_format = 'odt') GROUP BY run_id""")
def odt_inventory_counts(spark, folder):
    return evaluation.inventory_counts(odt.odt_blocks(_packages(spark, folder), "run_id", "content"), "run_id")


@query("""SELECT run_id, n::int AS block_no, 'office:document-content/office:body/office:text' || CASE WHEN type = 'list_item' THEN '/text:list/text:list-item' ELSE '' END AS context, 'eligible' AS status FROM
(SELECT run_id, type, row_number() OVER (PARTITION BY run_id ORDER BY seg_no) AS n FROM (SELECT DISTINCT run_id, seg_no, type FROM text_segment WHERE document_format = 'odt'))""")
def odt_inventory(spark, folder):
    return odt.inventory(_packages(spark, folder), "run_id", "content").select("run_id", "block_no", "context", "status")


@query()
def odt_evaluation(spark, folder):
    """Packages through the aligned path: their inventory beside the issues of their translation."""
    packages = _packages(spark, folder)
    return evaluation.evaluate_packages(odt.odt_blocks(packages, "run_id", "content"), aligned.translate_aligned_odt(packages, "run_id", "content", backends.upper), "run_id")


@query()
def translated_aligned_odt(spark, folder):
    """Packages through the aligned path with the upper-case double, read back by block, with the issues of their package; a bad one is a row with its error."""
    done = aligned.translate_aligned_odt(_packages(spark, folder), "run_id", "content", backends.upper)

    def make():
        def work(row: dict) -> list[tuple]:
            if row["error"]:
                return [(row["run_id"], None, None, None, [row["error"]])]
            return [(row["run_id"], b.part, b.id, b.text, row["issues"]) for part, data in odt.inspect(row["content"]).items() for b in odt.blocks(data, part)]

        return work

    return flat_map(done, "run_id string, part string, segment_id string, translated string, issues array<string>", make)


@query("""WITH RECURSIVE e(style, parent) AS (VALUES ('P1','Preformatted'),('P2','P1'),('P3','P2'),('P4','Text'),('Loop1','Loop2'),('Loop2','Loop1'),('P5','P4')),
r(style) AS (SELECT 'Preformatted' UNION SELECT e.style FROM e JOIN r ON e.parent = r.style) SELECT style FROM r""")
def style_closure(spark, folder):
    edges = [("P1", "Preformatted"), ("P2", "P1"), ("P3", "P2"), ("P4", "Text"), ("Loop1", "Loop2"), ("Loop2", "Loop1"), ("P5", "P4")]
    return odt.closure(spark.createDataFrame(edges, "style string, parent string"), spark.createDataFrame([("Preformatted",)], "style string"))


@query("""WITH RECURSIVE e AS (SELECT run_id || ':' || seg_no AS style, run_id || ':' || (seg_no - 1) AS parent FROM (SELECT DISTINCT run_id, seg_no FROM text_segment)),
r(style) AS (SELECT DISTINCT run_id || ':1' FROM text_segment WHERE document_format = 'odt' UNION SELECT e.style FROM e JOIN r ON e.parent = r.style) SELECT style FROM r""")
def style_closure_chains(spark, folder):
    """Every segment as a style that inherits from the one before it in its run: chains as long as documents."""
    rows = table(spark, folder, "text_segment")
    name = lambda n: F.concat("run_id", F.lit(":"), n.cast("string"))
    edges = rows.select(name(F.col("seg_no")).alias("style"), name(F.col("seg_no") - 1).alias("parent")).distinct()
    return odt.closure(edges, rows.where("document_format = 'odt'").select(name(F.lit(1)).alias("style")))


# ---- review and issues ------------------------------------------------------------------------------------------------

_JOBS = "j AS (SELECT DISTINCT id AS job_id, source_name FROM review_job), b AS (SELECT DISTINCT job_id, ord, id, original, proposal FROM review_block)"
_ENCODE = "array_to_string(list_transform(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: CASE WHEN starts_with(x, '\\') OR regexp_matches(x, '" + review.CONTROL.replace("'", "''") + "') THEN '\\' || x ELSE x END), chr(10))"


def _jobs(spark, folder):
    return table(spark, folder, "review_job").select(F.col("id").alias("job_id"), "source_name").dropDuplicates(["job_id"])


def _blocks(spark, folder):
    return table(spark, folder, "review_block").select("job_id", "ord", "id", "type", "original", "proposal").dropDuplicates(["job_id", "id"])


@query(f"""WITH {_JOBS} SELECT b.job_id, 'document-review: 1' || chr(10) || 'Job-ID: ' || b.job_id || chr(10) || chr(10) || string_agg('=== Block ' || id || ' ===' || chr(10) || 'Source: ' || substr(to_json(source_name)::varchar, 2, length(to_json(source_name)::varchar) - 2)
|| chr(10) || '--- Original ---' || chr(10) || {_ENCODE.format(c="coalesce(original, '')")} || chr(10) || '--- Translation ---' || chr(10) || {_ENCODE.format(c="coalesce(proposal, '')")} || chr(10) || '--- Correction ---' || chr(10) || chr(10)
|| '=== End Block ===' || chr(10) || chr(10), '' ORDER BY ord) AS review FROM b JOIN j USING (job_id) GROUP BY b.job_id""")
def review_export(spark, folder):
    return review.review_texts(_jobs(spark, folder), _blocks(spark, folder))


@query("SELECT NULL::varchar AS job_id, NULL::varchar AS id, NULL::varchar AS error WHERE false")
def review_import_errors(spark, folder):
    """Reviews written and read back hold exactly the blocks that were stored, so nothing may come out."""
    blocks = _blocks(spark, folder)
    return review.review_errors(review.review_blocks(review.review_texts(_jobs(spark, folder), blocks)), blocks)


@query("""WITH b AS (SELECT DISTINCT job_id, ord, id FROM review_block), w AS (SELECT DISTINCT job_id FROM b)
SELECT job_id, id, 'missing_block' AS error FROM b WHERE ord % 5 = 0 UNION ALL SELECT job_id, id, 'duplicate_block' FROM b WHERE ord % 5 = 1 UNION ALL
SELECT job_id, id, 'reference_changed' FROM b WHERE ord % 5 = 2 UNION ALL SELECT job_id, 'x-0', 'unknown_block' FROM w""")
def review_import_defects(spark, folder):
    """Reviews read back with planted defects: of every five blocks one is left out, one is there twice, and one has another original; each review has a block that no job knows."""
    blocks = _blocks(spark, folder)
    read = review.review_blocks(review.review_texts(_jobs(spark, folder), blocks)).join(blocks.select("job_id", "id", "ord"), ["job_id", "id"])
    changed = F.when(F.col("ord") % 5 == 2, F.concat("original", F.lit("\nchanged"))).otherwise(F.col("original"))
    kept = read.where("ord % 5 <> 0").withColumn("original", changed)
    twice = kept.unionByName(kept.where("ord % 5 = 1")).drop("ord")
    unknown = blocks.select("job_id").distinct().select("job_id", F.lit("x-0").alias("id"), *(F.lit("x").alias(c) for c in ("label", "original", "proposal", "correction")), F.lit(None).cast("string").alias("error"))
    return review.review_errors(twice.unionByName(unknown), blocks).distinct()


@query("""SELECT job_id, ord, id, CASE WHEN ord % 3 = 0 THEN upper(replace(original, 'ß', 'ss')) ELSE proposal END AS text FROM (SELECT DISTINCT job_id, ord, id, original, proposal FROM review_block)""")
def review_select(spark, folder):
    """Every third block corrected, the others accepted as proposed."""
    blocks = _blocks(spark, folder)
    corrected = blocks.where("ord % 3 = 0 and length(trim(original)) > 0").select("job_id", "id", F.upper(F.regexp_replace("original", "ß", "ss")).alias("correction"))
    return review.selected(blocks, corrected)


@query("SELECT NULL::varchar AS id, NULL::varchar AS error WHERE false")
def review_job_errors(spark, folder):
    return review.job_errors(table(spark, folder, "review_job").dropDuplicates(["id"]))


_DEFECTS = """SELECT CASE WHEN k % 5 = 0 THEN upper(id) ELSE id END AS id, CASE WHEN k % 5 = 1 THEN '../' || source_name WHEN k % 25 = 2 THEN '' ELSE source_name END AS source_name,
CASE WHEN k % 5 = 3 THEN 3 - schema_version ELSE schema_version END AS schema_version, document_format, source, CASE WHEN k % 5 = 4 THEN 'x' || source_sha256 ELSE source_sha256 END AS source_sha256"""


@query(f"""WITH d AS ({_DEFECTS}, k FROM (SELECT DISTINCT id, source_name, schema_version, document_format, source, source_sha256, length(source_name) + ascii(id) AS k FROM review_job))
SELECT id, unnest(list_filter([CASE WHEN k % 5 = 3 THEN 'schema_and_format' END, CASE WHEN NOT regexp_matches(id, '^[0-9a-f-]+$') THEN 'job_id' END,
CASE WHEN k % 5 = 1 OR source_name = '' THEN 'source_name' END, CASE WHEN k % 5 = 4 THEN 'source_changed' END], lambda x: x IS NOT NULL)) AS error FROM d""")
def review_job_defects(spark, folder):
    """Jobs with planted defects of every kind."""
    table(spark, folder, "review_job").dropDuplicates(["id"]).withColumn("k", F.length("source_name") + F.ascii("id")).createOrReplaceTempView("job_rows")
    return review.job_errors(spark.sql(_DEFECTS + " FROM job_rows"))


@query(f"""SELECT job_id, id, unnest(list_filter([CASE WHEN coalesce(original, '') = '' OR NOT regexp_matches(original, '[^{SPACE}]') THEN 'blank_original' END,
CASE WHEN coalesce(proposal, '') = '' OR NOT regexp_matches(proposal, '[^{SPACE}]') THEN 'blank_proposal' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT DISTINCT job_id, id, original, proposal FROM review_block)""")
def review_block_checks(spark, folder):
    return review.block_errors(_blocks(spark, folder))


@query("SELECT DISTINCT id, sha256(source) AS sha256, sha256(source) = source_sha256 AS unchanged FROM review_job")
def source_fingerprint(spark, folder):
    jobs = table(spark, folder, "review_job").select("id", "source", "source_sha256").dropDuplicates(["id"])
    return jobs.select("id", F.sha2("source", 256).alias("sha256"), (F.sha2("source", 256) == F.col("source_sha256")).alias("unchanged"))


@query("""SELECT job_id, id, len(protected) AS literals, len(list_filter(protected, lambda x: len(string_split(proposal, x)) <> 2)) AS missing FROM
(SELECT DISTINCT job_id, id, proposal, source_info.protected AS protected FROM review_block WHERE proposal IS NOT NULL AND len(source_info.protected) > 0)""")
def protected_literals(spark, folder):
    blocks = table(spark, folder, "review_block").select("job_id", "id", "proposal", F.col("source_info.protected").alias("protected")).where("proposal is not null and size(protected) > 0").dropDuplicates(["job_id", "id"])
    return review.literal_counts(blocks)


@query("""SELECT count(*) FILTER (s.seg_key IS NULL) AS without_segment, count(*) FILTER (b.block_key IS NULL) AS without_block, count(*) FILTER (s.seg_key IS NOT NULL AND b.block_key IS NOT NULL AND s.type <> b.type) AS other_type
FROM (SELECT DISTINCT seg_key, run_id, id, type FROM text_segment WHERE run_id IN (SELECT id FROM review_job)) s FULL JOIN (SELECT DISTINCT block_key, job_id, id, type FROM review_block) b ON s.run_id = b.job_id AND s.id = b.id""")
def ordered_merge_check(spark, folder):
    """Segments against stored blocks, one to one both ways."""
    jobs = table(spark, folder, "review_job").select(F.col("id").alias("run_id")).distinct()
    segments = table(spark, folder, "text_segment").select("seg_key", "run_id", "id", "type").dropDuplicates(["seg_key"]).join(jobs, "run_id", "left_semi")
    blocks = table(spark, folder, "review_block").select("block_key", F.col("job_id").alias("run_id"), "id", F.col("type").alias("b_type")).dropDuplicates(["block_key"])
    both = segments.join(blocks, ["run_id", "id"], "full_outer")
    return both.agg(
        F.count_if(F.col("seg_key").isNull()).alias("without_segment"), F.count_if(F.col("block_key").isNull()).alias("without_block"),
        F.count_if(F.col("seg_key").isNotNull() & F.col("block_key").isNotNull() & (F.col("type") != F.col("b_type"))).alias("other_type"),
    )


@query(f"""WITH {_LINES}, n AS (SELECT *, CASE WHEN NOT blank THEN row_number() OVER (PARTITION BY id, blank ORDER BY block_no) END AS seg_no FROM blocks),
r AS (SELECT DISTINCT job_id, id, proposal FROM review_block)
SELECT n.id, string_agg(CASE WHEN n.blank THEN first ELSE prefix || regexp_replace(coalesce(r.proposal, whole), '[\\r\\n]+$', '') || regexp_extract(whole, '[\\r\\n]*$') END, '' ORDER BY n.block_no) AS document,
count(*) FILTER (NOT n.blank AND r.proposal IS NULL) AS missing FROM n LEFT JOIN r ON n.id = r.job_id AND n.seg_no::varchar = r.id GROUP BY n.id""")
def txt_finalized(spark, folder):
    """Plain text jobs with all proposals accepted."""
    chosen = _blocks(spark, folder).select("job_id", "id", F.col("proposal").alias("text"))
    return finalize.finalized_text(_plain_jobs(spark, folder).select("id", "text"), chosen).select("id", "document", "missing")


@query(r"""WITH j AS (SELECT DISTINCT id, decode(source) AS text FROM review_job WHERE document_format = 'md'),
b AS (SELECT job_id, source_info.start_pos AS s, source_info.end_pos AS e, CASE WHEN type = 'table_cell' THEN NULL ELSE regexp_replace(proposal, '[\r\n]+$', '') END AS chosen FROM
     (SELECT job_id, id, any_value(type) AS type, any_value(proposal) AS proposal, any_value(source_info) AS source_info FROM review_block GROUP BY job_id, id) WHERE source_info.start_pos IS NOT NULL),
p AS (SELECT j.id, b.s, substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || coalesce(chosen || regexp_extract(substr(text, s + 1, e - s), '[\r\n]*$'), substr(text, s + 1, e - s)) AS part
      FROM j JOIN b ON j.id = b.job_id WINDOW w AS (PARTITION BY j.id ORDER BY s, e))
SELECT j.id, coalesce((SELECT string_agg(part, '' ORDER BY s) FROM p WHERE p.id = j.id), '') || substr(text, coalesce((SELECT max(e) FROM b WHERE b.job_id = j.id), 0) + 1) AS document, true AS sound FROM j""".replace("\\\\", "\\"))
def markdown_finalized(spark, folder):
    """Markdown jobs with all proposals accepted; table cells keep their source here."""
    blocks = table(spark, folder, "review_block").select("job_id", "id", "type", "proposal", "source_info.start_pos", "source_info.end_pos").dropDuplicates(["job_id", "id"])
    chosen = F.when(F.col("type") == "table_cell", None).otherwise(F.col("proposal"))
    return finalize.finalized_markdown(_marked_jobs(spark, folder), blocks.withColumn("chosen", chosen))


@query(r"""WITH j AS (SELECT DISTINCT id, decode(source) AS text FROM review_job WHERE document_format = 'md'),
b AS (SELECT job_id, source_info.start_pos AS s, source_info.end_pos AS e, CASE WHEN type = 'table_cell' THEN replace(replace(replace(regexp_replace(regexp_replace(proposal, '\r\n?', chr(10), 'g'), '\s*\n\s*', ' ', 'g'), '\|', chr(1)), '|', '\|'), chr(1), '\|')
      ELSE regexp_replace(proposal, '[\r\n]+$', '') END AS chosen FROM (SELECT job_id, id, any_value(type) AS type, any_value(proposal) AS proposal, any_value(source_info) AS source_info FROM review_block GROUP BY job_id, id) WHERE source_info.start_pos IS NOT NULL),
p AS (SELECT j.id, b.s, substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || coalesce(chosen || regexp_extract(substr(text, s + 1, e - s), '[\r\n]*$'), substr(text, s + 1, e - s)) AS part
      FROM j JOIN b ON j.id = b.job_id WINDOW w AS (PARTITION BY j.id ORDER BY s, e))
SELECT j.id, coalesce((SELECT string_agg(part, '' ORDER BY s) FROM p WHERE p.id = j.id), '') || substr(text, coalesce((SELECT max(e) FROM b WHERE b.job_id = j.id), 0) + 1) AS document, true AS sound FROM j""".replace("\\\\", "\\"))
def markdown_finalized_cells(spark, folder):
    """Markdown jobs with all proposals accepted, those of table cells included, on one line and with their pipes escaped."""
    blocks = table(spark, folder, "review_block").select("job_id", "id", "type", F.col("proposal").alias("chosen"), "source_info.start_pos", "source_info.end_pos").dropDuplicates(["job_id", "id"])
    return finalize.finalized_markdown(_marked_jobs(spark, folder), blocks)


@query(f"""WITH p AS (SELECT DISTINCT pair_key, coalesce(source, '') AS source, coalesce(target, '') AS target, expected FROM en_de), sw AS ({_PLACES.format(side="source", piece=f"{WORD}|[{SPACE}]+", space=SPACE)}),
tw AS ({_PLACES.format(side="target", piece=f"{WORD}|[{SPACE}]+", space=SPACE)}), v(share) AS (VALUES (0.25::double), (0.5::double), (1.0::double)),
c AS (SELECT p.*, v.share, round_even(least((SELECT count(*) FROM sw WHERE sw.pair_key = p.pair_key), (SELECT count(*) FROM tw WHERE tw.pair_key = p.pair_key)) * v.share, 0)::bigint AS links FROM p CROSS JOIN v),
f AS (SELECT pair_key, share, links, j, strpos(source, e[1]) - 1 AS s, length(e[1]) AS sl, strpos(target, e[2]) - 1 AS t, length(e[2]) AS tl FROM (SELECT *, unnest(expected) AS e, generate_subscripts(expected, 1) AS j FROM c)),
h AS (SELECT f.pair_key, f.share, f.j, f.s >= 0 AND f.t >= 0 AND count(sw.k) > 0 AND bool_and(sw.k IS NULL OR (f.t <= tw.a AND tw.b <= f.t + f.tl)) AS hit
      FROM f LEFT JOIN sw ON sw.pair_key = f.pair_key AND sw.k <= f.links AND sw.a < f.s + f.sl AND f.s < sw.b LEFT JOIN tw ON tw.pair_key = sw.pair_key AND tw.k = sw.k GROUP BY f.pair_key, f.share, f.j, f.s, f.t)
SELECT c.share, count(*) AS cases, sum(coalesce(len(c.expected), 0))::bigint AS expected, sum((SELECT count(*) FROM h WHERE h.pair_key = c.pair_key AND h.share = c.share AND h.hit))::bigint AS hit, median(links) AS median_links FROM c GROUP BY c.share""")
def alignment_evaluation(spark, folder):
    return evaluation.report(evaluation.evaluate_alignment(_pairs(spark, folder), [0.25, 0.5, 1.0]))


def _issues(spark, folder):
    return table(spark, folder, "translation_issue").drop("loaded_at").dropDuplicates(["issue_key"])


@query("""SELECT action, diagnostics.stage AS stage, count(*) AS issues, count(diagnostics.attempted_translation) AS attempts, count(DISTINCT run_id) AS runs
FROM (SELECT issue_key, any_value(action) AS action, any_value(run_id) AS run_id, any_value(diagnostics) AS diagnostics FROM translation_issue GROUP BY issue_key) GROUP BY ROLLUP (action, diagnostics.stage)""")
def issue_summary(spark, folder):
    rows = _issues(spark, folder).select("run_id", "action", F.col("diagnostics.stage").alias("stage"), F.col("diagnostics.attempted_translation").alias("attempt"))
    return rows.rollup("action", "stage").agg(F.count(F.lit(1)).alias("issues"), F.count("attempt").alias("attempts"), F.count_distinct("run_id").alias("runs"))


@query("""SELECT run_id, count(*) AS issues, count(*) FILTER (starts_with(action, 'formatting_')) AS formatting, count(*) FILTER (action = 'skipped_content') AS skipped, 3 AS exit_code
FROM (SELECT DISTINCT issue_key, run_id, action FROM translation_issue) GROUP BY run_id""")
def issue_totals(spark, folder):
    return issues.totals(_issues(spark, folder), "run_id")


@query("""SELECT issue_key, error FROM (SELECT issue_key, unnest([CASE WHEN action NOT IN ('retained_original','skipped_content','formatting_dropped','formatting_split','formatting_expanded','formatting_repaired') THEN 'unknown_action' END,
CASE WHEN paragraph_number IS NOT NULL AND segment_type <> 'paragraph' THEN 'paragraph_number' END, CASE WHEN page IS NOT NULL THEN 'page' END]) AS error
FROM (SELECT DISTINCT issue_key, action, paragraph_number, segment_type, page FROM translation_issue)) WHERE error IS NOT NULL""")
def issue_errors(spark, folder):
    return issues.issue_errors(_issues(spark, folder))


@query("""SELECT issue_key, error FROM (SELECT issue_key, unnest([CASE WHEN issue_key % 5 = 0 THEN 'unknown_action' END, CASE WHEN issue_key % 3 = 0 AND segment_type <> 'paragraph' THEN 'paragraph_number' END,
CASE WHEN issue_key % 7 = 0 THEN 'page' END]) AS error FROM (SELECT DISTINCT issue_key, segment_type FROM translation_issue)) WHERE error IS NOT NULL""")
def issue_defects(spark, folder):
    """Issues with planted defects: actions that nobody knows, paragraph numbers on anything, and pages."""
    key = F.col("issue_key")
    rows = _issues(spark, folder).withColumn("action", F.when(key % 5 == 0, F.lit("other")).otherwise(F.col("action")))
    return issues.issue_errors(rows.withColumn("paragraph_number", F.when(key % 3 == 0, 1).otherwise(F.col("paragraph_number"))).withColumn("page", F.when(key % 7 == 0, 1).otherwise(F.col("page"))))


@query("""SELECT error_kind, count(*) AS times FROM (SELECT regexp_replace(unnest(e), ':.*$', '', 's') AS error_kind FROM
(SELECT issue_key, any_value(diagnostics.validation_errors) AS e FROM translation_issue GROUP BY issue_key)) GROUP BY error_kind""")
def validation_error_counts(spark, folder):
    kinds = _issues(spark, folder).select(F.explode("diagnostics.validation_errors").alias("e")).select(F.regexp_replace("e", r"(?s):.*$", "").alias("error_kind"))
    return kinds.groupBy("error_kind").agg(F.count(F.lit(1)).alias("times"))


@query("""SELECT i.issue_key, s.lang, s.document_format, i.original = s.text AS same FROM (SELECT DISTINCT issue_key, run_id, segment_id, original FROM translation_issue) i
JOIN (SELECT DISTINCT run_id, id, lang, document_format, text FROM text_segment) s ON i.run_id = s.run_id AND i.segment_id = s.id""")
def issue_context(spark, folder):
    """Issues with their segments; the larger side is not deduplicated by its text, only by its key."""
    found = _issues(spark, folder).select("issue_key", "run_id", F.col("segment_id").alias("id"), "original")
    segments = table(spark, folder, "text_segment").select("run_id", "id", "lang", "document_format", "text").dropDuplicates(["run_id", "id"])
    return found.join(segments, ["run_id", "id"]).select("issue_key", "lang", "document_format", (F.col("original") == F.col("text")).alias("same"))


@query("""SELECT document_format, median(length(text)) AS median_chars, quantile_disc(length(text), 0.9) AS p90_chars, max(length(text)) AS most_chars FROM
(SELECT DISTINCT seg_key, document_format, text FROM text_segment) GROUP BY document_format""")
def length_percentiles(spark, folder):
    sizes = _delivered(spark, folder, "document_format", F.length("text").alias("size")).dropDuplicates(["seg_key"])
    return sizes.groupBy("document_format").agg(
        F.percentile("size", 0.5).alias("median_chars"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY size)").cast("int").alias("p90_chars"), F.max("size").alias("most_chars")
    )


@query("SELECT seg_key, length(text) AS chars FROM (SELECT DISTINCT seg_key, text FROM text_segment) WHERE text IS NOT NULL ORDER BY length(text) DESC, seg_key LIMIT 20")
def longest_segments(spark, folder):
    """A report of the twenty longest texts; each partition keeps no more than twenty rows, so nothing is sorted as a whole."""
    return _delivered(spark, folder, F.length("text").alias("chars")).where("chars is not null").dropDuplicates(["seg_key"]).orderBy(F.desc("chars"), "seg_key").limit(20)


@query("SELECT id, category, source, reference, upper(replace(source, 'ß', 'ss')) AS translated, NULL::varchar AS error, len(criteria) AS criteria FROM eval_item")
def suite_evaluation(spark, folder):
    """The held-out suite through the upper-case double."""
    done = evaluation.evaluate_suite(table(spark, folder, "eval_item"), backends.upper)
    return done.select("id", "category", "source", "reference", "translated", "error", F.size("kept").alias("criteria"))


@query("SELECT item_id, upper(substr(sha256(source || chr(10) || reference), 1, 16)) AS fingerprint, len(criteria) AS criteria, format IN ('txt', 'markdown', 'html') AS known_format FROM eval_item")
def suite_fingerprints(spark, folder):
    items = table(spark, folder, "eval_item")
    hashed = F.upper(F.substring(F.sha2(F.concat_ws("\n", "source", "reference"), 256), 1, 16))
    return items.select("item_id", hashed.alias("fingerprint"), F.size("criteria").alias("criteria"), F.col("format").isin("txt", "markdown", "html").alias("known_format"))


# ---- review jobs from documents ---------------------------------------------------------------------------------------


def _files(spark, folder):
    """The snapshots of all jobs as files of their names."""
    jobs = table(spark, folder, "review_job").dropDuplicates(["id"])
    return jobs.select(F.concat("id", F.lit("-"), "source_name").alias("name"), "document_format", F.col("source").alias("content"))


_ID = "sha256(id || '-' || source_name || chr(10) || sha256(source) || chr(10) || 'en' || chr(10) || 'de')"


@query(f"""SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, name AS source_name, 'en' AS source_lang, 'de' AS target_lang, sha256(source) AS source_sha256,
CASE document_format WHEN 'txt' THEN 1 WHEN 'md' THEN 2 END AS schema_version, document_format FROM (SELECT DISTINCT id || '-' || source_name AS name, {_ID} AS h, source, document_format FROM review_job)""")
def review_jobs_created(spark, folder):
    return review_jobs.created_jobs(_files(spark, folder), "en", "de").drop("source")


@query(f"""WITH {_LINES}, n AS (SELECT id AS job_id, row_number() OVER (PARTITION BY id ORDER BY block_no) AS seg_no, {_KIND} AS type, whole FROM blocks WHERE NOT blank)
SELECT job_id, (seg_no - 1)::int AS ord, seg_no::varchar AS id, type, whole AS original, CASE WHEN regexp_matches(whole, '\\p{{L}}') THEN upper(replace(whole, 'ß', 'ss')) ELSE whole END AS proposal, NULL::varchar AS action FROM n""")
def review_prepared_txt(spark, folder):
    """Jobs over plain text, with a proposal of the upper-case double for every block."""
    jobs = table(spark, folder, "review_job").where("document_format = 'txt'").dropDuplicates(["id"])
    return review_jobs.prepared_blocks(jobs, backends.upper).select("job_id", "ord", "id", "type", "original", "proposal", "action")


def _prepared_md(spark, folder):
    jobs = table(spark, folder, "review_job").where("document_format = 'md'").dropDuplicates(["id"])
    return jobs, review_jobs.prepared_blocks(jobs, backends.upper)


@query()
def review_prepared_md(spark, folder):
    """The same over Markdown: blocks as they read, literals as they are."""
    return _prepared_md(spark, folder)[1].select("job_id", "ord", "id", "type", "original", "proposal", "action", "source_info.start_pos", "source_info.end_pos", F.array_join("source_info.protected", " | ").alias("protected"))


@query()
def review_block_errors(spark, folder):
    """Markdown jobs that have no form for review, and why."""
    jobs = table(spark, folder, "review_job").where("document_format = 'md'").dropDuplicates(["id"])
    return review_jobs.job_blocks(jobs).where("error is not null").select("job_id", "error")


@query()
def review_finalized_md(spark, folder):
    """Prepared Markdown reviews, all proposals accepted, as documents again: each reads as its proposals, or has no document."""
    jobs, prepared = _prepared_md(spark, folder)
    done = review_jobs.finalized_markdown(jobs, prepared.select("job_id", "id", F.col("proposal").alias("text")))
    return done.select("id", "document", F.array_join("issues", "; ").alias("issues"), "error")


@query("SELECT DISTINCT id, true AS same FROM review_job WHERE document_format = 'md'")
def review_finalized_same(spark, folder):
    """Markdown reviews that accept every original give the snapshot again; those without a form for review have an error and no document."""
    jobs = table(spark, folder, "review_job").where("document_format = 'md'").dropDuplicates(["id"])
    blocks = review_jobs.job_blocks(jobs).where("error is null").select("job_id", "id", F.col("original").alias("text"))
    done = review_jobs.finalized_markdown(jobs, blocks).join(_marked_jobs(spark, folder), "id")
    same = F.regexp_replace("text", "^\ufeff", "") == F.col("document")
    return done.select("id", F.coalesce(same, F.col("error").isNotNull()).alias("same"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, their sentences and matched terms, and how much of them the pipeline translates, by language and format."""
    segments = _segments(spark, folder, "lang", "document_format", "text", "protected_spans")
    done = translate.translate_segments(segments, ["seg_key", "lang", "document_format"], backends.upper, _glossary(spark), form="document_format")
    return done.groupBy("lang", "document_format").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("action").isNotNull()).alias("retained"),
        F.sum(F.size(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))).alias("sentences"), F.sum(F.length("translated")).alias("chars"),
    )
