"""Queries over what is gathered from files and workers: nested regions, calls with errors, changed files, word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.functions import formatting
from folimetry.operators import frequencies, workers
from folimetry.operators import statistics as st
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import SCORES, scores, table
from folimetry.sources import files


#: Turns that are inside each other; the next ones begin a new region of the page.
_DEPTH = 5


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of one page, where each turn's region is inside the turn's before, _DEPTH deep; a few
    aren't JSON."""
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    region = F.concat(F.lit('{"text":'), F.coalesce(text, F.lit("null")), F.lit(',"category":"'), F.col("role"), F.lit('"'))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    turns = table(s, d, "conversations").select("conv_id", "turn", region.alias("r"), F.floor(place / _DEPTH).alias("top"))
    chains = turns.groupBy("conv_id", "top").agg(F.sort_array(F.collect_list(F.struct("turn", "r")), asc=False).alias("x"))
    inner = F.aggregate("x", F.lit(""), lambda a, x: F.concat(x["r"], F.when(a == "", a).otherwise(F.concat(F.lit(',"children":['), a, F.lit("]"))), F.lit("}")))
    pages = chains.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("top", inner.alias("j")))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["j"]), ",")
    return pages.select("conv_id", F.when(F.col("conv_id") % 10 == 9, "{").otherwise(F.concat(F.lit('{"pages":[{"page":7,"regions":['), whole, F.lit("]}]}"))).alias("json"))


register(
    "gt_nested_regions",
    lambda s, d: files.nested_regions(_nested(s, d)).select("conv_id", "page", F.size("path").cast("long").alias("depth"), F.coalesce(F.size("parent"), F.lit(0)).cast("long").alias("parent_depth"), F.md5("region.text").alias("digest"), F.col("region.category").alias("category")),
    f"""SELECT conv_id, 7 AS page, (k - 1) % {_DEPTH} + 1 AS depth, (k - 1) % {_DEPTH} AS parent_depth, md5(coalesce(text, '')) AS digest, role AS category
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE conv_id % 10 <> 9)""",
)


def _recognise(batch: list) -> list:
    """A stand-in for a model: the length of a page's text without tags; it can't bear some pages, and none beside these."""
    if any("<script" in (html or "") for html in batch):
        raise RuntimeError("script")
    return [str(len((html or "").encode())) for html in batch]


def _called(s: SparkSession, d: str) -> DataFrame:
    return workers.call_worker(table(s, d, "pages").select("page_id", "html"), "html", _recognise)


register(
    "worker_calls", lambda s, d: _called(s, d).select("page_id", "result", "error"),
    "SELECT page_id, CASE WHEN NOT coalesce(contains(html, '<script'), false) THEN octet_length(encode(coalesce(html, '')))::VARCHAR END AS result, CASE WHEN contains(html, '<script') THEN 'RuntimeError: script' END AS error FROM pages",
)
register(
    "worker_failures", lambda s, d: workers.failures(_called(s, d).withColumn("part", F.col("page_id") % 7), ["part"]).select("part", "rows", "failed", "commonest_error"),
    """SELECT page_id % 7 AS part, count(*) AS rows, count(*) FILTER (contains(html, '<script')) AS failed, CASE WHEN count(*) FILTER (contains(html, '<script')) > 0 THEN 'RuntimeError: script' END AS commonest_error FROM pages GROUP BY 1""",
)


def _changed(s: SparkSession, d: str) -> DataFrame:
    """Users' last events as files that were last written then, against a log of what was read in the morning."""
    events = table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return files.changed_since(events.groupBy("path").agg(F.max("modified").alias("modified")), events.filter((F.hour("modified") < 12) & (F.col("path").cast("long") % 3 > 0)))


register(
    "changed_results", _changed,
    """WITH f AS (SELECT user_id::VARCHAR AS path, max(ts) AS modified, max(ts) FILTER (hour(ts) < 12 AND user_id % 3 > 0) AS known FROM events GROUP BY 1)
    SELECT path, modified FROM f WHERE known IS NULL OR known <> modified""",
)

# --- words

_WORDS = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT regexp_replace(regexp_replace(u, '^[^\p{L}]+', ''), '[^\p{L}]+$', '') AS bare FROM (SELECT unnest(w) AS u FROM t)),
c AS (SELECT lower(bare) AS word, count(*) AS n FROM f WHERE bare <> '' GROUP BY 1), v AS (SELECT word, n, log10(n / (SELECT sum(n) FROM c) * 1e9) AS level FROM c)"""


def _frequencies(s: SparkSession, d: str) -> DataFrame:
    return frequencies.word_frequencies(table(s, d, "documents"))


register(
    "word_frequency", lambda s, d: _frequencies(s, d).filter(F.col("level") >= frequencies.LEAST).select("word", "n", F.round("level", 4).alias("level")),
    f"{_WORDS} SELECT word, n, round(level, 4) AS level FROM v WHERE level >= 2.5",
)
#: Only words said more often than this per billion count as known in the query; rare joins stay apart.
_KNOWN = 5.0


def _hyphenated(s: SparkSession, d: str) -> DataFrame:
    """Every document as two blocks, cut within its middle word of two characters or more; joined if that is frequent."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: F.char_length(w) >= 2)
    rows = table(s, d, "documents").select("doc_id", words.alias("w")).filter("size(w) > 0").withColumn("at", F.floor(F.size("w") / 2).cast("int"))
    word = F.get("w", F.col("at"))
    cut = F.ceil(F.char_length(word) / 2).cast("int")
    first = F.concat(F.array_join(F.slice("w", 1, F.col("at")), " "), F.lit(" "), F.left(word, cut), F.lit("-"))
    second = F.concat(F.right(word, F.char_length(word) - cut), F.lit(" "), F.array_join(F.slice("w", F.col("at") + 2, F.size("w")), " "))
    blocks = F.array(*(F.struct(F.lit(k).alias("index"), F.lit("text").alias("label"), c.alias("content"), F.lit(None).cast("double").alias("left")) for k, c in enumerate((first, second))))
    known = frequencies.known_words(_frequencies(s, d), _KNOWN)
    made = rows.select("doc_id", formatting.merge_known_words(blocks, known).alias("b"))
    return made.select("doc_id", (F.size("b") == 1).alias("merged"), F.md5(F.array_join(F.transform("b", lambda x: F.rtrim(x["content"])), "|")).alias("digest"))


register(
    "hyphen_merge_words", _hyphenated,
    rf"""{_WORDS}, m AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2) AS w FROM t), k AS (SELECT doc_id, w, len(w) // 2 + 1 AS p FROM m WHERE len(w) > 0),
    x AS (SELECT doc_id, w[p] AS word, ceil(length(w[p]) / 2.0)::INT AS cut, array_to_string(w[1:p - 1], ' ') AS before, array_to_string(w[p + 1:], ' ') AS after FROM k),
    y AS (SELECT *, substr(word, cut + 1) AS tail, lower(regexp_replace(regexp_replace(word, '^[^\p{{L}}]+', ''), '[^\p{{L}}]+$', '')) AS bare FROM x),
    z AS (SELECT y.*, regexp_matches(tail, '^\p{{Ll}}') AND coalesce(level >= {_KNOWN}, false) AS merged FROM y LEFT JOIN v ON v.word = y.bare)
    SELECT doc_id, merged, md5(CASE WHEN merged THEN rtrim(before || ' ' || word || ' ' || after) ELSE before || ' ' || substr(word, 1, cut) || '-|' || rtrim(tail || ' ' || after) END) AS digest FROM z""",
)

# --- groups too large for one task

register(
    "median_merged", lambda s, d: st.median_merged(scores(s, d), ["file"], "seconds").select("file", "median", "ci_lower", "ci_upper", "n"),
    f"""{SCORES}, g AS (SELECT file, list_sort(list(seconds)) AS x, count(seconds) AS n FROM scores GROUP BY 1), r AS (SELECT *, 1.9599639845400536 * sqrt(n) / 2 AS reach FROM g)
    SELECT file, x[ceil(n / 2)::INT] AS median, x[greatest(ceil(n / 2 - reach), 1)::INT] AS ci_lower, x[least(ceil(n / 2 + reach), n)::INT] AS ci_upper, n FROM r""",
)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """A second model's score a page, some way off the first's."""
    return scores(s, d).select("test_set", "page", F.col("score").alias("a"), (F.col("score") + (F.col("page") * 37 % 11 - 5) / 40).alias("b"))


register("paired_merged", lambda s, d: st.paired_merged(_pairs(s, d), ["test_set"], "page"))
