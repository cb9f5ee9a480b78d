"""Normalisation queries over documents: each gives a digest of the whole normalised text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.functions import text as tx
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import table

#: Put before each text, so that every step has something to do.
MARK = "  Ｈｅｌｌｏ，　World!  @home 你好 «x» "


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(MARK), F.coalesce("text", F.lit(""))).alias("t"))


def _digest(name: str, build, sql: str | None) -> None:
    """`build` makes a column of t; `sql` is the same of t in reference SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", F.md5(build(F.col("t"))).alias("digest"))

    register(name, query, sql and f"SELECT doc_id, md5({sql}) AS digest FROM (SELECT doc_id, '{MARK}' || coalesce(text, '') AS t FROM documents)")


HALF_SQL = f"translate(t, '{tx.FULL}', '{tx.HALF.replace(chr(39), chr(39) * 2)}')"
PUNCT_SQL = f"'{tx.PUNCTUATION}'"
STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{3000}}]+', ''), '[\s\x{{3000}}]+$', '')"
COLLAPSE = r"regexp_replace({0}, '[\s\x{{3000}}]+', ' ', 'g')"
CJK_SQL = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ff00}-\x{ffef}\x{f900}-\x{faff}]"

_digest("norm_nfc", lambda t: tx.unicode_form(t, "NFC"), "nfc_normalize(t)")
_digest("norm_nfkc", lambda t: tx.unicode_form(t, "NFKC"), None)
_digest("norm_halfwidth", tx.to_halfwidth, HALF_SQL)
_digest("norm_replace", lambda t: tx.replace_all(t, {"@": "at", "the": "le", "le ": "la "}), "replace(replace(replace(t, '@', 'at'), 'the', 'le'), 'le ', 'la ')")
_digest("norm_lower", F.lower, "lower(t)")
_digest("norm_punct", tx.remove_punctuation, f"regexp_replace(t, {PUNCT_SQL}, '', 'g')")
_digest("norm_strip", tx.strip_space, STRIP.format("t"))
_digest("norm_collapse", tx.collapse_space, COLLAPSE.format("t"))
_HOW = tx.Normalisation(unicode_form="NFC", replacements={"@": "at"}, lowercase=True, remove_punctuation=True)
_FULL_SQL = f"regexp_replace(lower(replace({HALF_SQL.replace('(t,', '(nfc_normalize(t),')}, '@', 'at')), {PUNCT_SQL}, '', 'g')"
_digest("normalise_default", lambda t: tx.normalise(t, _HOW), COLLAPSE.format(STRIP.format(_FULL_SQL)))
_digest("traditional_to_simplified", lambda t: tx.normalise(t, tx.Normalisation("", False, True, strip=False, collapse=False)), "t")


def tokenise_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", tx.words(F.col("t")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


register(
    "tokenise_words", tokenise_words,
    rf"""WITH d AS (SELECT doc_id, '{MARK}' || coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, {STRIP.format(COLLAPSE.format(f"regexp_replace(t, '({CJK_SQL})', ' " + chr(92) + "1 ', 'g')"))} AS j FROM d)
    SELECT doc_id, len(string_split(j, ' ')) AS n_words, md5(j) AS digest FROM s""",
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "漢字").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.has_cjk(some).alias("cjk"))


register("has_cjk", _flags, f"SELECT doc_id, regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '漢字' ELSE '' END, '{CJK_SQL}') AS cjk FROM documents")


def _by_page(name: str, build: Callable[[Column], Column], column: str, sql: str) -> None:
    register(
        name, lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", build(F.col(column)).alias("value")),
        f"SELECT page_id, {sql} AS value FROM pages",
    )


_by_page("safe_filename", tx.safe_filename, "url", r"regexp_replace(url, '[^\w\-.]', '_', 'g')")
register(
    "fmt_value",
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", tx.fmt(F.when(F.col("event_id") % 17 != 0, F.col("value") + 0.001), 3, "s").alias("shown")),
    "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'N/A' ELSE printf('%.3f', value + 0.001::DOUBLE) || 's' END AS shown FROM events",
)
register(
    "resolve_device",
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", tx.resolve_device(F.element_at(F.array(*map(F.lit, (" GPU", "cuda", "CPU ", "mps"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("device")),
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'mps' ELSE 'cpu' END AS device FROM events",
)
