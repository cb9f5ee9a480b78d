"""URL filters: host-suffix and path-prefix expressions joined to hashed rules.

A URL is expanded into every host suffix (on label borders) combined with every path prefix whose length some rule has.
Each expression meets the rules in an equi-join on a short prefix of its SHA-256; the full digest confirms the match.
The longest rule wins; of equally long ones that with the longer host, then the smaller text. All of it is built-in
expressions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query's contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHORT_HEX = 8
#: Up to this many rules the hashed rules are broadcast (some 10 MB); beyond, the join shuffles and AQE splits hot expressions.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tail(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """Host after the first `://`, A-Z lower-cased; null or no `://`: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_tail(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Suffixes of at most `labels` labels times path prefixes of the given lengths: none is left out that a rule could equal."""
    parts = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    paths = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def hashed_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row a rule with digest and precedence; a rule given twice with two verdicts is an error."""
    if len({(h, p) for h, p, _ in rules}) != len({tuple(r) for r in rules}):
        raise ValueError("a rule has two verdicts")
    if any(not h or not p.startswith("/") or v not in ("allow", "block") for h, p, v in rules):
        raise ValueError("a rule is a host, a path from '/' and allow or block")
    rows = [(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in dict.fromkeys(map(tuple, rules))]
    made = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    return made.select(
        digest.alias("rule_digest"),
        F.substring(digest, 1, SHORT_HEX).alias("rule_short"),
        F.struct(
            (F.char_length("rule_host") + F.char_length("rule_path")).alias("size"),
            F.char_length("rule_host").alias("host_size"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        ).alias("hit"),
    )


def filter_urls(
    urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", keys: tuple[str, ...] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """keys, host, path, rule (null without a match) and verdict (`default` without one) of every row.

    Null, empty and malformed URLs have empty host and path, so no rule fits and the default holds. Repeated rows are
    judged one by one. Other columns, whatever their names, are not carried. An empty table gives an empty result.
    """
    kept = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    rows = urls.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    labels = max([1, *(h.count(".") + 1 for h, _, _ in rules)])
    lengths = sorted({len(p) for _, p, _ in rules}) or [1]
    digest = F.sha2("expression", 256)
    opened = (
        rows.withColumn("expression", F.explode_outer(url_expressions(F.col("host"), F.col("path"), labels, lengths)))
        .withColumn("digest", digest)
        .withColumn("short", F.substring("digest", 1, SHORT_HEX))
        .drop("expression")
    )
    hashed = hashed_rules(urls.sparkSession, rules)
    if len(rules) <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)
    met = opened.join(hashed, (F.col("short") == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")), "left")
    names = [f"key_{i}" for i in range(len(keys))]
    ranked = F.struct("hit.size", "hit.host_size", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    best = met.groupBy("row_id", *names, "host", "path").agg(F.max(F.when(F.col("hit").isNotNull(), ranked)).alias("best"))
    return best.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP10_SQL = r"""
WITH t AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM t
), r(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""
