"""Ingest queries: file names, pages and worker documents made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.operators import degrade
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import table
from folimetry.sources import files

register("list_test_sets", lambda s, d: table(s, d, "documents").select(F.col("source").alias("test_set")).distinct(), "SELECT DISTINCT source AS test_set FROM documents")


def _files(s: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (".PNG", ".pdf", ".txt", ".doc"))), (F.col("doc_id") % 4 + 1).cast("int"))
    named = table(s, d, "documents").select("source", F.concat(F.lit("f"), F.col("doc_id").cast("string"), end).alias("file"))
    return named.filter(F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)).isin(*files.SUPPORTED))


register("list_files", _files, "SELECT source, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PNG' ELSE '.pdf' END AS file FROM documents WHERE doc_id % 4 IN (0, 1)")


def _priority(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("stem"), F.md5(F.coalesce("text", F.lit(""))).alias("full_text"))
    return files.first_of(docs.filter(F.col("stem") % 3 != 0).withColumn("full_text", F.upper("full_text")), docs.filter(F.col("stem") % 2 == 0), "stem")


register("gt_priority", _priority, "SELECT doc_id AS stem, CASE WHEN doc_id % 3 <> 0 THEN upper(md5(coalesce(text, ''))) ELSE md5(coalesce(text, '')) END AS full_text, CASE WHEN doc_id % 3 <> 0 THEN 'json' ELSE 'txt' END AS origin FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")


def _txt_pages(s: SparkSession, d: str) -> DataFrame:
    """Lines as pages: each line break becomes a page break."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", f"\n{files.PAGE_BREAK}\n")
    paged = table(s, d, "documents").select("doc_id", F.posexplode(files.text_pages(text)).alias("k", "t"))
    return paged.select("doc_id", (F.col("k") + 1).cast("long").alias("page"), F.md5("t").alias("digest"))


register(
    "gt_txt_pages", _txt_pages,
    r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    k AS (SELECT doc_id, i, CASE WHEN contains(t, chr(10)) THEN regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') ELSE t END AS x, contains(t, chr(10)) AS many FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, md5(x) AS digest FROM k WHERE x <> '' OR NOT many""",
)


def _as_json(s: SparkSession, d: str) -> DataFrame:
    """Conversations as structured documents: turns are pages, each with one region."""
    box = F.when(F.col("turn") % 2 == 0, F.lit('[1,2,30,40]')).otherwise(F.lit('{"x1":1,"y1":2,"x2":30,"y2":40}'))
    region = F.struct(F.col("text").alias("text"), F.col("role").alias("category"))
    page = F.concat(F.lit('{"page":'), F.col("turn").cast("string"), F.lit(',"full_text":'), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(',"regions":[{"bbox":'), box, F.lit(","), F.regexp_replace(F.to_json(region), r"^\{", ""), F.lit("]}"))
    rows = table(s, d, "conversations").select("conv_id", F.struct("turn", page.alias("p")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), ",").alias("ps"))
    return whole.select("conv_id", F.when(F.col("conv_id") % 10 == 9, "{broken").otherwise(F.concat(F.lit('{"pages":['), F.col("ps"), F.lit("]}"))).alias("json"))


def _json_scan(s: SparkSession, d: str) -> DataFrame:
    read = files.json_pages(_as_json(s, d))
    return read.select("conv_id", F.col("page").cast("long").alias("page"), F.md5("full_text").alias("digest"), F.col("regions")[0]["category"].alias("category"), F.col("regions")[0]["bbox"]["y2"].alias("y2"), F.col("regions")[0]["order"].cast("long").alias("reading_order"))


_SCAN = "SELECT conv_id, turn AS page, md5(text) AS digest, role AS category, 40.0::DOUBLE AS y2, -1::BIGINT AS reading_order FROM conversations WHERE conv_id % 10 <> 9"
register("gt_json_scan", _json_scan, _SCAN)


def _response(s: SparkSession, d: str) -> DataFrame:
    schema = "model_load_time_seconds double, pages array<struct<image_path:string,prediction_time_seconds:double,error:string>>"
    made = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id"), F.col("value")))).alias("e"))
    json = F.to_json(F.struct(F.lit(1.5).alias("model_load_time_seconds"), F.transform("e", lambda e: F.struct(F.concat(F.lit("p"), e["event_id"].cast("string")).alias("image_path"), e["value"].alias("prediction_time_seconds"))).alias("pages")))
    read = made.select("user_id", F.from_json(json, schema).alias("r"))
    return read.select("user_id", F.size("r.pages").cast("long").alias("pages"), F.round(F.aggregate("r.pages", F.lit(0.0), lambda a, p: a + p["prediction_time_seconds"]), 4).alias("seconds"), F.exists("r.pages", lambda p: p["error"].isNotNull()).alias("failed"))


register("worker_response_scan", _response, "SELECT user_id, count(*) AS pages, round(sum(value), 4) AS seconds, false AS failed FROM events GROUP BY 1")


def _names(s: SparkSession, d: str) -> DataFrame:
    model, device = files.result_name(F.col("f"))
    named = table(s, d, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("_v2_"), F.when(F.col("c_custkey") % 2 == 0, "cpu").otherwise("cuda"), F.lit("_results.json")).alias("f"))
    return named.select("c_custkey", model.alias("model"), device.alias("device"))


register("parse_result_name", _names, "SELECT c_custkey, lower(c_mktsegment) || '_v2' AS model, CASE WHEN c_custkey % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device FROM customer")
register(
    "strip_upload_prefix", lambda s, d: table(s, d, "customer").select("c_custkey", F.regexp_replace(F.concat(F.when(F.col("c_custkey") % 2 == 0, "0a1b2c3d-").otherwise(""), F.col("c_name")), "^[0-9a-f]{8}-", "").alias("file")),
    "SELECT c_custkey, c_name AS file FROM customer",
)
register(
    "b64_decode", lambda s, d: table(s, d, "part").select("p_partkey", files.image_bytes(F.concat(F.lit("data:image/png;base64,"), F.rtrim(F.base64(F.col("p_name").cast("binary")), F.lit("=")))).cast("string").alias("decoded")),
    "SELECT p_partkey, p_name AS decoded FROM part",
)


def _stale(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events").select(F.col("event_type").alias("test_set"), F.col("user_id").cast("string").alias("file"), F.col("ts").alias("modified"))
    sources = events.groupBy("test_set", "file").agg(F.min("modified").alias("modified"))
    return files.stale(sources, events.filter(F.hour("modified") > 12))


register("cache_stale", _stale, "WITH s AS (SELECT event_type AS test_set, user_id::VARCHAR AS file, min(ts) AS modified FROM events GROUP BY 1, 2), c AS (SELECT event_type AS test_set, user_id::VARCHAR AS file, min(ts) AS oldest FROM events WHERE hour(ts) > 12 GROUP BY 1, 2) SELECT test_set, file, modified FROM s LEFT JOIN c USING (test_set, file) WHERE oldest IS NULL OR oldest < modified")
register("degrade_pixels", lambda s, d: table(s, d, "pages").select("page_id", F.sha2(degrade.degraded(F.coalesce("html", F.lit("")).cast("binary"), F.when(F.col("page_id") % 2 == 0, "noise").otherwise("salt_and_pepper"), F.when(F.col("page_id") % 2 == 0, 25.0).otherwise(0.1)), 256).alias("digest")))


def _export(s: SparkSession, d: str) -> DataFrame:
    """Order lines as annotation exports, a task an order: a rectangle and a text for each line, both with its number as id,
    rectangles in order of parts and texts after them; every seventh order has no annotations. Sizes of pages differ."""
    key = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kind = F.element_at(F.create_map(F.lit("A"), F.lit("Table"), F.lit("N"), F.lit("Picture"), F.lit("R"), F.lit("Formula")), F.col("l_returnflag"))
    sides = ((1000 + 100 * (F.col("l_orderkey") % 5)).alias("original_width"), (2000 + 100 * (F.col("l_orderkey") % 6)).alias("original_height"))
    rectangle = F.to_json(F.struct(
        F.col("l_linenumber").cast("string").alias("id"), F.lit("rectanglelabels").alias("type"), *sides,
        F.struct((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"), F.lit(10).alias("width"), F.lit(5).alias("height"), F.array(kind).alias("rectanglelabels")).alias("value"),
    ))
    written = F.to_json(F.struct(
        F.col("l_linenumber").cast("string").alias("id"), F.lit("textarea").alias("type"), *sides,
        F.struct(F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("é")).alias("text")).alias("value"),
    ))
    tasks = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*key, rectangle.alias("r"), written.alias("t")))).alias("x"))
    results = F.array_join(F.concat(F.transform("x", lambda v: v["r"]), F.transform("x", lambda v: v["t"])), ",")
    body = F.when(F.col("l_orderkey") % 7 == 0, "[]").otherwise(F.concat(F.lit('[{"result":['), results, F.lit("]}]")))
    return tasks.select(F.col("l_orderkey").alias("task"), F.concat(F.lit('{"file_upload":"0a1b2c3d-'), F.col("l_orderkey").cast("string"), F.lit('.png","annotations":'), body, F.lit("}")).alias("json"))


def _annotations(s: SparkSession, d: str) -> DataFrame:
    return files.annotations(_export(s, d)).select("task", "file", F.col("order").cast("long").alias("place"), "category", "text_format", "text", *(F.col(f"bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


register(
    "annotation_convert", _annotations,
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem WHERE l_orderkey % 7 <> 0),
    f AS (SELECT l_orderkey, l_linenumber, min(k) AS first, arg_max(l_partkey, k) AS part, arg_max(l_suppkey, k) AS supp, arg_max(l_returnflag, k) AS flag FROM l GROUP BY 1, 2)
    SELECT l_orderkey AS task, l_orderkey || '.png' AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS place, CASE flag WHEN 'A' THEN 'table' WHEN 'N' THEN 'picture' ELSE 'formula' END AS category,
      CASE flag WHEN 'A' THEN 'html' WHEN 'N' THEN 'plain' ELSE 'latex' END AS text_format, 's' || supp || chr(10) || 'é' AS text,
      (part % 50) * w::DOUBLE AS x1, (supp % 50) * h::DOUBLE AS y1, (part % 50 + 10) * w::DOUBLE AS x2, (supp % 50 + 5) * h::DOUBLE AS y2
    FROM (SELECT *, 10 + l_orderkey % 5 AS w, 20 + l_orderkey % 6 AS h FROM f)""",
)


def _annotated(s: SparkSession, d: str) -> DataFrame:
    return files.annotated_pages(files.annotations(_export(s, d)), ["task", "file"]).select("task", "width", "height", F.size("regions").cast("long").alias("regions"), F.md5("full_text").alias("digest"))


register(
    "annotation_pages", _annotated,
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem WHERE l_orderkey % 7 <> 0),
    f AS (SELECT l_orderkey, l_linenumber, min(k) AS first, arg_max(l_suppkey, k) AS supp, arg_max(l_returnflag, k) AS flag FROM l GROUP BY 1, 2)
    SELECT l_orderkey AS task, 1000 + 100 * (l_orderkey % 5) AS width, 2000 + 100 * (l_orderkey % 6) AS height, count(*) AS regions, md5(coalesce(string_agg(CASE WHEN flag <> 'N' THEN 's' || supp || chr(10) || 'é' END, chr(10) ORDER BY first), '')) AS digest FROM f GROUP BY 1""",
)
