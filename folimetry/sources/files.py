"""Ground truth, worker responses and result files as DataFrames, and sinks that replace what they write whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folimetry.operators.statistics import upsert

# File types that can be evaluated.
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif", ".ppm")
SUPPORTED = (*IMAGES, ".pdf")
PAGE_BREAK = "[PAGE_BREAK]"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
REGION = f"struct<text:string,category:string,bbox:{BOX},confidence:double,text_format:string,order:int>"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(test_set, file, path, modified) of supported files one folder below; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    kept = found.withColumns({"file": F.element_at(parts, -1), "test_set": F.element_at(parts, -2)})
    return kept.filter(F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)).isin(*SUPPORTED)).select("test_set", "file", "path", "modified")


def list_test_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(test_set) of the folders one below that hold files, sorted; none for a folder that isn't there."""
    fs, place = _place(spark, folder)
    if not fs.exists(place):
        return spark.createDataFrame([], "test_set string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -2).alias("test_set"))
    return found.distinct().orderBy("test_set")


def stale(sources: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources without cached pages, or whose oldest cached page is older than the source."""
    oldest = cached.groupBy("test_set", "file").agg(F.min("modified").alias("oldest"))
    return sources.join(oldest, ["test_set", "file"], "left").filter(F.col("oldest").isNull() | (F.col("oldest") < F.col("modified"))).drop("oldest")


def text_pages(text: Column) -> Column:
    """Pages of a plain text: parts between page breaks, trimmed, blank ones dropped; without a break, the text itself."""
    parts = F.filter(F.transform(F.split(text, r"\[PAGE_BREAK\]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.contains(text, F.lit(PAGE_BREAK)), parts).otherwise(F.array(text))


def region_of(v: Column) -> Column:
    """A region of a VARIANT with defaults for what is missing; a box is an object or an array of four."""

    def get(path: str, kind: str, default=None) -> Column:
        found = F.try_variant_get(v, path, kind)
        return found if default is None else F.coalesce(found, F.lit(default))

    sides = [F.coalesce(get(f"$.bbox.{s}", "double"), get(f"$.bbox[{i}]", "double")).alias(s) for i, s in enumerate(("x1", "y1", "x2", "y2"))]
    box = F.struct(*sides)
    return F.struct(
        get("$.text", "string", "").alias("text"), get("$.category", "string", "text").alias("category"), F.when(box["x1"].isNotNull(), box).alias("bbox"),
        get("$.confidence", "double", -1.0).alias("confidence"), get("$.text_format", "string", "plain").alias("text_format"), get("$.order", "int", -1).alias("order"),
    )


def json_pages(documents: DataFrame, text: str = "json") -> DataFrame:
    """The columns of `documents` with one row a page: page number, full text, size and top regions; the whole document
    stays as a VARIANT, so nested regions aren't lost. Malformed documents give no rows."""
    parsed = documents.withColumn("document", F.try_parse_json(text)).filter("document is not null")
    pages = F.coalesce(F.try_variant_get("document", "$.pages", "array<variant>"), F.array().cast("array<variant>"))
    rows = parsed.select("*", F.posexplode(pages).alias("position", "p"))
    number = F.coalesce(F.try_variant_get("p", "$.page_number", "int"), F.try_variant_get("p", "$.page", "int"), F.lit(1))
    regions = F.coalesce(F.try_variant_get("p", "$.regions", "array<variant>"), F.array().cast("array<variant>"))
    return rows.select(
        *documents.columns, "document", "position", number.alias("page"), F.coalesce(F.try_variant_get("p", "$.full_text", "string"), F.lit("")).alias("full_text"),
        F.coalesce(F.try_variant_get("p", "$.width", "int"), F.lit(0)).alias("width"), F.coalesce(F.try_variant_get("p", "$.height", "int"), F.lit(0)).alias("height"),
        F.transform(regions, region_of).alias("regions"),
    )


def nested_regions(documents: DataFrame, text: str = "json") -> DataFrame:
    """The columns of `documents` but its text, with a row for each region at any depth: position of its page, page number,
    path (places from the top region down), parent (the path above, null at the top) and region.

    Children are followed level by level by a recursive query, a Spark job a level, whose rows hold what is below them: meant
    for layouts, which are some levels deep. A region without children, or whose children aren't a list, ends
    there. Entries that aren't objects are regions of defaults. Malformed documents give no rows. Spark stops recursive
    queries at a million rows unless spark.sql.cteRecursionRowLimit says otherwise; where the session leaves it unset, it
    is lifted here.
    """
    spark, others = documents.sparkSession, [c for c in documents.columns if c != text]
    if spark.conf.get("spark.sql.cteRecursionRowLimit", None) in (None, "1000000"):
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    own = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    parsed = documents.select(own.alias("own"), F.try_parse_json(text).alias("document")).filter("document is not null")
    pages = parsed.select("own", F.posexplode(F.try_variant_get("document", "$.pages", "array<variant>")).alias("position", "p"))
    number = F.coalesce(F.try_variant_get("p", "$.page_number", "int"), F.try_variant_get("p", "$.page", "int"), F.lit(1))
    tops = pages.select("own", "position", number.alias("page"), F.try_variant_get("p", "$.regions", "array<variant>").alias("regions"))
    found = spark.sql(
        """WITH RECURSIVE r(own, position, page, path, v) MAX RECURSION LEVEL 100000 AS (
          SELECT own, position, page, array(e.pos), e.col FROM {tops}, LATERAL posexplode(regions) e
          UNION ALL
          SELECT r.own, r.position, r.page, concat(r.path, array(e.pos)), e.col FROM r, LATERAL posexplode(try_variant_get(r.v, '$.children', 'array<variant>')) e
        ) SELECT * FROM r""",
        tops=tops,
    )
    parent = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1))
    return found.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(others)), "position", "page", "path", parent.alias("parent"), region_of(F.col("v")).alias("region"))


def first_of(json: DataFrame, txt: DataFrame, key: str) -> DataFrame:
    """A stem's structured ground truth, else its plain one."""
    both = json.select(key, F.col("full_text").alias("a")).join(txt.select(key, F.col("full_text").alias("b")), key, "full")
    return both.select(key, F.coalesce("a", "b").alias("full_text"), F.when(F.col("a").isNotNull(), "json").otherwise("txt").alias("origin"))


TASK = "image_paths array<string>, device string, params string"
RESPONSE = (
    "model_load_time_seconds double, ram_before_load_mb double, ram_after_load_mb double, peak_ram_mb double, vram_before_load_mb double, vram_after_load_mb double, peak_vram_mb double, "
    "pages array<struct<image_path:string,prediction_time_seconds:double,ram_after_mb:double,result:string,error:string>>"
)


def task_documents(images: DataFrame, keys: list[str], device: str = "cpu", params: str = "{}") -> DataFrame:
    """keys and a worker's task as JSON, one a key, from images(keys, position, path): paths in order, device, parameters."""
    paths = images.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "path"))).alias("p"))
    head = F.to_json(F.struct(F.col("p.path").alias("image_paths"), F.lit(device).alias("device")))
    return paths.select(*keys, F.concat(F.regexp_replace(head, r"\}$", ',"params":'), F.lit(params), F.lit("}")).alias("document"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """file and the fields of each worker response below a path, a file each; times default to 0, and a file that isn't JSON
    has null pages. Results stay JSON texts, for json_pages() or layout_page()."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    read = whole.select("file", F.from_json("value", RESPONSE).alias("r"))
    times = ("model_load_time_seconds", "ram_before_load_mb", "ram_after_load_mb", "peak_ram_mb")
    return read.select("file", *(F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in times), *(f"r.{c}" for c in ("vram_before_load_mb", "vram_after_load_mb", "peak_vram_mb", "pages")))


def image_bytes(source: Column) -> Column:
    """Bytes of a data URL, of text between base64 markers, or of raw base64 of 32 characters or more; else null."""
    inner = F.when(F.startswith(source, F.lit("data:")), F.substring_index(source, ",", -1)).when(F.contains(source, F.lit("<|base64|>")), F.regexp_extract(source, r"<\|base64\|>([A-Za-z0-9+/=]*)", 1)).when(source.rlike(r"^[A-Za-z0-9+/=]{32,}$"), source)
    bare = F.rtrim(inner, F.lit("="))
    return F.unbase64(F.rpad(bare, (F.ceil(F.char_length(bare) / 4) * 4).cast("int"), F.lit("=")))


def result_name(file: Column) -> tuple[Column, Column]:
    """Model and device of <model>_<device>_results.json: split at the last underscore."""
    stem = F.regexp_replace(file, r"_results\.json$", "")
    return F.regexp_extract(stem, r"^(.*)_[^_]*$", 1), F.regexp_extract(stem, r"([^_]*)$", 1)


def annotations(exports: DataFrame, text: str = "json") -> DataFrame:
    """The columns of `exports` but its text, with one row a region of each annotation export: file, order, text, category,
    text_format, bbox in pixels, and the page's width and height.

    Of a task's annotations the first counts. A rectangle and a text belong together by id (none is an id, too); of several
    rectangles or texts of an id the last counts, and regions are ordered by their id's first rectangle. Turned rectangles
    give the upright box around them. The page's size is that of its first item. Tasks without annotations or results, and
    malformed ones, give no rows. A task is worked on in its own row: none is numbered, joined or shuffled, so that repeated
    tasks stay apart however rows come.
    """
    others = [c for c in exports.columns if c != text]
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)]
    parsed = exports.select(*own, F.try_parse_json(text).alias("__v")).filter("__v is not null")
    upload = F.regexp_replace(F.coalesce(F.try_variant_get("__v", "$.file_upload", "string"), F.lit("")), "^[0-9a-f]{8}-", "")
    kept = [F.col(f"__c{i}") for i in range(len(others))]

    def item(v: Column) -> Column:
        def get(path: str, kind: str) -> Column:
            return F.try_variant_get(v, path, kind)

        sides = {n: get(f"$.value.{n}", "double") for n in ("x", "y", "width", "height")}
        return F.struct(
            get("$.id", "string").alias("id"), get("$.type", "string").alias("kind"), *(c.alias(n) for n, c in sides.items()), F.coalesce(get("$.value.rotation", "double"), F.lit(0.0)).alias("rotation"),
            get("$.original_width", "int").alias("page_width"), get("$.original_height", "int").alias("page_height"), F.lower(get("$.value.rectanglelabels[0]", "string")).alias("category"),
            F.array_join(get("$.value.text", "array<string>"), "\n").alias("text"),
        )

    def last(items: Column) -> Column:
        return F.get(items, F.size(items) - 1)

    found = F.try_variant_get("__v", "$.annotations[0].result", "array<variant>")
    items = parsed.select(*kept, upload.alias("__file"), F.transform(found, item).alias("__items"))
    split = items.select(*kept, "__file", "__items", F.filter("__items", lambda i: i["kind"] == "rectanglelabels").alias("__boxes"), F.filter("__items", lambda i: i["kind"] == "textarea").alias("__texts"))
    ids = F.array_distinct(F.transform("__boxes", lambda b: b["id"]))
    rows = split.select(*kept, "__file", F.get("__items", F.lit(0)).alias("__head"), "__boxes", "__texts", F.posexplode(ids).alias("order", "__id"))
    placed = rows.select(
        *kept, "__file", "__head", "order", last(F.filter("__boxes", lambda b: b["id"].eqNullSafe(F.col("__id")))).alias("__box"),
        last(F.filter("__texts", lambda t: t["id"].eqNullSafe(F.col("__id"))))["text"].alias("__text"),
    )
    category = F.col("__box.category")
    return placed.select(
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(others)), F.col("__file").alias("file"), "order", F.coalesce("__text", F.lit("")).alias("text"), category.alias("category"),
        F.when(category == "table", "html").when(category == "formula", "latex").otherwise("plain").alias("text_format"), upright(F.col("__box")).alias("bbox"),
        F.col("__head.page_width").alias("width"), F.col("__head.page_height").alias("height"),
    )


def upright(shape: Column) -> Column:
    """The box in pixels, to a tenth, around a rectangle given in percent of its page and turned about its centre."""
    x, w = (shape[n] / 100 * shape["page_width"] for n in ("x", "width"))
    y, h = (shape[n] / 100 * shape["page_height"] for n in ("y", "height"))
    cos, sin = F.cos(F.radians(shape["rotation"])), F.sin(F.radians(shape["rotation"]))
    across, down = (F.abs(w * cos) + F.abs(h * sin)) / 2, (F.abs(w * sin) + F.abs(h * cos)) / 2
    turned = shape["rotation"] != 0
    sides = {
        "x1": F.when(turned, x + w / 2 - across).otherwise(x), "y1": F.when(turned, y + h / 2 - down).otherwise(y),
        "x2": F.when(turned, x + w / 2 + across).otherwise(x + w), "y2": F.when(turned, y + h / 2 + down).otherwise(y + h),
    }
    return F.struct(*(F.bround(c, 1).alias(n) for n, c in sides.items()))


def annotated_pages(found: DataFrame, keys: list[str]) -> DataFrame:
    """Ground truth pages of annotations(): regions in order, and the texts that aren't empty or in pictures, a line each."""
    entry = F.struct("order", "text", "category", "bbox", "text_format")
    pages = found.groupBy(*keys, "width", "height").agg(F.sort_array(F.collect_list(entry)).alias("regions"))
    shown = F.filter("regions", lambda r: (r["text"] != "") & (r["category"] != "picture"))
    return pages.select(*keys, F.lit(1).alias("page"), F.array_join(F.transform(shown, lambda r: r["text"]), "\n").alias("full_text"), "width", "height", "regions")


def metric_columns(df: DataFrame, left_out: tuple[str, ...] = ("Runs", "Pages")) -> list[str]:
    """Numeric columns of a summary that can be charted: no interval bounds (CI), no counts."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and "CI" not in f.name and f.name not in left_out]


def load_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the image files below a folder; bytes as stored, for there is no decoder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*IMAGES)).select("path", "content")


# --- results that arrive or change

#: A result file's summary: what its name says where its content doesn't.
RESULT = "model_name string, test_set string, device string, timestamp string, measured_runs long, total_pages_processed long, average_prediction_time_s_per_page double"


def changed_since(listed: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of listed(path, modified) that log(path, modified) doesn't have, or has at another time. The newest entry counts."""
    known = log.groupBy("path").agg(F.max("modified").alias("__known"))
    return listed.join(known, "path", "left").filter(F.col("__known").isNull() | (F.col("__known") != F.col("modified"))).drop("__known")


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of the result files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_results.json").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"))


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and a summary row of each result file: model and device by content, else by name, test set by folder; files that aren't JSON give no rows."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    read = whole.select("path", F.try_parse_json("value").alias("v"), F.from_json("value", RESULT).alias("r")).filter("v is not null")
    parts = F.split("path", "/")
    model, device = result_name(F.element_at(parts, -1))
    return read.select(
        "path", F.coalesce("r.model_name", model).alias("Model"), F.coalesce("r.test_set", F.element_at(parts, -2)).alias("Test Set"), F.coalesce("r.device", device).alias("Device"),
        F.col("r.timestamp").alias("Timestamp"), F.col("r.measured_runs").alias("Runs"), F.col("r.total_pages_processed").alias("Pages"), F.col("r.average_prediction_time_s_per_page").alias("Avg Speed (s/page)"),
    )


def refresh_summary(spark: SparkSession, folder: str, summary: str, log: str) -> int:
    """Read the result files that are new or have changed since the log, merge them into the summary and note them; how many
    they are. The log is written last: after a crash the same files are read once more, to the same effect. Of files with
    the same model, test set and device the newest counts. Paths that changed go through the driver, contents don't."""
    restore_table(spark, log)
    fs, place = _place(spark, log)
    old = spark.read.schema("path string, modified timestamp").parquet(log) if fs.exists(place) else spark.createDataFrame([], "path string, modified timestamp")
    found = changed_since(result_files(spark, folder), old).collect()
    if not found:
        return 0
    times = spark.createDataFrame([(r.path, r.modified) for r in found], "path string, modified timestamp")
    stamped = read_results(spark, [r.path for r in found]).join(times, "path", "left")
    newest = F.row_number().over(Window.partitionBy(*SUMMARY_KEYS).orderBy(F.desc("modified"), F.desc("path")))
    rows = stamped.withColumn("__k", newest).filter("__k = 1").drop("__k", "path", "modified")
    upsert_summary(rows, summary)
    replace_table(old.join(times.select("path"), "path", "left_anti").unionByName(times), log)
    return len(found)


# --- sinks


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_table(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    """Write beside the old table, move that aside, then swap: readers of the old one may feed the new one, and at any time
    the old or the new table is whole, at `path` or beside it (`-old`); restore_table() puts it back after a crash."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(staging)
    restore_table(spark, path)
    fs, target = _place(spark, path)
    old, new = _place(spark, f"{path.rstrip('/')}-old")[1], _place(spark, staging)[1]
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"{staging} can't be moved to {path}")
    fs.delete(old, True)


def restore_table(spark: SparkSession, path: str) -> None:
    """Put the old table back where a replacement stopped half-way; a finished one's old table is deleted."""
    fs, target = _place(spark, path)
    old = _place(spark, f"{path.rstrip('/')}-old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"{old} can't be put back")


SUMMARY_KEYS = ("Model", "Test Set", "Device")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary CSV, all columns as text, N/A and the like as written; none gives no rows."""
    restore_table(spark, path)
    fs, target = _place(spark, path)
    if not fs.exists(target):
        return spark.createDataFrame([], ", ".join(f"`{k}` string" for k in SUMMARY_KEYS))
    return spark.read.option("header", "true").option("nullValue", "\u0000").option("multiLine", "true").option("escape", '"').csv(path)


def upsert_summary(rows: DataFrame, path: str, keys: tuple[str, ...] = SUMMARY_KEYS) -> None:
    """Replace the rows of equal key in a summary CSV, append the others; columns that one side lacks are empty."""
    shown = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns))
    merged = upsert(read_summary(rows.sparkSession, path), shown, list(keys))
    replace_table(merged.fillna("").coalesce(1), path, "csv", header="true", escape='"', emptyValue="")


def write_results(documents: DataFrame, path: str, document: str = "document") -> None:
    """Result documents, JSON already, a line each; replaces what was there."""
    replace_table(documents.select(F.col(document).alias("value")), path, "text")
