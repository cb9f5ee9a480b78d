"""Parser queries; raw outputs are made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.functions import layouts, parse
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import table


def _text(name: str, source: str, key: str, made, build, sql: str | None) -> None:
    """A digest of `build` of a text that `made` makes; SQL is an expression of t, in a query with t in it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, made().alias("t"))
        return rows.select(key, F.md5(build(F.col("t"))).alias("digest"))

    register(name, query, sql)


def _digest(expression: str, made: str, source: str, key: str) -> str:
    return f"SELECT {key}, md5({expression}) AS digest FROM (SELECT {key}, {made} AS t FROM {source})"


def _turn():
    return F.coalesce("text", F.lit(""))


_DOC = ("documents", "doc_id")
_text("fence_strip", *_DOC, lambda: F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), _turn(), F.lit("\n```"))).otherwise(_turn()), parse.strip_fence, "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
_text("think_strip", *_DOC, lambda: F.concat(F.lit("<think>plan\nmore</think>\n"), _turn(), F.lit("\n</think>")), parse.strip_thoughts, _digest(r"trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g'))", "'<think>plan' || chr(10) || 'more</think>' || chr(10) || coalesce(text, '') || chr(10) || '</think>'", *_DOC))
_text("html_text", "pages", "page_id", lambda: F.coalesce("html", F.lit("")), parse.html_text, _digest(r"trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))", "coalesce(html, '')", "pages", "page_id"))
_text("html_first_table", "pages", "page_id", lambda: F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 2 == 0, "<table><tr><td>1</td></tr></table> x <table></table>").otherwise("")), parse.first_table, _digest(r"CASE WHEN regexp_matches(t, '(?s)<table.*?</table>') THEN regexp_extract(t, '(?s)<table.*?</table>') ELSE t END", "coalesce(html, '') || CASE WHEN page_id % 2 = 0 THEN '<table><tr><td>1</td></tr></table> x <table></table>' ELSE '' END", "pages", "page_id"))
_text("formula_number", "part", "p_partkey", lambda: F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "（").otherwise("("), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "）").otherwise(")"), F.lit(" ")), parse.formula_number, _digest("CASE WHEN (starts_with(trim(t), '(') AND ends_with(trim(t), ')')) OR (starts_with(trim(t), '（') AND ends_with(trim(t), '）')) THEN substr(trim(t), 2, length(trim(t)) - 2) ELSE trim(t) END", "' ' || CASE WHEN p_partkey % 2 = 0 THEN '（' ELSE '(' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '）' ELSE ')' END || ' '", "part", "p_partkey"))
_text("content_clean", *_DOC, lambda: F.concat(_turn(), F.lit("........ ······· ______")), parse.cap_runs, _digest(r"regexp_replace(regexp_replace(regexp_replace(t, '\.{4,}', '...', 'g'), '·{4,}', '···', 'g'), '_{4,}', '___', 'g')", "coalesce(text, '') || '........ ······· ______'", *_DOC))
_text("content_clean_whole", *_DOC, lambda: F.concat(_turn(), F.lit("........ ······· ______")), parse.clean_content, None)
_text("region_preview", *_DOC, _turn, parse.preview, _digest("CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || '...' ELSE s END", "t0", "_", "doc_id").replace("(SELECT doc_id, t0 AS t FROM _)", r"(SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), chr(10), ' ↵ ', 'g'), '([|<>])', '\\\1', 'g') AS s FROM documents)"))
_text("inline_formula", *_DOC, lambda: F.concat(F.lit("see $ x + y $here, a$b$c "), _turn()), parse.inline_formulas, None)
_text("repeat_guard", "conversations", "conv_id", lambda: F.concat("text", F.repeat(F.concat(F.lit("again and "), F.col("role"), F.lit(" ")), 12), F.lit("tail")), parse.repeat_guard, None)
_text("chat_cleanup", "conversations", "conv_id", lambda: F.concat(F.lit("system\nhi\nAssistant\n"), F.col("text"), F.lit("\nuser")), parse.chat_cleanup, "SELECT conv_id, md5(trim(text)) AS digest FROM conversations")


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ("table", "formula", "text"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy(parse.text_format(category, _turn()).alias("format")).agg(F.count("*").alias("n"))


register("text_format", _formats, "SELECT CASE WHEN doc_id % 3 = 0 THEN 'html' WHEN doc_id % 3 = 1 THEN 'latex' WHEN contains(text, '**') OR contains(text, '##') OR contains(text, '- ') OR contains(text, '* ') THEN 'markdown' ELSE 'plain' END AS format, count(*) AS n FROM documents GROUP BY 1")


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n"), _turn())).otherwise(_turn())
    head, body = parse.front_matter(F.col("t"))
    keyed = F.regexp_extract(F.col("head"), r"lang:\s*(\S*)", 1)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("t")).select("doc_id", head.alias("head"), F.md5(F.trim(F.ltrim(body))).alias("body")).select("doc_id", keyed.alias("lang"), "body")


register("front_matter", _front, r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS lang, md5(trim(CASE WHEN doc_id % 2 = 0 THEN chr(10) || coalesce(text, '') ELSE coalesce(text, '') END)) AS body FROM documents""")


def _layout_json(cut: bool):
    """Order lines as a model's list of boxes, one text a page, maybe cut off in its last item."""
    def item():
        return F.concat(F.lit('{"bbox":['), F.concat_ws(",", "l_partkey", "l_suppkey", "l_linenumber", "l_partkey"), F.lit('],"category":"'), F.col("l_returnflag"), F.lit('","text":"t'), F.col("l_suppkey").cast("string"), F.lit('"}'))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("o"), item().alias("i"))
        pages = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "i"))), lambda x: x["i"]), ", ").alias("body"))
        text = F.concat(F.lit("["), F.col("body"), F.lit(', {"bbox":[1,2') if cut else F.lit("]"))
        return pages.select("page", text.alias("t"))

    return query


def _layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "array<struct<bbox:array<bigint>,category:string,text:string>>"
    read = _layout_json(False)(spark, sf_dir).select("page", F.posexplode(F.from_json("t", schema)).alias("k", "r"))
    return read.groupBy("page").agg(F.count("*").alias("regions"), F.sum(F.col("r.bbox")[0]).alias("x1"), F.sum(F.when(F.col("r.category") == "A", 1).otherwise(0)).cast("long").alias("a"))


register("layout_json_regions", lambda s, d: _layout_regions(s, d), "SELECT l_orderkey AS page, count(*) AS regions, sum(l_partkey)::BIGINT AS x1, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a FROM lineitem GROUP BY 1")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _layout_json(True)(spark, sf_dir).select("page", parse.truncated_layout(F.col("t")).alias("t"))
    return fixed.select("page", F.size(F.from_json("t", "array<struct<bbox:array<bigint>>>")).cast("long").alias("regions"))


register("json_truncate", lambda s, d: _truncated(s, d), "SELECT l_orderkey AS page, count(*) AS regions FROM lineitem GROUP BY 1")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page's regions but headers, which lines of category R become; a page without others stays as it is."""
    read = _layout_json(False)(spark, sf_dir).select("page", F.replace("t", F.lit('"category":"R"'), F.lit('"category":"header"')).alias("t"))
    made = layouts.layout_markdown(F.col("t"))
    return read.select("page", F.when(made != F.col("t"), made).otherwise("").alias("markdown"))


register("json_to_markdown", _markdown, "SELECT l_orderkey AS page, coalesce(string_agg(CASE WHEN l_returnflag <> 'R' THEN 't' || l_suppkey END, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag), '') AS markdown FROM lineitem GROUP BY 1")


def _inline_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written into text as ![image](image_N.png)x1,y1,x2,y2; those without area are left out."""
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" ![image](image_1.png)1,2,"), F.col("p_size").cast("string"), F.lit(",40 and ![image](image_2.png)5,5,5,9")).alias("t"))
    pattern = r"!\[image\]\(image_\d+\.png\)(\d+),(\d+),(\d+),(\d+)"
    sides = [F.regexp_extract_all("t", F.lit(pattern), k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"), 1)]
    boxes = made.select("p_partkey", F.explode(F.arrays_zip(*sides)).alias("b")).select("p_partkey", *[F.col(f"b.{n}").cast("long").alias(n) for n in ("x1", "y1", "x2", "y2")])
    return boxes.filter((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


register("inline_box_regions", _inline_boxes, "SELECT p_partkey, 1::BIGINT AS x1, 2::BIGINT AS y1, p_size::BIGINT AS x2, 40::BIGINT AS y2 FROM part WHERE p_size > 1")
