"""Queries of layout parsers and the formatter; model outputs are made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.functions import formatting, layouts, parse
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import table

KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


def _pages(s: SparkSession, d: str, item: Column, joiner: str = ",") -> DataFrame:
    """page and body: an order's lines, each as `item`, in order."""
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct(*KEYS, item.alias("i")))).alias("x"))
    return rows.select("page", F.array_join(F.transform("x", lambda v: v["i"]), joiner).alias("body"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


# --- JSON


def _wrapped(s: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit('{"bbox":['), F.col("l_partkey").cast("string"), F.lit(',2],"text":"a{"}'))
    pages = _pages(s, d, item)
    whole = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    raw = F.when(F.col("page") % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("page") % 3 == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" and [more]"))).otherwise(F.concat(F.lit("open ["), F.col("body")))
    return pages.select("page", F.md5(layouts.extract_json(raw)).alias("digest"))


_BODY = f"""WITH l AS (SELECT *, {_PLACE} AS k FROM lineitem), p AS (SELECT l_orderkey AS page, string_agg('{{"bbox":[' || l_partkey || ',2],"text":"a{{"}}', ',' ORDER BY k) AS body FROM l GROUP BY 1)"""
register("json_extract", _wrapped, f"{_BODY} SELECT page, md5(CASE WHEN page % 3 = 2 THEN 'open [' || body ELSE '[' || body || ']' END) AS digest FROM p")


def _layout(dialect: str):
    """Lines as items: every fourth page is an object around them, every ninth is cut off; items without text, of unknown
    categories, with reversed or missing boxes, and values that are no objects, occur."""

    def query(s: SparkSession, d: str) -> DataFrame:
        names = ("Text", "Table", "Page-header", "Odd") if dialect == "capitalised" else ("text", "table", "header", " Odd ")
        label = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 4 + 1).cast("int"))
        box = F.when(F.col("l_suppkey") % 5 == 0, "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", F.col("l_partkey") % 900, F.lit("20"), F.col("l_suppkey") % 700, F.lit("30.5")), F.lit("]")))
        words = F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("t "), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, " **").otherwise("")))
        item = F.when(F.col("l_linenumber") == 2, "17").otherwise(F.concat(F.lit('{"bbox":'), box, F.lit(',"category":"'), label, F.lit('","text":"'), words, F.lit('"}')))
        key = "layout" if dialect == "capitalised" else "results"
        body = F.col("body")
        whole = F.when(F.col("page") % 9 == 0, F.concat(F.lit("["), body)).when(F.col("page") % 4 == 0, F.concat(F.lit(f'{{"{key}":['), body, F.lit("]}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        pages = _pages(s, d, item).select("page", whole.alias("json"))
        read = pages.select("page", layouts.layout_page(F.col("json"), F.lit(800), F.lit(600), dialect).alias("p"))
        of = F.col("p.regions")
        x = F.transform(F.filter(of, lambda r: r["bbox"].isNotNull()), lambda r: r["bbox"]["x1"] + r["bbox"]["x2"])
        return read.select(
            "page", F.md5("p.full_text").alias("digest"), F.size(of).cast("long").alias("regions"), F.size(x).cast("long").alias("boxes"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sides"),
            F.array_join(F.transform(of, lambda r: F.concat_ws(":", r["order"], r["category"], r["text_format"])), " ").alias("kinds"),
        )

    return query


def _layout_sql(dialect: str) -> str:
    names = {"capitalised": ("Text", "Table", "Page-header", "Odd"), "snake": ("text", "table", "header", " Odd ")}[dialect]
    label = f"CASE l_partkey % 4 WHEN 0 THEN '{names[0]}' WHEN 1 THEN '{names[1]}' WHEN 2 THEN '{names[2]}' ELSE '{names[3]}' END"
    raw = f"""CASE WHEN l_linenumber = 2 THEN '17' ELSE '{{"bbox":' || CASE WHEN l_suppkey % 5 = 0 THEN 'null' ELSE '[' || (l_partkey % 900) || ',20,' || (l_suppkey % 700) || ',30.5]' END || ',"category":"' || {label} || '","text":"' || t || '"}}' END"""
    form = "CASE l_partkey % 4 WHEN 1 THEN 'html' ELSE " + ("CASE WHEN contains(t, '**') THEN 'markdown' ELSE 'plain' END" if dialect == "capitalised" else "'markdown'") + " END"
    x1, x2 = ("l_partkey % 900", "l_suppkey % 700") if dialect == "capitalised" else ("least(l_partkey % 900, 800)", "least(l_suppkey % 700, 800)")
    boxed = "l_suppkey % 5 <> 0" + ("" if dialect == "capitalised" else f" AND {x1} <> {x2}")
    return f"""WITH k AS (SELECT *, {_PLACE} AS k, CASE WHEN l_linenumber = 3 THEN '' ELSE 't ' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN ' **' ELSE '' END END AS t FROM lineitem),
    l AS (SELECT *, {raw} AS raw, CASE l_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'page-header' ELSE 'odd' END AS c, {form} AS f, l_linenumber <> 2 AS ok, l_linenumber <> 2 AND {boxed} AS boxed, {x1} + {x2} AS sides FROM k)
    SELECT l_orderkey AS page, md5(CASE WHEN l_orderkey % 9 = 0 THEN '[' || string_agg(raw, ',' ORDER BY k) ELSE coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k) FILTER (ok AND t <> '' AND c <> 'page-header'), '') END) AS digest,
      CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE count(*) FILTER (ok) END AS regions, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE count(*) FILTER (boxed) END AS boxes,
      CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE coalesce(sum(sides) FILTER (boxed), 0) END::DOUBLE AS sides,
      CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE coalesce(string_agg((k - 1) || ':' || c || ':' || f, ' ' ORDER BY k) FILTER (ok), '') END AS kinds FROM l GROUP BY l_orderkey"""


for _dialect in ("capitalised", "snake"):
    register(f"layout_json_{_dialect}", _layout(_dialect), _layout_sql(_dialect))


# --- fences


def _fences(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(_text(), "`", "'"), r"^\s+|\s+$", "").alias("t"))
    fenced = {
        "ends": F.concat(F.lit(" ```json\n"), "t", F.lit("\n``` ")), "json": F.concat(F.lit("so:\n```json\n"), "t", F.when(F.col("doc_id") % 2 == 0, "\n```\nend").otherwise("")),
        "markdown": F.concat(F.lit("```markdown\n"), "t", F.when(F.col("doc_id") % 2 == 0, "\n``` end").otherwise("")), "whole": F.concat(F.lit("\n```html\n"), "t", F.when(F.col("doc_id") % 2 == 0, "\n```\n").otherwise("")),
    }
    return docs.select("doc_id", *(F.md5(parse.strip_fence(c, kind)).alias(kind) for kind, c in fenced.items()))


register(
    "fence_variants", _fences,
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), '`', chr(39)), '^\s+', ''), '\s+$', '') AS t, chr(10) AS n FROM documents)
    SELECT doc_id, md5(t) AS ends, md5(t) AS json, md5(CASE WHEN doc_id % 2 = 0 THEN t ELSE '```markdown' || n || t END) AS markdown,
      md5(CASE WHEN doc_id % 2 = 0 THEN t ELSE regexp_replace('```html' || n || t, '\s+$', '') END) AS whole FROM t""",
)

# --- regions of text

register(
    "plain_region",
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode_outer(layouts.plain_page(F.col("text"))).alias("r")).select("doc_id", F.md5("r.text").alias("digest"), F.col("r.category").alias("category"), F.col("r.text_format").alias("text_format")),
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t FROM documents)
    SELECT doc_id, CASE WHEN t <> '' THEN md5(t) END AS digest, CASE WHEN t <> '' THEN 'text' END AS category, CASE WHEN t <> '' THEN 'plain' END AS text_format FROM t""",
)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Documents with a title, sections, tables of both kinds and formulas around them."""
    made = F.concat(F.lit("# Title \n| a | b |\n| 1 | 2 |\nx\n| one line |\n"), _text(), F.lit("\n$$ a+b $$\n<table><tr></tr>\n</TABLE>\n## Part\n\\[ c \\]\n"))
    return table(s, d, "documents").select("doc_id", made.alias("t"))


_STRIP = r"regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')"


def _mined_sql(made: str, groups: list[tuple[str, str, str, bool]]) -> str:
    """Regions of each (pattern with one group, category, format, trimmed), numbered across the groups."""

    def of(k: int, pattern: str, category: str, form: str, trimmed: bool) -> str:
        found = f"regexp_extract_all(t, '{pattern}', 1)"
        return f"SELECT doc_id, {k} AS g, '{category}' AS category, '{form}' AS text_format, unnest({found}) AS x, generate_subscripts({found}, 1) AS i, {str(trimmed).lower()} AS trimmed FROM m"

    union = " UNION ALL ".join(of(k, *g) for k, g in enumerate(groups))
    return f"""WITH m AS (SELECT doc_id, {made} AS t FROM documents), u AS ({union})
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, i) - 1 AS place, category, text_format, md5(CASE WHEN trimmed THEN {_STRIP} ELSE x END) AS digest FROM u"""


def _found(rows: DataFrame, regions: Column) -> DataFrame:
    return rows.select("doc_id", F.explode(regions).alias("r")).select("doc_id", F.col("r.order").cast("long").alias("place"), F.col("r.category").alias("category"), F.col("r.text_format").alias("text_format"), F.md5("r.text").alias("digest"))


register(
    "markdown_regions", lambda s, d: _found(_marked(s, d), layouts.markdown_regions(F.col("t"))),
    _mined_sql(
        r"'# Title ' || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || 'x' || chr(10) || '| one line |' || chr(10) || coalesce(text, '') || chr(10) || '$$ a+b $$' || chr(10) || '<table><tr></tr>' || chr(10) || '</TABLE>' || chr(10) || '## Part' || chr(10) || '\[ c \]' || chr(10)",
        [
            (r"(?m)((?:^\|.+\|$\n?){2,})", "table", "markdown", True), (r"(?i)(<table[\s\S]*?</table>)", "table", "html", True), (r"(?s)\$\$(.+?)\$\$", "formula", "latex", True),
            (r"(?s)\\\[(.+?)\\\]", "formula", "latex", True), (r"(?m)^#\s+(.+)$", "title", "markdown", True), (r"(?m)^#{2,6}\s+(.+)$", "section-header", "markdown", True),
        ],
    ),
)


def _tagged(s: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("<img>a view</img>\n"), _text(), F.lit("\n\\( x \\) $$ y $$ \\[z\\]\n<table>\n</table><page_number> 7 </page_number><Watermark>draft</WATERMARK>"))
    return table(s, d, "documents").select("doc_id", made.alias("t"))


register(
    "tagged_regions", lambda s, d: _found(_tagged(s, d), layouts.tagged_regions(F.col("t"))),
    _mined_sql(
        r"'<img>a view</img>' || chr(10) || coalesce(text, '') || chr(10) || '\( x \) $$ y $$ \[z\]' || chr(10) || '<table>' || chr(10) || '</table><page_number> 7 </page_number><Watermark>draft</WATERMARK>'",
        [
            (r"(?i)(<table[\s\S]*?</table>)", "table", "html", False), (r"(?s)\$\$(.+?)\$\$", "formula", "latex", True), (r"(?s)\\\[(.+?)\\\]", "formula", "latex", True), (r"(?s)\\\((.+?)\\\)", "formula", "latex", True),
            ("(?is)<img>(.*?)</img>", "picture", "plain", True), ("(?is)<watermark>(.*?)</watermark>", "page-header", "plain", True), ("(?is)<page_number>(.*?)</page_number>", "page-footer", "plain", True),
        ],
    ),
)
register(
    "tagged_text", lambda s, d: _tagged(s, d).select("doc_id", F.md5(layouts.untagged(F.col("t"))).alias("digest")),
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<img>(.*?)</img>', '\1', 'g'), '(?is)<watermark>(.*?)</watermark>', '\1', 'g'), '(?is)<page_number>(.*?)</page_number>', '\1', 'g')) AS digest
    FROM (SELECT doc_id, '<img>a view</img>' || chr(10) || coalesce(text, '') || chr(10) || '\( x \) $$ y $$ \[z\]' || chr(10) || '<table>' || chr(10) || '</table><page_number> 7 </page_number><Watermark>draft</WATERMARK>' AS t FROM documents)""",
)

# --- HTML


def _html(s: SparkSession, d: str) -> DataFrame:
    """Lines as top-level blocks; boxes that can't be read, blank pages, nested blocks and entities occur."""
    box = F.when(F.col("l_suppkey") % 6 == 0, "1 2 x").otherwise(F.concat_ws(" ", F.col("l_partkey") % 1200, F.lit("10"), F.lit("1500"), F.col("l_suppkey") % 900 + 20))
    label = F.element_at(F.array(*map(F.lit, ("Text", "Table", "Equation-Block", "Image", "Blank-Page", "Page-Footer"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    inner = F.concat(F.lit('<p data-bbox="1 2 3 4">a &amp; '), F.col("l_partkey").cast("string"), F.lit("<br>b</p><table><tr><td>1</td></tr></table><math>x+y</math>"))
    item = F.concat(F.lit('<div data-bbox="'), box, F.lit('" data-label="'), label, F.lit('">'), inner, F.lit("</div>"))
    return _pages(s, d, item, "\n")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    read = _html(s, d).select("page", layouts.html_blocks(F.col("body"), F.lit(800), F.lit(500)).alias("b"))
    made = read.select("page", F.md5(layouts.block_text(F.col("b"))).alias("digest"), F.posexplode(layouts.block_regions(F.col("b"))).alias("place", "r"))
    return made.select("page", "digest", F.col("place").cast("long").alias("place"), F.col("r.category").alias("category"), F.col("r.text_format").alias("text_format"), F.md5("r.text").alias("text"), *(F.col(f"r.bbox.{c}").alias(c) for c in layouts.SIDES))


register(
    "html_blocks", _blocks,
    f"""WITH l AS (SELECT *, {_PLACE} AS k, l_partkey % 6 AS c, 'a &amp; ' || l_partkey || ' b 1 x+y' AS shown, '<p>a &amp; ' || l_partkey || '<br>b</p><table><tr><td>1</td></tr></table><math>x+y</math>' AS inside FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS place, l_suppkey % 6 = 0 AS bad FROM l WHERE c <> 4),
    t AS (SELECT l_orderkey, md5(coalesce(string_agg(shown, chr(10) || chr(10) ORDER BY k) FILTER (c NOT IN (3, 5)), '')) AS digest FROM b GROUP BY 1),
    r AS (SELECT *, CASE WHEN bad THEN 0 ELSE least(trunc((l_partkey % 1200) * 0.8::DOUBLE), 800) END AS x1, CASE WHEN bad THEN 0 ELSE 5 END AS y1, 800 AS x2, CASE WHEN bad THEN 500 ELSE least(trunc((l_suppkey % 900 + 20) * 0.5::DOUBLE), 500) END AS y2 FROM b)
    SELECT l_orderkey AS page, digest, place, CASE c WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' WHEN 3 THEN 'picture' ELSE 'page-footer' END AS category,
      CASE c WHEN 2 THEN 'latex' WHEN 3 THEN 'plain' ELSE 'html' END AS text_format, md5(CASE c WHEN 1 THEN '<table><tr><td>1</td></tr></table>' WHEN 2 THEN 'x+y' WHEN 3 THEN shown ELSE inside END) AS text,
      CASE WHEN x1 < x2 AND y1 < y2 THEN x1::DOUBLE END AS x1, CASE WHEN x1 < x2 AND y1 < y2 THEN y1::DOUBLE END AS y1, CASE WHEN x1 < x2 AND y1 < y2 THEN x2::DOUBLE END AS x2, CASE WHEN x1 < x2 AND y1 < y2 THEN y2::DOUBLE END AS y2
    FROM r JOIN t USING (l_orderkey)""",
)

# --- guards and formatter

register(
    "line_repeat_guard",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.md5(parse.line_guard(F.concat(F.lit("head\n"), F.repeat(F.concat("role", F.lit(" again\n")), F.when(F.col("turn") % 2 == 0, 40).otherwise(7)), F.lit("tail")))).alias("digest")),
    "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'head' || chr(10) || role || ' again' ELSE 'head' || chr(10) || repeat(role || ' again' || chr(10), 7) || 'tail' END) AS digest FROM conversations",
)


def _part_blocks(*rows: tuple[Column, Column, Column]) -> Column:
    """Blocks of (label, content, left edge)."""
    return F.array(*(F.struct(F.lit(k).alias("index"), label.alias("label"), content.alias("content"), left.cast("double").alias("left")) for k, (label, content, left) in enumerate(rows)))


def _shown(name: str, rule, blocks, sql: str) -> None:
    """A part's blocks after a rule: label and content of each, joined."""

    def query(s: SparkSession, d: str) -> DataFrame:
        made = table(s, d, "part").select("p_partkey", rule(blocks()).alias("b"))
        return made.select("p_partkey", F.array_join(F.transform("b", lambda b: F.concat_ws("=", b["index"].cast("string"), b["label"], b["content"])), "|").alias("blocks"))

    register(name, query, sql)


def _name() -> Column:
    return F.col("p_name")


def _odd() -> Column:
    return F.col("p_partkey") % 2 == 1


_L = F.lit
_shown(
    "formula_number_merge", lambda b: formatting.assemble(b),
    lambda: _part_blocks((_L("formula_number"), F.concat(_L("("), F.col("p_partkey").cast("string"), _L(")")), _L(0)), (_L("display_formula"), _L("$$ x $$"), _L(0)), (_L("display_formula"), _L("\\[y\\]"), _L(0)), (_L("formula_number"), F.when(_odd(), "（2.1）").otherwise("3"), _L(0)), (_L("formula_number"), _L("(9)"), _L(0)), (_L("paragraph_title"), _name(), _L(0))),
    r"SELECT p_partkey, '0=display_formula=$$' || chr(10) || 'x \tag{' || p_partkey || '}' || chr(10) || '$$|1=display_formula=$$' || chr(10) || 'y \tag{' || CASE WHEN p_partkey % 2 = 1 THEN '2.1' ELSE '3' END || '}' || chr(10) || '$$|2=paragraph_title=## ' || p_name AS blocks FROM part",
)
_shown(
    "hyphen_merge", lambda b: formatting.merge_words(b),
    lambda: _part_blocks((_L("text"), F.concat(_name(), _L(" exam- ")), _L(0)), (_L("image"), _L(""), _L(0)), (_L("text"), F.when(_odd(), " ple of it").otherwise("Ple of it"), _L(0)), (_L("text"), _L("end-"), _L(0))),
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN '0=text=' || p_name || ' example of it|1=image=|3=text=end-' ELSE '0=text=' || p_name || ' exam- |1=image=|2=text=Ple of it|3=text=end-' END AS blocks FROM part",
)
_shown(
    "bullet_cascade", lambda b: formatting.complete_bullets(b),
    lambda: _part_blocks((_L("text"), _L("- one"), _L(100)), (_L("text"), _name(), _L(105)), (_L("text"), F.when(_odd(), "- three").otherwise("three"), _L(98)), (_L("text"), _L("four"), F.when(F.col("p_partkey") % 3 == 0, 130).otherwise(101)), (_L("text"), _L("- five"), _L(99))),
    "SELECT p_partkey, '0=text=- one|1=text=' || CASE WHEN p_partkey % 2 = 1 THEN '- ' ELSE '' END || p_name || '|2=text=' || CASE WHEN p_partkey % 2 = 1 THEN '- three' ELSE 'three' END || '|3=text=' || CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 <> 0 THEN '- ' ELSE '' END || 'four|4=text=- five' AS blocks FROM part",
)
_shown(
    "format_block", lambda b: F.transform(b, lambda x: x),
    lambda: _formatted_blocks(),
    "SELECT p_partkey, '0=doc_title=# ' || p_name || '|1=text=- ' || p_name || '|2=text=(12) ' || p_name || '|3=text=a) ' || p_name || '|4=inline_formula=$$' || chr(10) || 'z' || chr(10) || '$$|5=text=```' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '```' AS blocks FROM part",
)


def _formatted_blocks() -> Column:
    rows = [
        (_L("doc_title"), F.concat(_L("### "), _name())), (_L("text"), F.concat(_L("·  "), _name())), (_L("text"), F.concat(_L("（12）"), _name())), (_L("text"), F.concat(_L("a）"), _name())),
        (_L("inline_formula"), _L("$$z$$")), (_L("text"), F.concat(_L("```\n"), _name())),
    ]
    return _part_blocks(*((label, formatting.format_block(content, label), _L(0)) for label, content in rows))


register(
    "page_assembly",
    lambda s, d: table(s, d, "part").select("p_partkey", formatting.page_markdown(formatting.assemble(_part_blocks((_L("doc_title"), _name(), _L(0)), (_L("text"), _L("  "), _L(0)), (_L("image"), F.lit(None).cast("string"), _L(0)), (_L("text"), _L("a compu-"), _L(0)), (_L("text"), _L("ter"), _L(0))))).alias("markdown")),
    "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'a computer' AS markdown FROM part",
)
register(
    "pages_markdown",
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit("....."))).alias("p")).select("conv_id", formatting.pages_markdown(F.col("p")).alias("markdown")),
    "SELECT conv_id, string_agg(role || '...', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1",
)
