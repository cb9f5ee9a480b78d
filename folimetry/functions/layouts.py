"""Raw layout output of models as pages of regions: JSON dialects, HTML blocks, tagged text and markdown.

Regions are arrays of struct<text, category, bbox, text_format, order, confidence>; a box is null where there is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folimetry.functions import parse

SIDES = ("x1", "y1", "x2", "y2")
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
REGION = f"struct<text:string,category:string,bbox:{BOX},text_format:string,order:int,confidence:double>"
#: Categories that a page's text leaves out.
FURNITURE = ("picture", "page-header", "page-footer")

# Labels of the models' output and what they are called here.
LABELS_CAPITALISED = {
    "Text": "text", "Title": "title", "Section-header": "section-header", "Caption": "caption", "Footnote": "footnote", "Page-header": "page-header",
    "Page-footer": "page-footer", "List-item": "list-item", "Table": "table", "Formula": "formula", "Picture": "picture",
}
LABELS_SNAKE = {
    "header": "page-header", "title": "title", "text": "text", "figure": "picture", "table": "table", "formula": "formula", "figure_caption": "caption", "table_caption": "caption",
    "formula_caption": "caption", "figure_footnote": "footnote", "table_footnote": "footnote", "page_footnote": "footnote", "footer": "page-footer",
}
LABELS_BLOCK = {
    "caption": "caption", "footnote": "footnote", "equation-block": "formula", "list-group": "list-item", "page-header": "page-header", "page-footer": "page-footer", "image": "picture",
    "section-header": "section-header", "table": "table", "text": "text", "complex-block": "text", "code-block": "code", "form": "text", "table-of-contents": "text", "figure": "picture",
    "chemical-block": "formula", "diagram": "picture", "bibliography": "text",
}
LIST_KEYS = ("elements", "layouts", "layout", "results", "data")


def region(text: Column, category: Column | str, text_format: Column | str = "plain", bbox: Column | None = None, order: Column | int = 0, confidence: Column | float = -1.0) -> Column:
    """A region with defaults for what is unknown."""

    def value(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        text.alias("text"), value(category).alias("category"), (F.lit(None) if bbox is None else bbox).cast(BOX).alias("bbox"),
        value(text_format).alias("text_format"), value(order).cast("int").alias("order"), value(confidence).cast("double").alias("confidence"),
    )


def in_order(regions: Column) -> Column:
    """The same regions numbered from 0."""
    return F.transform(regions, lambda r, i: r.withField("order", i.cast("int")))


def page_text(regions: Column, leave_out: tuple[str, ...] = FURNITURE, joiner: str = "\n\n") -> Column:
    """Texts of a page's regions, without empty ones and those of some categories."""
    kept = F.filter(regions, lambda r: (r["text"] != "") & ~r["category"].isin(*leave_out) if leave_out else r["text"] != "")
    return F.array_join(F.transform(kept, lambda r: r["text"]), joiner)


# --- JSON


def first_json(text: str | None) -> str:
    """From the first bracket of a text, square or curly, to the one that closes it; brackets of the other kind and quotes
    don't count. Without one that closes it, the text. A fence at its ends is taken off before."""
    inner = re.sub(r"^```(json)?", "", (text or "").strip())
    inner = inner.removesuffix("```").strip()
    opening = re.search(r"[\[{]", inner)
    if not opening:
        return inner
    depth, kind = 0, {"[": r"[\[\]]", "{": r"[{}]"}[opening[0]]
    for mark in re.finditer(kind, inner[opening.start() :]):
        depth += 1 if mark[0] == opening[0] else -1
        if not depth:
            return inner[opening.start() : opening.start() + mark.end()]
    return inner


def extract_json(text: Column) -> Column:
    """first_json of each text; null counts as empty."""

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    return extract(text)


def _lookup(names: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), default)


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _read(item: Column, *more: Column) -> Column:
    """An item's parts: numbers of its box (four, or null), its text, and `more`.

    The text is a string, or another value written as one; missing, null and false ones are empty.
    """
    text = let(
        F.try_variant_get(item, "$.text", "variant"),
        lambda v: let(F.try_variant_get(v, "$", "string"), lambda found: F.coalesce(F.when(found.isin("false", "0") & ~_is(v, "STRING"), F.lit("")).otherwise(found), F.lit(""))),
    )
    numbers = let(F.try_variant_get(item, "$.bbox", "array<double>"), lambda many: F.when(F.size(many) >= 4, F.slice(many, 1, 4)))
    return F.struct(numbers.alias("numbers"), text.alias("text"), *more)


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def _capitalised(item: Column, index: Column, width: Column, height: Column) -> Column:
    """Boxes between 0 and 1 are shares of the page; reversed sides are swapped; the category may be called type."""
    raw = F.coalesce(*(F.try_variant_get(item, f"$.{k}", "variant") for k in ("category", "type")))
    confidence = F.coalesce(*(F.try_variant_get(item, f"$.{k}", "double") for k in ("confidence", "score")), F.lit(-1.0))

    def category(v: Column) -> Column:
        name = F.when(v.isNull(), "Text").when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))
        return let(name, lambda n: F.when(n.isNull(), "text").otherwise(_lookup(LABELS_CAPITALISED, n, F.lower(n))))

    def placed(numbers: Column) -> Column:
        scaled = let(F.forall(numbers, lambda v: (v >= 0) & (v <= 1)), lambda share: F.array(*(numbers[i] * F.when(share, size).otherwise(1.0) for i, size in enumerate((width, height, width, height)))))
        return F.when(numbers.isNotNull(), let(scaled, lambda n: _box(*(n[i] for i in range(4)))))

    return let(
        _read(item, let(raw, category).alias("category"), confidence.alias("confidence")),
        lambda x: region(x["text"], x["category"], parse.text_format(x["category"], x["text"]), placed(x["numbers"]), index, x["confidence"]),
    )


def _snake(item: Column, index: Column, width: Column, height: Column) -> Column:
    """Boxes are cut at the page, reversed sides swapped, and those without area dropped; unknown formats are markdown."""
    name = F.lower(F.trim(F.coalesce(F.try_variant_get(item, "$.category", "string"), F.lit("text"))))

    def placed(numbers: Column) -> Column:
        cut = F.array(*(F.least(F.greatest(numbers[i], F.lit(0.0)), size.cast("double")) for i, size in enumerate((width, height, width, height))))
        return F.when(numbers.isNotNull(), let(cut, lambda n: F.when((n[0] != n[2]) & (n[1] != n[3]), _box(*(n[i] for i in range(4))))))

    def form(category: Column) -> Column:
        return F.when(category == "table", "html").when(category == "formula", "latex").when(category == "picture", "plain").otherwise("markdown")

    return let(
        _read(item, let(name, lambda n: _lookup(LABELS_SNAKE, n, n)).alias("category")),
        lambda x: region(x["text"], x["category"], form(x["category"]), placed(x["numbers"]), index),
    )


_DIALECTS: dict[str, Callable[..., Column]] = {"capitalised": _capitalised, "snake": _snake}


def layout_page(json: Column, width: Column, height: Column, dialect: str = "capitalised") -> Column:
    """struct<full_text, regions> of a page's layout JSON.

    `capitalised`: the items are a list, the `layout` of an object, or the object itself. `snake`: a list, the first of
    LIST_KEYS that holds one, or an object that has a box or category. Items that are no objects are left out, though the
    order counts them. Text that isn't JSON is the page's text.
    """
    none = F.array().cast("array<variant>")

    def items(document: Column) -> Column:
        def under(key: str) -> Column:
            return F.try_variant_get(document, f"$.{key}", "array<variant>")

        single = F.array(document)
        if dialect == "capitalised":
            has = F.try_variant_get(document, "$.layout", "variant").isNotNull()
            of_object = F.when(has, F.coalesce(under("layout"), none)).otherwise(single)
        else:
            has = F.coalesce(*(F.try_variant_get(document, f"$.{k}", "variant") for k in ("bbox", "category"))).isNotNull()
            of_object = let(F.coalesce(*map(under, LIST_KEYS)), lambda found: F.when(F.size(found) > 0, found).when(has, single).otherwise(none))
        return let(F.schema_of_variant(document), lambda kind: F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(document, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), of_object), none))

    read = _DIALECTS[dialect]

    def page(document: Column) -> Column:
        regions = F.filter(F.transform(items(document), lambda v, i: F.when(_is(v, "OBJECT"), read(v, i, width, height))), lambda r: r.isNotNull())
        plain = F.struct(F.coalesce(json, F.lit("")).alias("full_text"), F.array().cast(f"array<{REGION}>").alias("regions"))
        return F.when(document.isNull(), plain).otherwise(let(regions, lambda found: F.struct(page_text(found).alias("full_text"), found.alias("regions"))))

    return let(F.try_parse_json(json), page)


def layout_markdown(json: Column, keep: bool = False) -> Column:
    """Non-empty texts of a layout list joined by blank lines, without headers, footers and page footnotes unless kept;
    what isn't a list, or has no such text, comes back as it is."""
    items = F.from_json(json, "array<struct<category:string,text:string>>", {"mode": "PERMISSIVE"})
    left = F.filter(items, lambda x: (F.coalesce(x["text"], F.lit("")) != "") & (F.lit(keep) | ~F.coalesce(x["category"], F.lit("")).isin("header", "footer", "page_footnote")))
    a_list = _is(F.try_parse_json(json), "ARRAY")
    return F.when(a_list & (F.size(left) > 0), F.array_join(F.transform(left, lambda x: x["text"]), "\n\n")).otherwise(json)


# --- plain, tagged and markdown text


def plain_page(text: Column, always: bool = False) -> Column:
    """One region of the trimmed text; an empty text has none unless asked for."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    one = F.array(region(shown, "text"))
    return one if always else F.when(shown != "", one).otherwise(F.array().cast(f"array<{REGION}>"))


def _mined(text: Column, patterns: list[tuple[str, int, str, str, bool]]) -> Column:
    """Regions of each (pattern, group, category, format, trimmed) in turn, each in order of appearance."""

    def found(pattern: str, group: int, category: str, form: str, trimmed: bool) -> Column:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(inner, lambda x: region(F.regexp_replace(x, r"^\s+|\s+$", "") if trimmed else x, category, form))

    return in_order(F.concat(*(found(*p) for p in patterns)))


HTML_TABLE = r"(?i)(<table[\s\S]*?</table>)"
DISPLAY_DOLLARS, DISPLAY_BRACKETS, INLINE_BRACKETS = r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\\((.+?)\\\)"
TAGS = {"img": "picture", "watermark": "page-header", "page_number": "page-footer"}


def tagged_regions(text: Column) -> Column:
    """HTML tables, formulas of three kinds, then images, watermarks and page numbers in tags."""
    formulas = [(p, 1, "formula", "latex", True) for p in (DISPLAY_DOLLARS, DISPLAY_BRACKETS, INLINE_BRACKETS)]
    tags = [(f"(?is)<{tag}>(.*?)</{tag}>", 1, category, "plain", True) for tag, category in TAGS.items()]
    return _mined(text, [(HTML_TABLE, 1, "table", "html", False), *formulas, *tags])


def untagged(text: Column) -> Column:
    """The text with those tags taken off and what they hold left in."""
    for tag in TAGS:
        text = F.regexp_replace(text, f"(?is)<{tag}>(.*?)</{tag}>", "$1")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


PIPE_TABLE = r"(?m)((?:^\|.+\|$\n?){2,})"
HEADER = r"(?m)^(#{1,6})\s+(.+)$"


def markdown_regions(text: Column) -> Column:
    """Pipe tables of two lines or more, HTML tables, display formulas, then headers (# is the title)."""
    first = _mined(text, [
        (PIPE_TABLE, 1, "table", "markdown", True), (HTML_TABLE, 1, "table", "html", True),
        (DISPLAY_DOLLARS, 1, "formula", "latex", True), (DISPLAY_BRACKETS, 1, "formula", "latex", True),
    ])
    headers = F.arrays_zip(F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)).alias("mark"), F.regexp_extract_all(text, F.lit(HEADER), F.lit(2)).alias("title"))
    shown = F.transform(headers, lambda h: region(F.regexp_replace(h["title"], r"^\s+|\s+$", ""), F.when(h["mark"] == "#", "title").otherwise("section-header"), "markdown"))
    return in_order(F.concat(first, shown))


# --- HTML

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    """Top-level div elements with their attributes and inner source, without data-bbox inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.found: list[tuple[dict[str, str | None], list[str]]] = []

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted: nothing asks where an element is."""
        return j

    def _inside(self, source: str) -> None:
        if self.open and self.open[0] == "div":
            self.found[-1][1].append(source)

    def _tag(self, attrs) -> str:
        source = self.get_starttag_text() or ""
        return re.sub(r"""\s+data-bbox\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", source) if any(k == "data-bbox" for k, _ in attrs) else source

    def handle_starttag(self, tag, attrs) -> None:
        if self.open:
            self._inside(self._tag(attrs))
        elif tag == "div":
            self.found.append((dict(attrs), []))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs) -> None:
        if self.open:
            self._inside(self._tag(attrs))
        elif tag == "div":
            self.found.append((dict(attrs), []))

    def handle_endtag(self, tag) -> None:
        if tag in self.open:
            at = len(self.open) - 1 - self.open[::-1].index(tag)
            if at:
                self._inside(f"</{tag}>")
            del self.open[at:]

    def handle_data(self, data) -> None:
        self._inside(data)

    def handle_entityref(self, name) -> None:
        self._inside(f"&{name};")

    def handle_charref(self, name) -> None:
        self._inside(f"&#{name};")

    def handle_comment(self, data) -> None:
        self._inside(f"<!--{data}-->")


def blocks_of(html: str | None, width: int, height: int, scale: int = 1000) -> list[dict]:
    """bbox in pixels, label and content of each top-level div but blank pages. Boxes are four whole numbers out of `scale`,
    cut at the page; any other box is the whole page. A missing label is `block`."""
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    out = []
    for attributes, content in reader.found:
        label = attributes.get("data-label") or "block"
        if label == "Blank-Page":
            continue
        numbers = (attributes.get("data-bbox") or "").split()
        if len(numbers) == 4 and all(re.fullmatch(r"[+-]?\d+", n) for n in numbers):
            box = [max(0, min(int(int(n) * (size / scale)), size)) for n, size in zip(numbers, (width, height, width, height), strict=True)]
        else:
            box = [0, 0, width, height]
        out.append({"bbox": box, "label": label, "content": "".join(content)})
    return out


def html_blocks(html: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """array<struct<bbox, label, content>> of each page's HTML layout."""

    @F.pandas_udf("array<struct<bbox:array<int>,label:string,content:string>>")
    def read(pages: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([blocks_of(p, int(w), int(h), scale) for p, w, h in zip(pages, widths, heights, strict=True)])

    return read(html, width.cast("int"), height.cast("int"))


def block_regions(blocks: Column) -> Column:
    """Regions of HTML blocks: formulas give their math, tables their first table, pictures their text; others keep HTML."""

    def read(b: Column, i: Column) -> Column:
        category = _lookup(LABELS_BLOCK, F.lower(F.trim(b["label"])), F.lit("text"))
        math = F.regexp_extract_all(b["content"], F.lit(r"(?is)<math[^>]*>(.*?)</math>"), F.lit(1))
        formula = F.when(F.size(math) > 0, F.array_join(F.transform(math, lambda m: parse.html_text(m)), "\n")).otherwise(parse.html_text(b["content"]))
        text = (
            F.when(category == "formula", formula).when(category == "table", parse.first_table(b["content"])).when(category == "picture", parse.html_text(b["content"]))
            .otherwise(F.regexp_replace(b["content"], r"^\s+|\s+$", ""))
        )
        form = F.when(category == "formula", "latex").when(category == "picture", "plain").otherwise("html")
        box = F.struct(*(b["bbox"][k].cast("double").alias(s) for k, s in enumerate(SIDES)))
        return region(text, category, form, F.when((b["bbox"][2] > b["bbox"][0]) & (b["bbox"][3] > b["bbox"][1]), box), i)

    return F.transform(blocks, read)


def block_text(blocks: Column) -> Column:
    """Text of a page's HTML blocks, without pictures and page furniture."""
    kept = F.filter(blocks, lambda b: ~_lookup(LABELS_BLOCK, F.lower(F.trim(b["label"])), F.lit("text")).isin(*FURNITURE))
    return F.array_join(F.filter(F.transform(kept, lambda b: parse.html_text(b["content"])), lambda t: t != ""), "\n\n")
