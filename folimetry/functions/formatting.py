"""From recognised blocks to a page's markdown: block formatting, formula numbers, hyphenated words and list items.

A page is an array of struct<index, label, content, left>, `left` being the box's left edge or null. Rules that look at
neighbours work on a page at a time in Python over Arrow; a page's blocks are bounded by the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folimetry.functions import parse

BLOCK = "struct<index:int,label:string,content:string,left:double>"
LEFT_TOLERANCE = 10.0

# Labels of each class of block.
CLASSES = {
    "image": ("chart", "image"),
    "table": ("table",),
    "formula": ("display_formula", "inline_formula"),
    "text": (
        "abstract", "algorithm", "content", "doc_title", "figure_title", "paragraph_title", "reference_content", "text", "vertical_text", "vision_footnote", "seal", "formula_number",
    ),
}
_CLASS_OF = {label: kind for kind, labels in CLASSES.items() for label in labels}


def label_class(label: Column, classes: dict[str, tuple[str, ...]] = CLASSES) -> Column:
    """The class of a label; labels of none are their own."""
    out = label
    for kind, labels in classes.items():
        out = F.when(label.isin(*labels), kind).otherwise(out)
    return out


# --- one block


def _numbered(s: str) -> str:
    """One space after a leading (1) or a), 1. and the like; full-width brackets become plain ones."""
    if m := re.match(r"[(（](\d+|[A-Za-z])[)）](.*)$", s):
        s = f"({m[1]}) {m[2].lstrip()}"
    if m := re.match(r"(\d+|[A-Za-z])([.)）])(.*)$", s):
        s = f"{m[1]}{m[2].replace('）', ')')} {m[3].lstrip()}"
    return s


def _as_title(s: str) -> str:
    return "# " + re.sub(r"^#+\s*", "", s)


def _as_heading(s: str) -> str:
    bare = s[2:].lstrip() if s.startswith(("- ", "* ")) else s
    return "## " + re.sub(r"^#+\s*", "", bare).lstrip()


def _as_formula(s: str) -> str:
    inner = s[2:].strip() if s.startswith(("$$", "\\[", "\\(")) else s
    inner = inner[:-2].strip() if inner.endswith(("$$", "\\]", "\\)")) else inner
    return f"$$\n{inner}\n$$"


def _as_text(s: str) -> str:
    if s.startswith("```") and not s.endswith("```"):
        s += "\n```"
    if s.startswith(("·", "•", "* ")):
        s = "- " + s[1:].lstrip()
    return re.sub(r"(?<!\n)\n(?!\n)", "\n\n", _numbered(s))


def formatted(content: str | None, label: str) -> str | None:
    """A block's markdown by its label. Whole tables and formulas are only stripped before, other content is cleaned."""
    if content is None:
        return None
    kind = _CLASS_OF.get(label, label)
    edges = {"table": ("<table", "</table>"), "formula": ("$$", "$$")}.get(kind)
    whole = edges is not None and content.startswith(edges[0]) and content.endswith(edges[1])
    out = content.strip() if whole else parse.cleaned(content)
    out = {"doc_title": _as_title, "paragraph_title": _as_heading}.get(label, str)(out)
    return {"formula": _as_formula, "text": _as_text}.get(kind, str)(out)


def format_block(content: Column, label: Column) -> Column:
    """`formatted` of each block; null content stays null."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([formatted(c, x) for c, x in zip(contents, labels, strict=True)], dtype=object)

    return run(content, label)


# --- neighbours


def with_numbers(blocks: list[dict]) -> list[dict]:
    """A formula takes the number that stands before or else after it as its tag, if it ends on a line of its own; number
    blocks go, also those next to no formula. A number before two formulas' border belongs to the one after it only if the
    one before hasn't taken it."""
    out: list[dict] = []
    waiting: str | None = None  # a number that the next block may take
    tagged = False  # whether the last block is a formula that may still take one
    for b in blocks:
        formula = _CLASS_OF.get(b["label"], b["label"]) == "formula"
        if b["label"] == "formula_number":
            number = parse.bare_number(b["content"])
            if tagged:
                out[-1] = _tag(out[-1], number)
                tagged, waiting = False, None
            else:
                waiting = number
            continue
        if formula and waiting is not None:
            b, tagged = _tag(b, waiting), False
        else:
            tagged = formula
        waiting = None
        out.append(b)
    return out


def _tag(block: dict, number: str) -> dict:
    content = block["content"] or ""
    return block | {"content": f"{content[:-3]} \\tag{{{number}}}\n$$"} if content.endswith("\n$$") else block


#: Letters, each hyphen or apostrophe of a kind followed by something else: what passes for a word where no table is at hand.
WORD_SHAPE = re.compile(r"[a-z](?:[a-z]|-(?!-)|'(?!')){2,30}")


def likely_word(token: str) -> bool:
    return WORD_SHAPE.fullmatch(token.strip().lower()) is not None


def with_whole_words(blocks: list[dict], valid: Callable[[str], bool] = likely_word) -> list[dict]:
    """Text that ends in a hyphen takes the next text block, if that begins in lower case and the word across the border is
    valid. The block that it takes is gone; a joined block isn't joined again."""
    gone: set[int] = set()
    out = []
    texts = [k for k, b in enumerate(blocks) if _CLASS_OF.get(b["label"], b["label"]) == "text"]
    following = dict(zip(texts, texts[1:], strict=False))
    for k, b in enumerate(blocks):
        if k in gone:
            continue
        head, after = (b["content"] or "").rstrip(), following.get(k)
        if head.endswith("-") and after is not None:
            tail = (blocks[after]["content"] or "").lstrip()
            before = head[:-1].split()
            if before and tail[:1].islower() and valid(before[-1] + tail.split()[0]):
                gone.add(after)
                b = b | {"content": head[:-1] + tail}
        out.append(b)
    return out


def with_bullets(blocks: list[dict], tolerance: float = LEFT_TOLERANCE) -> list[dict]:
    """Plain text between two list items whose left edges are its own becomes a list item, and counts as one for the next."""
    out = [dict(b) for b in blocks]

    def item(b: dict) -> bool:
        return (b["content"] or "").startswith("- ")

    for before, b, after in zip(out, out[1:], out[2:], strict=False):
        three = (before, b, after)
        if all(x["label"] == "text" and x["left"] is not None for x in three) and item(before) and item(after) and not item(b):
            if all(abs(b["left"] - x["left"]) <= tolerance for x in (before, after)):
                b["content"] = "- " + (b["content"] or "")
    return out


def assembled(blocks: list[dict], numbers: bool = True, words: bool = True, bullets: bool = True) -> list[dict]:
    """A page's blocks by index, formatted, without empty ones (images stay), after the neighbour rules; numbered anew."""
    shown = [b | {"content": formatted(b["content"], b["label"])} for b in sorted(blocks, key=lambda b: b["index"] or 0)]
    shown = [b for b in shown if _CLASS_OF.get(b["label"], b["label"]) == "image" or (b["content"] or "").strip()]
    for wanted, rule in ((numbers, with_numbers), (words, with_whole_words), (bullets, with_bullets)):
        shown = rule(shown) if wanted else shown
    return [b | {"index": k} for k, b in enumerate(shown)]


def _rows(page) -> list[dict]:
    return [] if page is None else [dict(b) for b in page]


def _on_pages(rule: Callable[[list[dict]], list[dict]]) -> Callable[[Column], Column]:
    def column(blocks: Column) -> Column:
        @F.pandas_udf(f"array<{BLOCK}>")
        def run(pages: pd.Series) -> pd.Series:
            return pages.map(lambda page: rule(_rows(page)))

        return run(blocks)

    return column


merge_numbers = _on_pages(with_numbers)
merge_words = _on_pages(with_whole_words)
complete_bullets = _on_pages(with_bullets)
assemble = _on_pages(assembled)


def merge_known_words(blocks: Column, known: Callable[[str], bool]) -> Column:
    """merge_words() where `known` says what a word is: a table of frequencies (operators.frequencies)."""
    return _on_pages(lambda page: with_whole_words(page, known))(blocks)


def page_markdown(blocks: Column) -> Column:
    """Markdown of assembled blocks: their contents joined by blank lines, images left out."""
    kept = F.filter(blocks, lambda b: ~b["label"].isin(*CLASSES["image"]) & (F.coalesce(b["content"], F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda b: b["content"]), "\n\n")


def pages_markdown(contents: Column) -> Column:
    """Several pages of recognised text, cleaned, with rules between."""

    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda pages: "\n\n---\n\n".join(parse.cleaned(p) for p in ([] if pages is None else pages)))

    return run(contents)
