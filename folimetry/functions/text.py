"""Text normalisation as columns. Null text counts as empty everywhere."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the full-width forms, of punctuation and of characters that are words of their own.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
PUNCTUATION = (
    r"[!-/:-@\[-`{-~\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}"
    r"\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}\x{FE30}-\x{FE4F}]"
)
CJK = (
    r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}"
    r"\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ff00}-\x{ffef}]"
)
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_ASCII = r"\A[\x00-\x7F]*\z"


@dataclass(frozen=True)
class Normalisation:
    """Steps in the order they are applied; an empty form skips the first."""

    unicode_form: str = "NFKC"
    halfwidth: bool = True
    simplified: bool = False
    replacements: dict[str, str] = field(default_factory=dict)
    lowercase: bool = False
    remove_punctuation: bool = False
    strip: bool = True
    collapse: bool = True


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unicode_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD. Spark has no such function: Python, over Arrow batches; ASCII is returned as it is."""
    if form not in FORMS:
        raise ValueError(f"unknown normal form {form!r}")

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(text)


def to_halfwidth(text: Column) -> Column:
    return F.translate(text, FULL, HALF)


def replace_all(text: Column, replacements: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new)) if old else text
    return text


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def normalise(text: Column, how: Normalisation = Normalisation()) -> Column:
    """All steps; traditional to simplified has no table here and leaves text as it is."""
    out = text_or_empty(text)
    if how.unicode_form:
        out = unicode_form(out, how.unicode_form)
    if how.halfwidth:
        out = to_halfwidth(out)
    out = replace_all(out, how.replacements)
    if how.lowercase:
        out = F.lower(out)
    if how.remove_punctuation:
        out = remove_punctuation(out)
    if how.strip:
        out = strip_space(out)
    return collapse_space(out) if how.collapse else out


def words(text: Column) -> Column:
    """Words of normalised text, each CJK character one of them."""
    spaced = strip_space(collapse_space(F.regexp_replace(text, f"({CJK})", " $1 ")))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def has_cjk(text: Column) -> Column:
    return text_or_empty(text).rlike(CJK)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-.]", "_")


def fixed(value: Column, places: int) -> Column:
    """A number with fixed decimals, as C and Python print it: the double's exact value is rounded, a tie to the even digit.
    The built-in rounds its shortest decimal form instead, and ties up. Null and NaN give null."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([None if x != x else f"{x:.{places}f}" for x in values.tolist()], dtype=object)

    return shown(value.cast("double"))


def fmt(value: Column, places: int, suffix: str = "") -> Column:
    """Fixed decimals with a suffix; null and NaN give N/A."""
    return F.coalesce(F.concat(fixed(value, places), F.lit(suffix)), F.lit("N/A"))


def resolve_device(name: Column, cuda: bool = False) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin("gpu", "cuda"), "cuda" if cuda else "cpu").otherwise(low)
