"""Degradations: parameter grids, and six steps over raw 8-bit pixels."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.operators import raster

# Names of steps that configurations use, each one's parameter and its default.
NOISE, SALT_AND_PEPPER, BLUR, JPEG, ROTATE, DPI = "noise", "salt_and_pepper", "blur", "jpeg", "rotate", "dpi_reduction"
AMOUNTS = {NOISE: "sigma", SALT_AND_PEPPER: "amount", BLUR: "radius", JPEG: "quality", ROTATE: "degrees", DPI: "factor"}
DEFAULT_AMOUNTS = {NOISE: 25.0, SALT_AND_PEPPER: 0.02, BLUR: 2.0, JPEG: 50.0, ROTATE: 5.0, DPI: 0.5}
KNOWN = tuple(AMOUNTS)


def _named(params: dict, between: str) -> str:
    return between.join(f"{k}={v}" for k, v in params.items())


def grid(steps: list[dict], known: tuple[str, ...] = KNOWN) -> list[tuple[str, str, dict]]:
    """(label, step, params) of every combination of list-valued parameters. Labels name what is swept, or all parameters
    in brackets where nothing is. Steps without a known name are left out."""
    out = []
    for step in (s for s in steps if s.get("name") in known):
        name, params = step["name"], step.get("params") or {}
        choices = {k: v if isinstance(v, list) else [v] for k, v in params.items()}
        swept = [k for k, v in params.items() if isinstance(v, list)]
        for values in product(*choices.values()):
            chosen = dict(zip(choices, values, strict=True))
            label = f"{name}_{_named({k: chosen[k] for k in swept}, '_')}" if swept else f"{name}({_named(chosen, '|')})"
            out.append((label, name, chosen))
    return out


def variants(spark: SparkSession, steps: list[dict]) -> DataFrame:
    rows = [(label, name, {k: float(v) for k, v in p.items()}) for label, name, p in grid(steps)]
    return spark.createDataFrame(rows, "label string, name string, params map<string,double>")


STEP_LIST = "array<struct<name:string,params:map<string,string>>>"


def variants_of(table: DataFrame, steps: str = "steps", known: tuple[str, ...] = KNOWN) -> DataFrame:
    """The columns of the table but `steps`, a JSON list of steps, with label, name and params (JSON values as written) of
    each variant: grid() for step lists that are data. Lists that aren't JSON, and steps without a known name, give no rows.
    """
    others = [c for c in table.columns if c != steps]
    step = table.select(*others, F.explode(F.from_json(steps, STEP_LIST)).alias("__s")).filter(F.col("__s.name").isin(*known))
    empty = F.lit("[]").cast("string")

    def choices(value: Column) -> Column:
        listed = F.startswith(value, F.lit("["))
        return F.when(listed, F.transform(F.from_json(F.coalesce(value, empty), "array<string>"), lambda v: v)).otherwise(F.array(value))

    given = F.transform(F.map_entries(F.coalesce("__s.params", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), F.startswith(e["value"], F.lit("[")).alias("swept"), choices(e["value"]).alias("values")))
    start = F.array(F.array().cast("array<struct<key:string,value:string,swept:boolean>>"))
    chosen = F.aggregate(
        given, start, lambda made, e: F.flatten(F.transform(made, lambda m: F.transform(e["values"], lambda v: F.concat(m, F.array(F.struct(e["key"].alias("key"), v.alias("value"), e["swept"].alias("swept"))))))),
    )
    each = step.select(*others, F.col("__s.name").alias("name"), F.explode(chosen).alias("__c"))

    def named(entries: Column, between: str) -> Column:
        return F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"])), between)

    swept = F.filter("__c", lambda x: x["swept"])
    label = F.when(F.size(swept) > 0, F.concat("name", F.lit("_"), named(swept, "_"))).otherwise(F.concat("name", F.lit("("), named(F.col("__c"), "|"), F.lit(")")))
    params = F.map_from_entries(F.transform("__c", lambda x: F.struct(x["key"], x["value"])))
    return each.select(*others, label.alias("label"), "name", params.alias("params"))


def _seed(amount: float) -> int:
    return 42 + int(amount * 1e6)


def gaussian(pixels: np.ndarray, sigma: float, seed: int | None = None) -> np.ndarray:
    rng = np.random.default_rng(_seed(sigma) if seed is None else seed)
    return np.clip(pixels.astype(np.float64) + rng.normal(0, sigma, pixels.shape), 0, 255).astype(np.uint8)


def salt_pepper(pixels: np.ndarray, amount: float, seed: int | None = None) -> np.ndarray:
    """Some pixels black, as many white: all channels of a pixel of (height, width, channels), each value of a flat array."""
    chance = np.random.default_rng(_seed(amount) if seed is None else seed).random(pixels.shape[:2])
    out = pixels.copy()
    out[chance < amount / 2] = 0
    out[chance > 1 - amount / 2] = 255
    return out


def step(pixels: np.ndarray, name: str, amount: float) -> np.ndarray:
    """One step over (height, width, channels) bytes; unknown names leave them as they are."""
    do = {
        NOISE: gaussian, SALT_AND_PEPPER: salt_pepper, BLUR: raster.blurred, JPEG: lambda p, q: raster.recompressed(p, int(q)), ROTATE: raster.rotated, DPI: raster.coarsened,
    }
    return do[name](pixels, amount) if name in do else pixels


def degraded(pixels: Column, name: Column, amount: Column, width: Column | None = None, channels: int = 3) -> Column:
    """Pixels after one step; unknown names, and sizes that aren't whole rows, leave them as they are. With a width, bytes
    are rows of pixels of so many channels; without, they are one row of pixels of one byte."""

    @F.pandas_udf("binary")
    def apply(raw: pd.Series, names: pd.Series, amounts: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for r, n, a, w in zip(raw, names, amounts, widths, strict=True):
            w = 0 if pd.isna(w) else int(w)
            if r is None or len(r) % (w * channels if w else 1) or pd.isna(a):
                out.append(r)
                continue
            flat = np.frombuffer(r, np.uint8)
            out.append(step(flat.reshape(-1, w, channels) if w else flat.reshape(1, -1, 1), n, float(a)).tobytes())
        return pd.Series(out, dtype=object)

    return apply(pixels, name, amount, F.lit(0) if width is None else width.cast("int"))


def sweep(pages: DataFrame, steps: list[dict], pixels: str = "pixels", width: str | None = None) -> DataFrame:
    """Every page under every variant, with its label; the page itself comes first with an empty label. Each page's bytes are
    read once; the variants are a short list in the plan."""
    built = [(label, name, float(p.get(AMOUNTS[name], DEFAULT_AMOUNTS[name]))) for label, name, p in grid(steps)]
    listed = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("name"), F.lit(c).alias("amount")) for a, b, c in [("", "", 0.0), *built]))
    each = pages.withColumn("__v", F.explode(listed))
    made = degraded(F.col(pixels), F.col("__v.name"), F.col("__v.amount"), F.col(width) if width else None)
    return each.withColumns({pixels: made, "degradation_label": F.col("__v.label")}).drop("__v")
