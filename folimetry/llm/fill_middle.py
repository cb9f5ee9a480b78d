"""Fill-in-middle: texts cut at two places and put together so that a model learns to write what is between.

Each batch of rows is registered with DuckDB, which cuts the texts into units, draws the places from a hash of the
identifier and joins the parts again; no row passes through Python. What a form does to a text is undone by `rebuilt()`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.pieces import by_bytes, trimmed, whole_texts
from folimetry.llm.scratch import by_name, by_place

#: Fixed values of the query's contract: a unit of a text, marks before prefix, suffix and middle, and percentages.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
SALT, CHANGED, SUFFIX_FIRST = "1:", 90, 20
#: Bytes of text that DuckDB has as lists of units at once (or one text that is longer).
SLICE_BYTES = 1 << 20
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"

_CUT = """
WITH cut AS (SELECT i, t, regexp_extract_all(t, $unit) AS u, sha256($salt || coalesce(id, '')) AS h FROM batch),
drawn AS (
  SELECT i, t, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, $p) OR contains(t, $s) OR contains(t, $m) OR ('0x' || h[17:24])::UBIGINT % 100 >= $changed THEN 'plain'
              WHEN ('0x' || h[25:32])::UBIGINT % 100 < $first THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parted AS (
  SELECT i, t, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(x, y)), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') END AS middle,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(x, y) + 1, n), '') END AS suffix
  FROM drawn
)
SELECT n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN t WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM parted ORDER BY i
"""


def checked(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart in any output: none begins inside another or itself."""
    if len(set(marks)) < 3 or not all(marks) or any(b.startswith(a[k:]) or a[k:].startswith(b) for a, b in product(marks, marks) for k in range(1, len(a))):
        raise ValueError("three different marks are needed, of which none begins inside another")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", marks: tuple[str, str, str] = MARKS, unit: str = UNIT, salt: str = SALT,
    changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """The columns of docs by place (c0, c1, ...), then n (units of the text), form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null for plain) and output (the text in that form).

    `unit` must match every text from end to end. `changed` percent of identifiers leave plain, `suffix_first` percent of
    those are spm. Null texts count as empty; empty ones, and those that hold a mark, stay plain. Texts of any length are
    cut whole. Rows that repeat an identifier and a text have equal results; a null identifier is drawn as an empty one.
    Other columns may have any names; an empty table gives an empty result.
    """
    checked(marks)
    rows = by_place(docs, F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    places = rows.columns[:-2]
    given = {"unit": unit, "salt": salt, "changed": changed, "first": suffix_first, "p": marks[0], "s": marks[1], "m": marks[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False}) as db:
            for batch in batches:
                for b in by_bytes(batch, "text", SLICE_BYTES):
                    part = {"i": pa.array(range(b.num_rows), pa.int64()), "id": b.column("id"), "t": whole_texts(b.column("text"))}
                    db.register("batch", pa.table(part))
                    made = db.sql(_CUT, params=given).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in made.columns]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in places), *columns[:-1], columns[-1].cast(pa.string())], [*places, *made.column_names])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-2])
    return rows.mapInArrow(trimmed(run), f"{head}{MADE}")


def rebuilt(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() gave this form. Null gives null."""
    p, s, m = map(F.lit, marks)
    last = F.split_part(output, m, F.lit(2))
    body = F.split_part(output, m, F.lit(1))
    prefix_first = F.concat(F.split_part(F.split_part(body, s, F.lit(1)), p, F.lit(2)), last, F.split_part(body, s, F.lit(2)))
    suffix_first = F.concat(F.split_part(body, p, F.lit(2)), last, F.split_part(F.split_part(body, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).when(form == "psm", prefix_first).otherwise(suffix_first)


def filled_texts(docs: DataFrame) -> DataFrame:
    """fill_in_middle() under the names of docs; a result whose name is taken gets an underscore in front."""
    made = fill_in_middle(docs)
    names, out = list(docs.columns), [f.split()[0] for f in MADE.split(", ")]
    for i, name in enumerate(out):
        while name.lower() in {c.lower() for c in names}:
            name = "_" + name
        made, out[i] = made.withColumnRenamed(out[i], f"made_{i}"), name
        names.append(name)
    return by_name(made, docs.columns, *(F.col(f"made_{i}").alias(n) for i, n in enumerate(out)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        F.col("c0").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: By positions in the text instead of lists of its units: a unit starts where a letter doesn't follow a letter.
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, length(regexp_replace(t, '[A-Za-z]+', 'a', 'g')) AS n FROM t),
d AS (
  SELECT *, least(('0x' || h[1:8])::UBIGINT % (n + 1), ('0x' || h[9:16])::UBIGINT % (n + 1)) AS a, greatest(('0x' || h[1:8])::UBIGINT % (n + 1), ('0x' || h[9:16])::UBIGINT % (n + 1)) AS z,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), e AS (SELECT *, list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes FROM d),
f AS (SELECT *, coalesce(list_sum(sizes[1:a]), 0)::BIGINT AS x, coalesce(list_sum(sizes[1:z]), 0)::BIGINT AS y FROM e),
g AS (SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""
