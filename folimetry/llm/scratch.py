"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where the session sets none, a local one on a local master (tests); on a
    cluster that is an error, for executors wouldn't see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.folimetry.scratch", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folimetry-")
        spark.conf.set("spark.folimetry.scratch", base)
    return f"{base.rstrip('/')}/folimetry-{uuid.uuid4().hex}"


#: Rows of a file where a table's size is known beforehand.
FILE_ROWS = 1 << 14


#: Options of written() for rows of some MB each, so that neither writer nor reader holds many at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, folder: str | None = None, rows: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The same rows read back from a Parquet table, so that lineage ends there and a lost executor costs one stage. `rows`
    says how many there are at most, if that is known: a small table isn't made in as many tasks and files as a large one."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, _PATHS.pop(table, None)
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Place of a file among the scan's files, above so many bits for the row's position in it.
FILE_BITS = 40


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of docs is called so in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def by_place(docs: DataFrame, *more: Column) -> DataFrame:
    """Columns c0, c1 and so on for those of docs, and `more`, whose names then can't clash with them."""
    return docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)), *more)


def by_name(rows: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Columns of by_place() under their names again, then `more`."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *more)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """The same rows with a number in the column `row`, which docs must not have. It stays the same in every later read,
    however the scan is split.

    Rows of a Parquet scan, projected or filtered at most, are known by file and position in it. Other rows are written
    once together with their number.
    """
    if not _plain_scan(docs):
        return written(docs.withColumn(row, F.monotonically_increasing_id()))
    spark, place = docs.sparkSession, docs.metadataColumn("_metadata")
    paths = sorted({re.sub("^([a-z0-9]+):/+", r"\1:/", p) for p in docs.inputFiles()})
    path, at, file = (free_name(docs, n) for n in ("__path", "__at", "__file"))
    tagged = docs.withColumns({path: F.regexp_replace(place["file_path"], "^([a-z0-9]+):/+", "$1:/"), at: place["row_index"]})
    files = spark.range(1).select(F.posexplode(F.lit(paths) if paths else F.array(F.lit(""))).alias(file, path))
    known = F.coalesce(file, F.raise_error(F.concat(F.lit("a file the scan didn't list: "), path)).cast("int"))
    number = F.shiftleft(known.cast("long"), FILE_BITS) + F.col(at)
    return tagged.join(F.broadcast(files), path, "left").select(*(F.col(quoted(c)) for c in docs.columns), number.alias(row))


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet scan."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.children().size():
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def without_rows(docs: DataFrame, row: str, dropped: DataFrame, most: int) -> DataFrame:
    """docs whose number `row` isn't among dropped(row_id), without that column; dropped is broadcast up to `most` rows."""
    gone = dropped.select(F.col("row_id").alias(row))
    return docs.join(F.broadcast(gone) if dropped.count() <= most else gone, row, "left_anti").drop(row)


def filesystem(path: str):
    """pyarrow filesystem and inner path of a URI; used by tasks for binary files in the shared folder."""
    from pyarrow import fs

    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_atomically(path: str, chunks) -> int:
    """Write byte chunks under a private name, then rename, so that a repeated task attempt replaces whole files."""
    where, inner = filesystem(path)
    where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    private, size = f"{inner}.{uuid.uuid4().hex}.tmp", 0
    with where.open_output_stream(private, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    where.move(private, inner)
    return size
