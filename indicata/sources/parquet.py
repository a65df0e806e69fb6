"""Parquet source (S1, S2), row order, load + classify (C1) and the CSV sink and source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from indicata.functions.expressions import income_level

#: The column that ``with_row_order`` adds.
ROW_ORDER = "_row_order"
#: Bits of a row's position in its file; the file's number has the 23 above them.
POSITION_BITS = 40
#: Files up to which their numbers are sent to every task; more are joined.
BROADCAST_FILES = 20_000

#: RFC 4180: quotes are doubled, nothing is trimmed, an empty text is quoted and a null is not.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
#: Rows of one CSV file: a file with line breaks in it cannot be split, so it is what one task reads.
CSV_FILE_ROWS = 100_000
#: What the reader takes an unquoted nothing for; an empty text, which is quoted, is not equal to it.
_NOTHING = "\0\1null\1\0"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lazy Parquet scan; projection and filters reach the file reader."""
    return spark.read.parquet(path)


def classify(df: DataFrame) -> DataFrame:
    """Rename ``country_or_area`` to ``country`` and derive ``income_level``.

    Spark ignores a rename of a missing column, so the name is checked.
    """
    if "country_or_area" not in df.columns:
        raise ValueError("table has no column 'country_or_area'")
    out = df.withColumnRenamed("country_or_area", "country")
    return out.withColumn("income_level", income_level())


def with_row_order(df: DataFrame, name: str = ROW_ORDER) -> DataFrame:
    """``df`` with each row's place in the files read as one long: file by name, then position.

    An ordinary column, so it survives joins, filters and unions that the
    rows' file metadata do not.  ``df`` must read files directly, else an
    AnalysisException tells so.
    """
    here = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_position"))
    # one name for each file: the listing that the driver holds in any case
    files = sorted(r[0] for r in here.select("_file").distinct().collect())
    if len(files) >= 1 << (63 - POSITION_BITS):
        raise ValueError(f"{len(files)} files are more than a row order in one long tells apart")
    if len(files) <= 1:
        return here.withColumn(name, F.col("_position")).drop("_file", "_position")
    numbers = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    if len(files) <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    place = F.shiftleft("_number", POSITION_BITS) + F.col("_position")
    return here.join(numbers, "_file").withColumn(name, place).select(*df.columns, name)


def load_obt(spark: SparkSession, path: str, row_order: bool = False) -> DataFrame:
    """The observation table with ``country`` and ``income_level``.

    ``row_order`` adds the column ``ROW_ORDER``, by which C3 finds first values.
    """
    table = read_parquet(spark, path)
    return classify(with_row_order(table) if row_order else table)


def _move(spark: SparkSession, made: str, path: str, replace: bool) -> None:
    """The finished folder ``made`` takes the place of ``path``."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    old = hadoop.Path(f"{path}-{uuid.uuid4().hex}")
    there = fs.exists(target)
    if there and not (replace and fs.rename(target, old)):
        fs.delete(hadoop.Path(made), True)
        raise FileExistsError(path)
    if not fs.rename(hadoop.Path(made), target):
        if there:
            fs.rename(old, target)
        raise OSError(f"{made} cannot be renamed to {path}")
    if there:
        fs.delete(old, True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", file_rows: int = CSV_FILE_ROWS) -> None:
    """CSV sink with a header row, written by the executors in parallel.

    Texts come back as they were, from ``read_csv`` and from other readers of
    RFC 4180: line breaks, quotes, backslashes and outer blanks are kept,
    and a null is told from an empty text.  The files are written beside
    ``path`` and renamed when all are done, so a reader sees the old folder or
    the new one, never a part.  ``mode`` is ``overwrite`` or ``errorifexists``.
    A task begins a new file after ``file_rows`` rows (fewer suit very long rows).
    """
    if mode not in ("overwrite", "errorifexists"):
        raise ValueError("mode must be 'overwrite' or 'errorifexists'")
    path = path.rstrip("/")
    made = f"{path}-{uuid.uuid4().hex}"
    df.write.options(**_CSV, nullValue="", emptyValue='""', maxRecordsPerFile=file_rows).csv(made)
    _move(df.sparkSession, made, path, mode == "overwrite")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_csv`` has written.  A text may hold line breaks, so each file is one task's."""
    return spark.read.schema(schema).options(**_CSV, nullValue=_NOTHING, emptyValue="", multiLine=True, enforceSchema=False).csv(path)
