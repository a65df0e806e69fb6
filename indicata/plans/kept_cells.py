"""Cells (``observation_cells``) of a stored table, kept and brought up to date by its new files.

All parts of a cell add up (counts, sum, extremes), so the cells of a table are
those of its files merged.  They are kept in batches below the shared folder,
each with the list of the files (path, length, time) that it was made of.  A
call lists the table's files, takes the batches whose files are all still
there, aggregates only the files that none of them holds, as one more batch, and
returns the batches merged.  Where nothing changed the table is not read: which
batches make up a listing is remembered under the listing's digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from indicata.plans.stats import STAT_KEYS, observation_cells
from indicata.session import derived_table_dir
from indicata.sources.parquet import classify

#: Batches beyond which they are merged into one.
BATCHES = 8

_FILE = ("path", "length", "modificationTime")
_FILES_SCHEMA = "path string, length long, modificationTime timestamp, batch string"
#: How a column of the cells is merged; all others are keys.
_MERGE = {"n_rows": F.sum, "n_values": F.sum, "total": F.sum, "least": F.min, "most": F.max}


def store_of(spark: SparkSession, path: str, keys=STAT_KEYS) -> str:
    """The folder that holds the batches of the table at ``path``."""
    digest = hashlib.sha1("\n".join(["cells-v1", path.rstrip("/"), *keys]).encode()).hexdigest()[:16]
    return derived_table_dir(spark, f"cells-{digest}")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _batches(spark: SparkSession, store: str) -> list[str]:
    """Names of the complete batches: the list of files is written last."""
    fs, pattern = _fs(spark, f"{store}/*/files/_SUCCESS")
    return sorted(s.getPath().getParent().getParent().getName() for s in fs.globStatus(pattern) or [])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The table's files; their content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(path).select(*_FILE))


def _files(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], _FILES_SCHEMA)
    return spark.read.schema(_FILES_SCHEMA).parquet(*[f"{store}/{b}/files" for b in batches])


def _usable(held: list) -> list[str]:
    """Batches to use, of rows (here, batches, files): none that has a file that is gone,
    no two that share a file, those with most files first."""
    gone = {b for r in held if not r["here"] for b in r["batches"]}
    size: dict[str, int] = {}
    for r in held:
        for b in r["batches"]:
            size[b] = size.get(b, 0) + r["files"]
    taken: list[str] = []
    for b in sorted(size.keys() - gone, key=lambda b: (-size[b], b)):
        if not any(b in r["batches"] and any(t in r["batches"] for t in taken) for r in held):
            taken.append(b)
    return taken


def _write(store: str, cells: DataFrame, files: DataFrame) -> str:
    """A new batch; it counts only once its list of files is complete."""
    name = f"batch-{uuid.uuid4().hex}"
    cells.write.parquet(f"{store}/{name}/cells")
    files.select(*_FILE, F.lit(name).alias("batch")).coalesce(1).write.parquet(f"{store}/{name}/files")
    return name


def _digest(now: DataFrame) -> str:
    """Number of files and the sum of the hashes of (path, length, time)."""
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*_FILE).cast("decimal(38, 0)"))).first()
    return f"{mark[0]}_{mark[1] or 0}"


def _remembered(spark: SparkSession, store: str, digest: str) -> list[str]:
    """The batches that an earlier call found to make up this listing, or none."""
    fs, pattern = _fs(spark, f"{store}/states/{digest}/*/_DONE")
    done = sorted(s.getPath().getParent().toString() for s in fs.globStatus(pattern) or [])
    if not done:
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_fs(spark, done[0])[1])]
    return sorted(n for n in names if n.startswith("batch-"))


def _remember(spark: SparkSession, store: str, digest: str, batches: list[str]) -> None:
    """One folder for each batch, then the mark that they are all there."""
    state = f"{store}/states/{digest}/{uuid.uuid4().hex}"
    for name in [*batches, "_DONE"]:
        fs, folder = _fs(spark, f"{state}/{name}")
        fs.mkdirs(folder)


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of several parts of a table as the cells of all of it (same columns and types)."""
    keys = [c for c in cells.columns if c not in _MERGE]
    return cells.groupBy(*keys).agg(*[
        f(c).cast(cells.schema[c].dataType).alias(c) for c, f in _MERGE.items()])


def _read(spark: SparkSession, path: str, schema: StructType | None, files: list[str]) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    # a file's path is a name here, not a pattern
    names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in files]
    return classify(reader.option("basePath", path).parquet(*names))


def kept_cells(spark: SparkSession, path: str, schema: StructType | None = None, keys=STAT_KEYS) -> DataFrame:
    """``observation_cells(load_obt(spark, path), keys)`` from the kept batches.

    New files are aggregated at call time; of a batch that lost a file (or whose
    file changed) the files that are left are aggregated again.  The driver
    holds the names of new files, as it does in any read of them.  A sum is
    that of the batches' sums, so its last bits may differ from one pass over
    all rows.  A table without files has no cells.
    """
    keys = list(keys)
    store = store_of(spark, path, keys)
    now = _listed(spark, path)
    digest = _digest(now)
    taken = _remembered(spark, store, digest)
    if not taken:
        taken = _updated(spark, store, path, schema, keys, now)
        if not taken:
            empty = spark.read.parquet(path) if schema is None else spark.createDataFrame([], schema)
            return observation_cells(classify(empty), keys)
        _remember(spark, store, digest, taken)
    cells = _cells(spark, store, taken)
    return cells if len(taken) == 1 else merge_cells(cells)


def _updated(spark: SparkSession, store: str, path: str, schema: StructType | None, keys: list[str],
             now: DataFrame) -> list[str]:
    """The batches that make up the files ``now``, after the missing one is written; none if there is no file."""
    have = _batches(spark, store)
    held = (_files(spark, store, have).unionByName(now.withColumn("batch", F.lit(None).cast("string")))
            .groupBy(*_FILE).agg(F.array_sort(F.collect_set("batch")).alias("batches"),
                                 F.bool_or(F.col("batch").isNull()).alias("here")))
    counted = held.groupBy("here", "batches").agg(F.count(F.lit(1)).alias("files")).collect()
    taken = _usable(counted)
    if any(r["here"] and not set(taken) & set(r["batches"]) for r in counted):
        used = F.array(*[F.lit(b) for b in taken]).cast("array<string>")
        new = held.where(F.col("here") & ~F.arrays_overlap("batches", used)).select(*_FILE).collect()
        cells = observation_cells(_read(spark, path, schema, [r["path"] for r in new]), keys)
        taken.append(_write(store, cells, spark.createDataFrame(new, _FILES_SCHEMA.rsplit(",", 1)[0])))
    if len(taken) > BATCHES:
        taken = [_write(store, merge_cells(_cells(spark, store, taken)), _files(spark, store, taken))]
    return taken


def _cells(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{store}/{b}/cells" for b in batches])


def forget_cells(spark: SparkSession, path: str, keys=STAT_KEYS) -> None:
    """Delete the kept cells of the table at ``path``, those of files long gone among them."""
    fs, store = _fs(spark, store_of(spark, path, keys))
    fs.delete(store, True)


__all__ = ["forget_cells", "kept_cells", "merge_cells", "store_of"]
