"""Helpers shared by the operators: table access, batch slicing, lineage cuts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from indicata.session import checkpoint_dir, derived_table_dir

#: Characters that one numpy pass holds at a time (a longer text passes alone).
SLICE_CHARS = 1 << 19


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on hosts that share this checkout import the package.

    Elsewhere the package comes with ``--py-files`` or an installed wheel.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(lengths: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` characters, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage gone.

    ``checkpoint()`` keeps the rows where every executor can read them, so a
    lost executor costs only the tasks it was running.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column is called so (case aside)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a folder of its own below the shared one, and read again."""
    path = derived_table_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
