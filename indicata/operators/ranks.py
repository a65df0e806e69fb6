"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.functions.expressions import quote
from indicata.session import checkpoint_dir


def with_rank(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank", dense: bool = False) -> DataFrame:
    """``df`` with each row's rank (from 1) by the columns of ``order``, (column, descending).

    Rows equal in all these columns share a rank; the next one is the number of
    rows before it plus one (``dense``: of distinct places before it).  Nulls come
    first, NaN is the largest value.

    Only the distinct places are sorted, each with its number of rows
    (map-side counts, so ties of any size are one row): they are range
    partitioned, each partition is summed up by itself and gets the total of
    those before it.  The driver sees one number per partition.  The places are
    checkpointed, as a second sampling could cut them elsewhere, and meet the
    rows in a null-safe join, which adaptive execution splits where a place is hot.
    """
    columns = [c for c, _ in order]
    rows = F.lit(1) if dense else F.count(F.lit(1))
    checkpoint_dir(df.sparkSession)
    places = (df.groupBy(*[F.col(quote(c)).alias(f"_key{i}") for i, c in enumerate(columns)])
              .agg(rows.cast("long").alias("_rows")))
    keys = [f"_key{i}" for i in range(len(columns))]
    by_key = [F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_first()
              for k, (_, down) in zip(keys, order)]
    placed = (places.repartitionByRange(*by_key).withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    before, offsets = 0, []
    for part, total in placed.groupBy("_part").agg(F.sum("_rows")).orderBy("_part").collect():
        offsets.append((part, before))
        before += total
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _start long"))
    earlier = Window.partitionBy("_part").orderBy(*by_key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (placed.withColumn("_in", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).join(starts, "_part")
              .select(*keys, (F.col("_start") + F.col("_in") + 1).alias("_rank")))
    match = F.lit(True)
    for c, k in zip(columns, keys):
        match = match & df[quote(c)].eqNullSafe(ranked[k])
    return df.join(ranked, match).select(*[df[quote(c)] for c in df.columns], ranked["_rank"].alias(name))
