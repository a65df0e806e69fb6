"""The observation table derived from the driver's TPC-H style tables.

One observation per lineitem.  The derivation joins the fact table with
its dimensions in the order that keeps the big side's shuffles to the
minimum: orders join customer on the customer key, lineitem joins orders on
the order key, then part on the part key, all with the keys and codes alone.
Nation and region (both fixed-size by the TPC-H specification: 25 and 5 rows,
so broadcasting them is bounded) come after the last shuffle, and the text
columns are derived last.  AQE may still turn the customer or part join into a
broadcast at run time when their measured size is below the threshold;
otherwise they stay sort-merge joins.

``obt_table`` writes the result once into the shared checkpoint folder
(the observation table is a stored Parquet table in the original
workflow) and every later query scans that table, so filters and column
pruning reach the Parquet reader instead of re-running five joins.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from indicata.session import derived_table_dir, session_settings
from indicata.sources.parquet import classify

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")

# Columns of the observation table, in stored order.
OBT_COLUMNS = (
    "iso3", "country_or_area", "year", "indicator_code", "indicator_label",
    "value", "value_meta", "source", "database", "collection", "region_name",
    "sub_region_name", "high_income", "upper_middle_income",
    "lower_middle_income", "low_income", "intermediate_region_name",
    "least_developed_countries_ldc", "land_locked_developing_countries_lldc",
    "small_island_developing_states_sids", "oecd_member",
    "fragile_and_conflict_affected_situations",
)
# Row order of the observations (unique per row); "first" pivots use it.
ORDER_COLUMNS = ("ord_orderkey", "ord_linenumber", "ord_partkey",
                 "ord_suppkey", "ord_shipdate", "ord_price")

SEQ_COLUMN = "ord_seq"

_VERSION = "obt-v6"

#: Bytes of lineitem files for each piece that the build's shuffles begin with; about ten times that in memory.
BYTES_A_PIECE = 2 << 20
#: Shuffled bytes that a task of the build takes, about five times that in memory.
PIECE_ADVISED = "16MB"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region: at most the specification's 25 rows."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _facts(spark: SparkSession, sf_dir: str, with_seq: bool) -> DataFrame:
    """The joined rows, as narrow as they can be: what ``_observations`` derives from is all they hold."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    if with_seq:
        # ``ord_seq``: one long that follows the row order, so "first value
        # in row order" is a hash aggregate on a long instead of a struct
        # comparison.  Every order column comes from lineitem, so the global
        # range sort runs on this narrow scan before the joins (its sampling
        # pass re-reads only these columns).  The ids grow with the
        # partition index and the position inside it, so they keep the sort
        # order; a retried task sees the same sorted partition and gives the
        # same ids.
        li = (li.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_shipdate", "l_extendedprice")
                .withColumn(SEQ_COLUMN, F.monotonically_increasing_id()))
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("o_year"), "o_orderpriority")
    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")

    ord_c = orders.join(cust, orders.o_custkey == cust.c_custkey).drop("o_custkey", "c_custkey")
    facts = li.join(ord_c, li.l_orderkey == ord_c.o_orderkey).drop("o_orderkey")
    return facts.join(part, facts.l_partkey == part.p_partkey).drop("p_partkey")


def _located(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    geo = _geo(spark, sf_dir)
    return facts.join(F.broadcast(geo), facts.c_nationkey == geo.n_nationkey).drop("c_nationkey")


def _observations(rows: DataFrame, with_seq: bool) -> DataFrame:
    """Facts with their nation as observations."""
    nk = F.col("n_nationkey")
    tier = F.floor(nk / 5)
    brand_no = F.expr("substr(p_brand, 7)")
    value_null = ((F.col("p_brand") == "Brand#25") | (F.col("l_discount") == 0)
                  | ((tier + nk % 5 + brand_no.cast("int")) % 3 == 0)
                  # one label has values in the null sub-region alone
                  | ((F.col("p_brand") == "Brand#12") & (nk != 23)))
    return rows.select(
        F.concat(F.lit("N"), F.lpad(nk.cast("string"), 2, "0")).alias("iso3"),
        F.when(nk == 24, F.lit(None)).otherwise(F.col("n_name")).alias("country_or_area"),
        F.col("o_year").alias("year"),
        F.when(F.col("p_brand") == "Brand#24", F.lit(None))
         .otherwise(F.concat(F.lit("IND."), F.col("p_type"), F.lit("."), brand_no))
         .alias("indicator_code"),
        F.col("p_brand").alias("indicator_label"),
        F.when(value_null, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("value"),
        F.when(F.col("l_discount") == 0, F.lit("missing")).alias("value_meta"),
        F.col("c_mktsegment").alias("source"),
        F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("l_linestatus")).alias("database"),
        F.col("o_orderpriority").alias("collection"),
        F.col("r_name").alias("region_name"),
        F.when(nk == 23, F.lit(None))
         .otherwise(F.concat(F.col("r_name"),
                             F.when(nk < 13, F.lit(" NORTH")).otherwise(F.lit(" SOUTH"))))
         .alias("sub_region_name"),
        F.when(tier == 0, F.lit("High income")).alias("high_income"),
        F.when(tier == 1, F.lit("Upper middle income")).alias("upper_middle_income"),
        F.when(tier == 2, F.lit("Lower middle income")).alias("lower_middle_income"),
        F.when(tier == 3, F.lit("Low income")).alias("low_income"),
        F.when(nk % 4 != 0, F.concat_ws(" ", "r_name", (nk % 4).cast("string"))).alias("intermediate_region_name"),
        F.when(nk % 5 == 0, F.lit("LDC")).alias("least_developed_countries_ldc"),
        F.when(nk % 6 == 0, F.lit("LLDC")).alias("land_locked_developing_countries_lldc"),
        F.when(nk % 7 == 0, F.lit("SIDS")).alias("small_island_developing_states_sids"),
        F.when(nk < 12, F.lit("member")).otherwise(F.lit("other")).alias("oecd_member"),
        F.when(nk % 8 == 3, F.lit("fragile")).alias("fragile_and_conflict_affected_situations"),
        F.col("l_orderkey").alias("ord_orderkey"),
        F.col("l_linenumber").alias("ord_linenumber"),
        F.col("l_partkey").alias("ord_partkey"),
        F.col("l_suppkey").alias("ord_suppkey"),
        F.col("l_shipdate").alias("ord_shipdate"),
        F.col("l_extendedprice").alias("ord_price"),
        *([F.col(SEQ_COLUMN)] if with_seq else []),
    )


def mapped_obt(spark: SparkSession, sf_dir: str, with_seq: bool = False) -> DataFrame:
    """Lazy observation table (columns ``OBT_COLUMNS + ORDER_COLUMNS``, and
    ``ord_seq`` when ``with_seq``)."""
    return _observations(_located(spark, sf_dir, _facts(spark, sf_dir, with_seq)), with_seq)


def _signature(spark: SparkSession, sf_dir: str) -> str:
    """Short digest of name, size and time of every input file.

    Spark lists the files (their content is not read), so any store that
    Spark reads will do and a table may be a folder of files.
    """
    files = None
    for t in TABLES:
        one = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(os.path.join(sf_dir, f"{t}.parquet")).select("path", "length", "modificationTime"))
        files = one if files is None else files.union(one)
    mark = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38, 0)"))).first()
    return hashlib.sha1(f"{_VERSION} {sf_dir} {tuple(mark)}".encode()).hexdigest()[:16]


_MATERIALIZED: dict[tuple, str] = {}


def _build_settings(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Shuffles of the build cut by the size of lineitem, so that a task's sort stays in memory at any size."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(os.path.join(sf_dir, "lineitem.parquet")))
    size = files.agg(F.sum("length")).first()[0] or 0
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PIECE))
    return {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(pieces),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": PIECE_ADVISED}


def dealt_obt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mapped_obt`` dealt and sorted as ``write_obt`` wants it, the narrow facts before anything is derived."""
    dealt = _facts(spark, sf_dir, True).hint("rebalance", "c_mktsegment", "o_orderpriority")
    rows = _located(spark, sf_dir, dealt).sortWithinPartitions("c_mktsegment", "o_orderpriority", "p_brand")
    return _observations(rows, True)


def write_obt(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Derive the observation table from ``sf_dir`` and write it to ``path``.

    Partitioned by ``source`` and ``collection`` (a handful of values each;
    filters by source and selections of collections are the most common first
    steps, and a folder for each lets the reader skip the others without opening
    their files).  The rebalance hint deals the rows by both in pieces of the
    advisory size, so a folder gets as many files as its data needs, a hot
    source more of them.  Inside each write task rows are clustered by
    (source, collection, indicator_label), so row-group statistics skip data
    for the other filters.  Facts are dealt and sorted; nations are named after the
    deal and the other columns derived after the sort, on the way to the file.
    """
    with session_settings(spark, _build_settings(spark, sf_dir)):
        (dealt_obt(spark, sf_dir)
         .write.mode("errorifexists").partitionBy("source", "collection").parquet(path))


def _publish(spark: SparkSession, made: str, path: str) -> None:
    """Rename the finished folder ``made`` to ``path``, unless someone else was first."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    conf = sc._jsc.hadoopConfiguration()
    target = fs.Path(path)
    files = fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    try:
        files.rename(fs.Path(made), target, sc._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError:
        if not _written(spark, path):
            raise
        files.delete(fs.Path(made), True)


def obt_path(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """Write the observation table once (per input signature) and return its path.

    ``path`` names an already written copy to use instead (the benchmark
    times a fresh build that way).
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if path is not None:
        _MATERIALIZED[key] = path
        return path
    if key in _MATERIALIZED:
        return _MATERIALIZED[key]
    path = derived_table_dir(spark, f"obt-{_signature(spark, sf_dir)}")
    if not _written(spark, path):
        made = f"{path}-{uuid.uuid4().hex}"
        write_obt(spark, sf_dir, made)
        _publish(spark, made, path)
    _MATERIALIZED[key] = path
    return path


def _written(spark: SparkSession, path: str) -> bool:
    """True when a complete table (with its ``_SUCCESS`` marker) exists."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


_FRAMES: dict[tuple, DataFrame] = {}


_SCHEMAS: dict[tuple, StructType] = {}


def obt_schema(spark: SparkSession, sf_dir: str) -> StructType:
    """Schema of the stored table, in derivation order (analysis only, once per session and input)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = mapped_obt(spark, sf_dir, with_seq=True).schema
    return _SCHEMAS[key]


def obt_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored observation table (before classification).

    Read with the derivation's schema: column order is kept and the
    folder names (``source``, ``collection``) stay strings (no type guessing from values).
    """
    schema = obt_schema(spark, sf_dir)
    df = spark.read.schema(schema).parquet(obt_path(spark, sf_dir))
    return df.select(*schema.fieldNames())   # the folder columns back in place


def obt(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    """C1 over the stored table: ``country`` renamed, ``income_level`` added.

    The lazy frame is kept per session and input, so the file listing and
    footer read happen once; no data is cached.
    """
    key = (spark.sparkContext.applicationId, sf_dir, with_order)
    df = _FRAMES.get(key)
    if df is None:
        df = classify(obt_raw(spark, sf_dir))
        if not with_order:
            df = df.drop(*ORDER_COLUMNS, SEQ_COLUMN)
        _FRAMES[key] = df
    return df


# DuckDB text of the same derivation, used by the oracle queries.
MAPPING_SQL = """
select
 'N' || lpad(cast(n_nationkey as varchar), 2, '0') as iso3,
 case when n_nationkey = 24 then null else n_name end as country,
 cast(year(o_orderdate) as int) as year,
 case when p_brand = 'Brand#24' then null
      else 'IND.' || p_type || '.' || substr(p_brand, 7) end as indicator_code,
 p_brand as indicator_label,
 case when p_brand = 'Brand#25' or l_discount = 0
        or (n_nationkey // 5 + n_nationkey % 5 + cast(substr(p_brand, 7) as int)) % 3 = 0
        or (p_brand = 'Brand#12' and n_nationkey <> 23)
      then null else l_extendedprice end as value,
 case when l_discount = 0 then 'missing' end as value_meta,
 c_mktsegment as source,
 c_mktsegment || '/' || l_linestatus as database,
 o_orderpriority as collection,
 r_name as region_name,
 case when n_nationkey = 23 then null
      else r_name || case when n_nationkey < 13 then ' NORTH' else ' SOUTH' end
 end as sub_region_name,
 case when n_nationkey // 5 = 0 then 'High income' end as high_income,
 case when n_nationkey // 5 = 1 then 'Upper middle income' end as upper_middle_income,
 case when n_nationkey // 5 = 2 then 'Lower middle income' end as lower_middle_income,
 case when n_nationkey // 5 = 3 then 'Low income' end as low_income,
 case when n_nationkey % 4 <> 0 then r_name || ' ' || cast(n_nationkey % 4 as varchar) end
   as intermediate_region_name,
 case when n_nationkey % 5 = 0 then 'LDC' end as least_developed_countries_ldc,
 case when n_nationkey % 6 = 0 then 'LLDC' end as land_locked_developing_countries_lldc,
 case when n_nationkey % 7 = 0 then 'SIDS' end as small_island_developing_states_sids,
 case when n_nationkey < 12 then 'member' else 'other' end as oecd_member,
 case when n_nationkey % 8 = 3 then 'fragile' end as fragile_and_conflict_affected_situations,
 l_orderkey as ord_orderkey, l_linenumber as ord_linenumber, l_partkey as ord_partkey,
 l_suppkey as ord_suppkey, l_shipdate as ord_shipdate, l_extendedprice as ord_price
from lineitem
join orders   on l_orderkey  = o_orderkey
join customer on o_custkey   = c_custkey
join nation   on c_nationkey = n_nationkey
join region   on n_regionkey = r_regionkey
join part     on l_partkey   = p_partkey
"""

# The classified table (C1) as a DuckDB expression over MAPPING_SQL.
CLASSIFIED_SQL = f"""
select *,
 case when high_income = 'High income' then 'High Income'
      when upper_middle_income = 'Upper middle income' then 'Upper Middle Income'
      when lower_middle_income = 'Lower middle income' then 'Lower Middle Income'
      when low_income = 'Low income' then 'Low Income'
      else null end as income_level
from ({MAPPING_SQL}) m
"""


def with_obt(sql_body: str) -> str:
    """Prefix an oracle query with the classified table as CTE ``obt``."""
    return f"with obt as ({CLASSIFIED_SQL})\n{sql_body}"
