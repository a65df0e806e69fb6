"""Registered queries over the observation table and their DuckDB oracles.

Every query reads the driver's tables through the derived observation
table (``sources.tpch``) and runs over all of it.  Double columns are
rounded to 6 places in both the Spark result and the oracle, because the
order of floating-point summation differs between engines.  Means get
``OFF_TIE`` added before that, on both sides: of values with two decimals many
lie on a tie of the sixth place, where the last bit of a sum would decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from indicata.functions.expressions import quote
from indicata.plans import datamap as dm
from indicata.plans import metrics
from indicata.profile import DEFAULT_PROFILE, OBSERVATIONS, ColumnProfile
from indicata.session import delete_at_exit, derived_table_dir
from indicata.sources.parquet import ROW_ORDER, read_csv, write_csv
from indicata.sources.tpch import OBT_COLUMNS, obt, obt_path, obt_raw, obt_schema, with_obt

PROFILE_SOURCE = ("source", "database", "collection")
PROFILE_INDICATOR = ("indicator_code", "value_meta")
OBT_OUT = tuple("country" if c == "country_or_area" else c for c in OBT_COLUMNS) + ("income_level",)


OFF_TIE = "3e-9"
#: Columns made of means, by query; None is every double column.
MEANS = {"base_stats": ("mean_value",), "indicators_metadata": ("mean_value",), "describe_polars": ("mean",),
         "describe_wide": None, "src_tbl_mean": None, "src_tbl_source": None}


def _off_tie(query: str, column: str) -> str:
    means = MEANS.get(query, ())
    return f" + {OFF_TIE}" if means is None or column in means else ""


def round_doubles(df: DataFrame, query: str = "", places: int = 6) -> DataFrame:
    # one selectExpr call: wide pivots have hundreds of columns, and building
    # one Column object per column costs a driver round trip each
    exprs = []
    for f in df.schema.fields:
        q = quote(f.name)
        exprs.append(f"round({q}{_off_tie(query, f.name)}, {places}) AS {q}"
                     if isinstance(f.dataType, (DoubleType, FloatType)) else q)
    return df.selectExpr(*exprs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir), name)
        if sql is not None:
            ORACLE[name] = with_obt(sql)
        return fn
    return deco


# ---------------------------------------------------------------- C1
@register("scan_classify", f"select {', '.join(OBT_OUT)} from obt")
def q_scan_classify(spark, sf_dir):
    return obt(spark, sf_dir).select(*OBT_OUT)


# ---------------------------------------------------------------- C2
@register("datamap_source", """
select source, database, collection, count(*) as count
from obt group by all""")
def q_datamap_source(spark, sf_dir):
    return dm.datamap(obt(spark, sf_dir), PROFILE_SOURCE)


@register("datamap_indicator", """
select source, database, collection, indicator_code, value_meta, count(*) as count
from obt group by all""")
def q_datamap_indicator(spark, sf_dir):
    return dm.datamap(obt(spark, sf_dir), PROFILE_SOURCE, PROFILE_INDICATOR)


# ---------------------------------------------------------------- C15
@register("dt_map_code", """
select source, database, collection, indicator_code, count(*) as count
from obt
where source is not null and database is not null and collection is not null
  and indicator_code is not null
group by all""")
def q_dt_map_code(spark, sf_dir):
    return dm.dt_map(obt(spark, sf_dir), code=True)


@register("dt_map_source", """
select source, database, collection, count(*) as count
from obt
where source is not null and database is not null and collection is not null
group by all""")
def q_dt_map_source(spark, sf_dir):
    return dm.dt_map(obt(spark, sf_dir), code=False)


# ---------------------------------------------------------------- S3
def _profiled(spark: SparkSession, sf_dir: str) -> tuple[ColumnProfile, DataFrame]:
    """The stored table, checked, named and classified by the YAML profile."""
    profile = ColumnProfile.from_yaml(OBSERVATIONS)
    return profile, profile.apply(obt_raw(spark, sf_dir))


@register("profile_datamap", """
select source, database, collection, indicator_code, value_meta, count(*) as count from obt group by all""")
def q_profile_datamap(spark, sf_dir):
    profile, table = _profiled(spark, sf_dir)
    return dm.datamap(table, profile.source_metadata_columns, profile.indicator_metadata_columns)


@register("profile_dt_map", """
select source, database, collection, indicator_code, count(*) as count from obt
where source is not null and database is not null and collection is not null and indicator_code is not null
group by all""")
def q_profile_dt_map(spark, sf_dir):
    profile, table = _profiled(spark, sf_dir)
    return dm.dt_map(table, code=True, profile=profile)


# ---------------------------------------------------------------- C4-C7, C18
from indicata.plans import coverage as cov  # noqa: E402
from indicata.plans import metadata as meta  # noqa: E402
from indicata.plans import stats as st  # noqa: E402
from indicata.plans.kept_cells import kept_cells  # noqa: E402


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept cells of the stored table: made once, then read by C4 to C7."""
    return kept_cells(spark, obt_path(spark, sf_dir), obt_schema(spark, sf_dir))


# The sub-regions the derived table produces (TPC-H region
# names, each split into a NORTH and a SOUTH half), in sorted order.
SUB_REGIONS = tuple(f"{r} {h}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
                    for h in ("NORTH", "SOUTH"))

_NUNIQ = "count(distinct {c}) + coalesce(max(case when {c} is null then 1 else 0 end), 0)"
_NUNIQ_WHERE = ("count(distinct case when {w} then {c} end)"
                " + coalesce(max(case when ({w}) and {c} is null then 1 else 0 end), 0)")

_BASE_STATS_SQL = f"""
, g as (
  select source, collection, indicator_label,
    count(*) as count_rows,
    count(*) filter (where value is null) as count_missing_value,
    {_NUNIQ.format(c="country")} as num_countries_with_data,
    {_NUNIQ_WHERE.format(c="year", w="value is not null")} as num_years_with_data,
    avg(value) as mean_value, min(value) as min_value, max(value) as max_value,
    min(case when value is not null then year end) as min_year,
    max(case when value is not null then year end) as max_year
  from obt group by all)
, r as (
  select source, collection, indicator_label, value,
    row_number() over (partition by source, collection, indicator_label order by value) - 1 as rk,
    count(*) over (partition by source, collection, indicator_label) as n
  from obt where value is not null)
, q as (
  select source, collection, indicator_label,
    (max(case when rk = (n - 1) // 2 then value end)
     + max(case when rk = n // 2 then value end)) / 2 as median_value,
    max(case when rk = floor((n - 1) * 0.75 + 0.5) then value end)
     - max(case when rk = floor((n - 1) * 0.25 + 0.5) then value end) as iqr_value
  from r group by all)
, base as (
  select g.source, g.collection, g.indicator_label, count_rows, count_missing_value,
    num_countries_with_data, num_years_with_data, mean_value, median_value,
    min_value, max_value, iqr_value, min_year, max_year,
    count_missing_value / count_rows * 100 as pct_missing_value
  from g left join q
    on g.source is not distinct from q.source
   and g.collection is not distinct from q.collection
   and g.indicator_label is not distinct from q.indicator_label)
"""

_COVERAGE_SQL = f"""
, info as (
  select sub_region_name, count(*) as total_countries, list(country order by country) as countries
  from (select distinct country, sub_region_name from obt
        where country is not null and sub_region_name is not null)
  group by all)
, cov_long as (
  select c.indicator_label, c.sub_region_name,
    round_even(c.k / i.total_countries * 100, 3) as pct
  from (select indicator_label, sub_region_name, {_NUNIQ.format(c="country")} as k
        from obt where value is not null group by all) c
  left join info i on c.sub_region_name = i.sub_region_name)
, cov_wide as (
  select indicator_label,
  {", ".join(f"coalesce(max(pct) filter (where sub_region_name = '{r}'), 0) as pct_coverage_{r.replace(' ', '_')}" for r in SUB_REGIONS)}
  from cov_long group by all)
"""

_PCT_COLS = [f"pct_coverage_{r.replace(' ', '_')}" for r in SUB_REGIONS]


def _color_sql(c: str) -> str:
    p = f"least(greatest({c}, 0.0), 100.0)"
    return (f"case when {c} is null then null when {p} <= 50 then "
            f"'rgb(255, ' || cast(trunc(195.0 * ({p} / 50)) as int) || ', 0)' else "
            f"'rgb(' || cast(trunc(255.0 * (1 - ({p} - 50) / 50)) as int) || ', ' || "
            f"cast(trunc(195.0 + 60 * (({p} - 50) / 50)) as int) || ', 0)' end")


@register("sub_region_info", """
select sub_region_name, count(*) as total_countries, list(country order by country) as countries
from (select distinct country, sub_region_name from obt
      where country is not null and sub_region_name is not null)
group by all""")
def q_sub_region_info(spark, sf_dir):
    return cov.sub_region_info(_cells(spark, sf_dir))


@register("base_stats", _BASE_STATS_SQL + "select * from base")
def q_base_stats(spark, sf_dir):
    return st.base_stats(obt(spark, sf_dir), cells=_cells(spark, sf_dir))


@register("sub_region_coverage", _COVERAGE_SQL + "select * from cov_wide")
def q_sub_region_coverage(spark, sf_dir):
    return cov.sub_region_coverage(obt(spark, sf_dir), cells=_cells(spark, sf_dir))


@register("coverage_color", _COVERAGE_SQL + "select *, "
          + ", ".join(f"{_color_sql(c)} as color_{c[len('pct_coverage_'):]}" for c in _PCT_COLS)
          + " from cov_wide")
def q_coverage_color(spark, sf_dir):
    return cov.coverage_colors(cov.sub_region_coverage(obt(spark, sf_dir), cells=_cells(spark, sf_dir)))


_GEO = "(" + " + ".join(f"w.{c}" for c in _PCT_COLS) + f") / {len(_PCT_COLS)}"


@register("indicators_metadata", _BASE_STATS_SQL + _COVERAGE_SQL + f"""
select b.*, {", ".join("w." + c for c in _PCT_COLS)},
  (coalesce(b.num_years_with_data / (b.max_year - b.min_year + 1) * 100, 0) + {_GEO}) / 2
    as completeness_score
from base b left join cov_wide w on b.indicator_label = w.indicator_label""")
def q_indicators_metadata(spark, sf_dir):
    return meta.indicators_metadata(obt(spark, sf_dir), cells=_cells(spark, sf_dir))


# ---------------------------------------------------------------- C3, C14, C16, C17
from indicata.plans import checks as ck  # noqa: E402
from indicata.plans import pivot as pv  # noqa: E402
from indicata.sources.tpch import ORDER_COLUMNS, SEQ_COLUMN  # noqa: E402

INDEX_COLS = ("iso3", "country", "year", "indicator_label", "value")
_ORDER_SQL = ", ".join(ORDER_COLUMNS)


# Indicators of the derived table: one label per TPC-H style brand, one code
# per part type and brand.  Mean pivots lack what never has a value.
NO_CODE, NO_VALUE = 24, 25
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
LABELS = sorted(f"Brand#{n}" for n in range(1, 26))
CODES = sorted(f"IND.{t}.{n}" for t in PART_TYPES for n in range(1, 26) if n != NO_CODE)
MEAN_LABELS = [x for x in LABELS if x != f"Brand#{NO_VALUE}"]
MEAN_CODES = [x for x in CODES if not x.endswith(f".{NO_VALUE}")]


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _first_pivot_sql(ind_col: str, where: str = "true") -> str:
    return f"""
, cells as (
  select country, year, coalesce({ind_col}, 'null') as k,
    first(value order by {_ORDER_SQL}) as v
  from obt where {where} group by all)
select * from (pivot cells on k in ({_names(LABELS if ind_col == "indicator_label" else [*CODES, "null"])})
               using first(v) group by country, year)"""


def _first_pivot(spark, sf_dir, ind, cond=None):
    df = obt(spark, sf_dir, with_order=True)
    if cond is not None:
        df = df.where(cond)
    # labels are discovered; small inputs lack some codes, so those are named
    return pv.filter_pivot(df, INDEX_COLS, ind=ind, order_cols=[SEQ_COLUMN],
                           values=[None, *CODES] if ind == "code" else None)


@register("pivot_label", _first_pivot_sql("indicator_label"))
def q_pivot_label(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "label")


@register("pivot_code", _first_pivot_sql("indicator_code"))
def q_pivot_code(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "code")


# Filter values of the chained-filter pivots: one source, a source and a
# year, a source and a region, one country (values of the derived table).
@register("pivot_source", _first_pivot_sql("indicator_label", "source = 'MACHINERY'"))
def q_pivot_source(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "label", F.col("source") == "MACHINERY")


@register("pivot_source_year", _first_pivot_sql("indicator_label", "source = 'BUILDING' and year = 1997"))
def q_pivot_source_year(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "label", (F.col("source") == "BUILDING") & (F.col("year") == 1997))


@register("pivot_region", _first_pivot_sql("indicator_code", "source = 'AUTOMOBILE' and region_name = 'AFRICA'"))
def q_pivot_region(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "code",
                        (F.col("source") == "AUTOMOBILE") & (F.col("region_name") == "AFRICA"))


@register("pivot_country", _first_pivot_sql("indicator_code", "country = 'NATION_7'"))
def q_pivot_country(spark, sf_dir):
    return _first_pivot(spark, sf_dir, "code", F.col("country") == "NATION_7")


# The datamap rows a user picked: one source, two collections.
_PICK_SQL = "source = 'HOUSEHOLD' and collection in ('1-URGENT', '5-LOW')"


_SELECTED_SQL = _first_pivot_sql(
    "indicator_label",
    "collection in (select collection from (select source, database, collection, count(*) as count "
    f"from obt group by all) d where {_PICK_SQL})")


@register("pivot_selected", _SELECTED_SQL)
def q_pivot_selected(spark, sf_dir):
    df = obt(spark, sf_dir, with_order=True)
    picked = dm.datamap(df, PROFILE_SOURCE).where(
        (F.col("source") == "HOUSEHOLD") & F.col("collection").isin("1-URGENT", "5-LOW"))
    return pv.filter_pivot(pv.select_collections(picked, df, folders=True), INDEX_COLS, ind="label",
                           order_cols=[SEQ_COLUMN])


@register("pivot_selected_in_order", _SELECTED_SQL)
def q_pivot_selected_in_order(spark, sf_dir):
    """F8, then C3 by the row order that the table carries, through the join."""
    df = obt(spark, sf_dir, with_order=True).withColumnRenamed(SEQ_COLUMN, ROW_ORDER)
    picked = dm.datamap(df, PROFILE_SOURCE).where(
        (F.col("source") == "HOUSEHOLD") & F.col("collection").isin("1-URGENT", "5-LOW"))
    return pv.filter_pivot(pv.select_collections(picked, df), INDEX_COLS, ind="label")


@register("first_cells", f"""
select country, year, indicator_code, first(value order by {_ORDER_SQL}) as cell from obt group by all""")
def q_first_cells(spark, sf_dir):
    return pv.first_cells(obt(spark, sf_dir, with_order=True), "code", [SEQ_COLUMN])


# a map is compared by its entries as one text, values in hundredths
@register("first_maps", f"""
, cells as (select country, year, indicator_code as k, first(value order by {_ORDER_SQL}) as v from obt group by all)
select country, year, count(k) as indicators,
  coalesce(string_agg(k || '=' || coalesce(cast(cast(round(v * 100) as bigint) as varchar), ''), ';' order by k)
    filter (where k is not null), '') as entries,
  max(v) filter (where k is null) as of_null
from cells group by all""")
def q_first_maps(spark, sf_dir):
    maps = pv.first_maps(obt(spark, sf_dir, with_order=True), "code", [SEQ_COLUMN])
    entry = "concat(e.key, '=', coalesce(cast(cast(round(e.value * 100) AS bigint) AS string), ''))"
    return maps.selectExpr(
        "country", "year", "cast(size(cells) AS bigint) AS indicators",
        f"array_join(transform(array_sort(map_entries(cells), (a, b) -> if(a.key < b.key, -1, 1)), e -> {entry}), ';') "
        "AS entries", "of_null")


_SRC_CELLS_SQL = """
, cells as (
  select country, year, {ind} as k, avg(value) as v
  from obt
  where country is not null and year is not null and {ind} is not null and value is not null
  group by all)"""


@register("src_tbl_mean", _SRC_CELLS_SQL.format(ind="indicator_code")
          + f"\nselect * from (pivot cells on k in ({_names(MEAN_CODES)}) using first(v) group by country, year)")
def q_src_tbl_mean(spark, sf_dir):
    return pv.src_tbl(obt(spark, sf_dir), ind="code", values=MEAN_CODES)


@register("src_tbl_source", _SRC_CELLS_SQL.format(ind="indicator_label")
          .replace("where country", "where source = 'FURNITURE' and country")
          + f"\nselect * from (pivot cells on k in ({_names(MEAN_LABELS)}) using first(v) group by country, year)")
def q_src_tbl_source(spark, sf_dir):
    # The table filtered by a SQL predicate string before the mean pivot.
    return pv.src_tbl(obt(spark, sf_dir).filter("source = 'FURNITURE'"), ind="label")


def _lin_sql(q: float) -> str:
    lo = f"max(case when rk = floor((n - 1) * {q}) then v end)"
    hi = f"max(case when rk = ceil((n - 1) * {q}) then v end)"
    frac = f"((n - 1) * {q} - floor((n - 1) * {q}))"
    return f"{lo} + ({hi} - {lo}) * {frac}"


@register("describe_wide", _SRC_CELLS_SQL.format(ind="indicator_code") + f"""
, r as (select k, v, row_number() over (partition by k order by v) - 1 as rk,
               count(*) over (partition by k) as n from cells)
, qs as (select k, {_lin_sql(0.25)} as "25%", {_lin_sql(0.5)} as "50%", {_lin_sql(0.75)} as "75%"
         from r group by k, n)
, b as (select k, count(v) as count, avg(v) as mean, stddev_samp(v) as std,
               min(v) as min, max(v) as max from cells group by k)
select b.k as "column", count, mean, std, min, "25%", "50%", "75%", max
from b left join qs on b.k = qs.k""")
def q_describe_wide(spark, sf_dir):
    return ck.describe_cells(pv.src_cells(obt(spark, sf_dir), "code"), "indicator_code")


@register("info_wide", _SRC_CELLS_SQL.format(ind="indicator_code") + """
select k as "column", count(*) as non_null_count, 'double' as dtype from cells group by k""")
def q_info_wide(spark, sf_dir):
    return ck.info_cells(pv.src_cells(obt(spark, sf_dir), "code"), "indicator_code")


# ---------------------------------------------------------------- C8-C13, I2, I3, A11
# Countries whose income level is checked (names of the derived table; the
# last one has a null country, so it matches nothing).
CHECK_COUNTRIES = ("NATION_1", "NATION_7", "NATION_13", "NATION_19", "NATION_24")


@register("income_check", f"""
select distinct country, income_level, high_income, upper_middle_income, lower_middle_income, low_income
from obt where country in ({", ".join(repr(c) for c in CHECK_COUNTRIES)})""")
def q_income_check(spark, sf_dir):
    return ck.income_check(obt(spark, sf_dir), list(CHECK_COUNTRIES))


@register("income_distribution", "select income_level, count(*) as count from obt group by all")
def q_income_distribution(spark, sf_dir):
    return ck.income_distribution(obt(spark, sf_dir))


@register("null_income_count", f"""
select {_NUNIQ.format(c="country")} as num_countries from obt where income_level is null""")
def q_null_income_count(spark, sf_dir):
    return ck.null_income_count(obt(spark, sf_dir))


@register("null_income_countries", "select distinct country from obt where income_level is null")
def q_null_income_countries(spark, sf_dir):
    return ck.null_income_countries(obt(spark, sf_dir))


# The 14 metadata columns of the default profile.
METADATA_COLS = ("source", "database", "collection", "indicator_code", "value_meta",
                 "region_name", "sub_region_name", "intermediate_region_name",
                 "least_developed_countries_ldc", "land_locked_developing_countries_lldc",
                 "small_island_developing_states_sids", "income_level", "oecd_member",
                 "fragile_and_conflict_affected_situations")


@register("distinct_counts", " union all ".join(
    f"select '{c}' as \"column\", {_NUNIQ.format(c=c)} as distinct_count from obt"
    for c in METADATA_COLS))
def q_distinct_counts(spark, sf_dir):
    return ck.distinct_counts(obt(spark, sf_dir), DEFAULT_PROFILE.metadata_columns, DEFAULT_PROFILE.metadata_groups)


@register("profile_distinct_counts", " union all ".join(
    f"select '{c}' as \"column\", {_NUNIQ.format(c=c)} as distinct_count from obt"
    for c in METADATA_COLS))
def q_profile_distinct_counts(spark, sf_dir):
    profile, table = _profiled(spark, sf_dir)
    return ck.distinct_counts(table, profile.metadata_columns, profile.metadata_groups)


@register("distinct_collection", f"select {_NUNIQ.format(c='collection')} as n_unique_collection from obt")
def q_distinct_collection(spark, sf_dir):
    return ck.n_unique_of(obt(spark, sf_dir), "collection")


@register("top10_indicators", """
select indicator_label, count,
  cast(rank() over (order by count desc, indicator_label asc nulls first) as integer) as rank
from (select indicator_label, count(*) as count from obt group by all)
qualify rank <= 10""")
def q_top10_indicators(spark, sf_dir):
    return ck.top_indicators(obt(spark, sf_dir), 10)


_RANKED_SQL = """
select *, rank() over (order by count desc) as rank from (select {by}, count(*) as count from obt group by all) c"""
RANK_CELL = ("indicator_code", "country", "year")


@register("rank_indicators", _RANKED_SQL.format(by="indicator_label"))
def q_rank_indicators(spark, sf_dir):
    return ck.rank_groups(obt(spark, sf_dir), ["indicator_label"])


@register("rank_cells", _RANKED_SQL.format(by=", ".join(RANK_CELL)))
def q_rank_cells(spark, sf_dir):
    """Every (indicator, country, year) by its number of rows: many ties."""
    return ck.rank_groups(obt(spark, sf_dir), RANK_CELL)


@register("obt_shape", f"select count(*) as rows, {len(OBT_OUT)} as columns from obt")
def q_obt_shape(spark, sf_dir):
    return ck.shape(obt(spark, sf_dir))


# ---------------------------------------------------------------- S4, I1, I6
@register("csv_round_trip", f"select {', '.join(OBT_OUT)} from obt")
def q_csv_round_trip(spark, sf_dir):
    """The table written as CSV below the shared folder and read again."""
    rows = obt(spark, sf_dir).select(*OBT_OUT)
    path = derived_table_dir(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(rows, path)
    delete_at_exit(spark, path)
    return read_csv(spark, path, rows.schema)


# Texts that a careless CSV loses.
_HARD = ("'line1' || chr(10) || 'line2'", "''", "' pad '", "'a,b \"q\" c'", "'back\\\\slash\\\\'", "null", "'\"'",
         "chr(13) || chr(10) || 'x'", "chr(9) || 'tab'")
_HARD_SQL = "case year % {n} {cases} end".format(
    n=len(_HARD), cases=" ".join(f"when {i} then {t}" for i, t in enumerate(_HARD)))


@register("csv_lossless", "select year, collection, note, nested, count(*) as rows from (select *, "
          + _HARD_SQL.replace("\\\\", "\\") + " as note, source || "
          + _HARD_SQL.replace("\\\\", "\\") + " || source as nested from obt) q group by all")
def q_csv_lossless(spark, sf_dir):
    """Texts with breaks, quotes, backslashes, outer blanks, empty and null, through CSV and back."""
    rows = obt(spark, sf_dir).select("year", "collection", F.expr(_HARD_SQL).alias("note"),
                                     F.expr(f"source || {_HARD_SQL} || source").alias("nested"))
    path = derived_table_dir(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(rows, path)
    delete_at_exit(spark, path)
    return read_csv(spark, path, rows.schema).groupBy("year", "collection", "note", "nested").agg(
        F.count(F.lit(1)).alias("rows"))


@register("observed_rows", "select count(*) as rows from obt")
def q_observed_rows(spark, sf_dir):
    """Rows that an observation saw while the table was read."""
    seen = Observation()
    rows = obt(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


@register("observed_metrics", "select count(*) as rows, count(value) as with_value, min(year) as first_year, "
          "max(year) as last_year, count(*) filter (where iso3 is null) as no_code from obt")
def q_observed_metrics(spark, sf_dir):
    """Several figures of the table that an observation took while the table was read once."""
    rows, seen = metrics.observe(
        obt(spark, sf_dir), "figures", rows=F.count(F.lit(1)), with_value=F.count("value"), first_year=F.min("year"),
        last_year=F.max("year"), no_code=F.count_if(F.col("iso3").isNull()))
    rows.write.format("noop").mode("overwrite").save()
    names = ["rows", "with_value", "first_year", "last_year", "no_code"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)],
                                 "rows long, with_value long, first_year int, last_year int, no_code long")


_ROW_FLOW_SQL = ("select 'scan' as step, count(*) as rows from obt{where} union all "
                 "select 'result', count(*) from (select distinct {by} from obt{where}) q")


@register("row_flow_datamap", _ROW_FLOW_SQL.format(where="", by=", ".join(PROFILE_INDICATOR)))
def q_row_flow_datamap(spark, sf_dir):
    """Rows that C2 over the indicator columns read and gave, from the metrics of its plan."""
    return metrics.row_flow(dm.datamap(obt(spark, sf_dir), list(PROFILE_INDICATOR)))


@register("row_flow_source", _ROW_FLOW_SQL.format(where=" where source = 'FURNITURE'", by=", ".join(PROFILE_SOURCE)))
def q_row_flow_source(spark, sf_dir):
    """The same over one source: the other folders give the scan no row."""
    return metrics.row_flow(dm.datamap(obt(spark, sf_dir).where("source = 'FURNITURE'"), list(PROFILE_SOURCE)))


def _nearest_sql(q: float) -> str:
    return f"max(case when rk = floor((n - 1) * {q} + 0.5) then v end)"


# Spark type names of the table's columns (the dtype column of ``info``).
_OBT_TYPES = {"year": "int", "value": "double"}


@register("schema_obt", " union all ".join(
    f"select '{c}' as \"column\", '{_OBT_TYPES.get(c, 'string')}' as dtype" for c in OBT_OUT))
def q_schema_obt(spark, sf_dir):
    return ck.schema_table(obt(spark, sf_dir).select(*OBT_OUT))


@register("info_obt", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as non_null_count, '{_OBT_TYPES.get(c, 'string')}' as dtype "
    "from obt" for c in OBT_OUT))
def q_info_obt(spark, sf_dir):
    return ck.info(obt(spark, sf_dir).select(*OBT_OUT))


_DESCRIBE_NUM = ("year", "value")


@register("describe_polars", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as count, count(*) filter (where {c} is null) as null_count, "
    f"cast(min({c}) as varchar) as min, cast(max({c}) as varchar) as max from obt"
    for c in OBT_OUT).join(["with base as (", ")"]).replace("with base as (", ", base as (", 1) + f"""
, lv as (select 'year' as "column", cast(year as double) as v from obt
         union all select 'value', value from obt)
, r as (select "column", v, row_number() over (partition by "column" order by v) - 1 as rk,
               count(*) over (partition by "column") as n from lv where v is not null)
, qs as (select "column", {_nearest_sql(0.25)} as "25%", {_nearest_sql(0.5)} as "50%",
                {_nearest_sql(0.75)} as "75%" from r group by all)
, mo as (select "column", avg(v) as mean, stddev_samp(v) as std from lv group by all)
select b."column", count, null_count, mean, std, min, "25%", "50%", "75%", max
from base b left join mo on b."column" = mo."column" left join qs on b."column" = qs."column"
""")
def q_describe_polars(spark, sf_dir):
    return ck.describe(obt(spark, sf_dir).select(*OBT_OUT))


# ---------------------------------------------------------------- rounding
# queries() round every double column to 6 places (``round_doubles``); the
# oracles round the same columns, so the two results are equal value for
# value, not only within a tolerance.
_BASE_DOUBLES = ("mean_value", "median_value", "min_value", "max_value", "iqr_value",
                 "pct_missing_value")
_ORACLE_DOUBLES = {
    "scan_classify": ("value",),
    "csv_round_trip": ("value",),
    "first_cells": ("cell",),
    "first_maps": ("of_null",),
    "base_stats": _BASE_DOUBLES,
    "sub_region_coverage": tuple(_PCT_COLS),
    "coverage_color": tuple(_PCT_COLS),
    "indicators_metadata": _BASE_DOUBLES + tuple(_PCT_COLS) + ("completeness_score",),
    "describe_wide": ("mean", "std", "min", "25%", "50%", "75%", "max"),
    "describe_polars": ("mean", "std", "25%", "50%", "75%"),
}
# wide results: every column but the (country, year) index is a double
_ORACLE_WIDE = ("pivot_label", "pivot_code", "pivot_source", "pivot_source_year", "pivot_region",
                "pivot_country", "pivot_selected", "pivot_selected_in_order", "src_tbl_mean", "src_tbl_source")


def _dq(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


for _name, _cols in _ORACLE_DOUBLES.items():
    _rep = ", ".join(f"round({_dq(c)}{_off_tie(_name, c)}, 6) AS {_dq(c)}" for c in _cols)
    ORACLE[_name] = f"select * replace ({_rep}) from (\n{ORACLE[_name]}\n) q"
for _name in _ORACLE_WIDE:
    ORACLE[_name] = (f"select country, year, round(COLUMNS(* EXCLUDE (country, year)){_off_tie(_name, '')}, 6) "
                     f"from (\n{ORACLE[_name]}\n) q")
