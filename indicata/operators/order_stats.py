"""Exact per-group order statistics (median, quartiles): bracket and refine.

``F.median`` / ``F.percentile`` merge a value->count map for each group in
one task, so a group holding a third of the table would land in a single
task.  Here a mergeable sketch finds where the wanted ranks lie and only what
lies there is looked at value by value:

1. One aggregate gives each group's exact count and a KLL sketch of its
   values, both merged from partial results (the sketch has a fixed size).
   Its quantiles a little below and above each wanted one are a bracket.
2. One more aggregate over the table keeps the values inside the
   brackets, each with its count, and folds all others into one row for each
   gap between brackets (count, least, most), on the map side too: a hot group
   sends its few gap rows per task, not its values.
3. While a group keeps more than ``GROUP_ROWS`` rows, its brackets are cut
   into ``PARTS`` by a sketch of what is left, and step 2 runs on the kept rows
   with the part that holds the rank, found from exact counts.
4. A window over each group's few rows turns counts into ranks.  A rank that
   fell into a gap (the sketch was further off than the margin) is seen
   there, and the work is done again with a wider margin; at the widest the
   bracket is the whole group, so the result is always exact.

Nothing but JVM expressions runs, and no copy of the value column is
written: what is checkpointed is a few percent of the distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.functions.expressions import quote
from indicata.session import checkpoint_dir

#: Size parameter of the sketches; the rank error at 400 is about 0.7 percent.
SKETCH_K = 400
#: Quantiles by which a bracket reaches beyond the wanted one; ``WIDER`` times that after a miss.
MARGIN, WIDER = 0.01, 8
#: Groups of at most so many values are their own bracket.
SMALL = 400
#: Rows that a group may have in the last window.
GROUP_ROWS = 1 << 17
#: Parts into which a round cuts what a larger group has left.
PARTS = 256
#: Groups up to which their brackets are sent to every task; more meet the rows in a shuffle join.
BROADCAST_GROUPS = 50_000

_LOW, _HIGH = "double('-Infinity')", "double('Infinity')"


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _join(rows: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their group; ``groups`` is broadcast only up to ``BROADCAST_GROUPS`` rows."""
    small = groups.count() <= BROADCAST_GROUPS
    left, right = rows.alias("l"), (F.broadcast(groups) if small else groups).alias("r")
    return left.join(right, _null_safe_on(left, right, keys)).select("l.*", *[f"r.{c}" for c in columns])


def _brackets(rows: DataFrame, keys: list[str], qs: list[float], margin: float) -> DataFrame:
    """keys, ``_n`` and a bracket ``_lo<i>``..``_hi<i>`` for each of ``qs``."""
    groups = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.expr("count_if(NOT isnan(_v))").alias("_m"),
        F.expr(f"kll_sketch_agg_double(if(isnan(_v), null, _v), {SKETCH_K})").alias("_s"))
    out = []
    for i, q in enumerate(qs):
        for side, p, open_ in (("lo", q - margin, _LOW), ("hi", q + margin, _HIGH)):
            at = f"if(_m > {SMALL}, kll_sketch_get_quantile_double(_s, {p!r}D), {open_})" if 0 < p < 1 else open_
            out.append(f"{at} AS _{side}{i}")
    return groups.selectExpr(*map(quote, keys), "_n", *out)


def _fold(rows: DataFrame, brackets: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``rows`` (keys, _v, _c, _least, _most) outside all brackets made one row for each gap.

    A row with a null ``_v`` is such a gap already; within a bracket it stays
    one.  Gaps are numbered by the brackets below them, so a gap's rows
    have no kept row between them.
    """
    names = [f"_{side}{i}" for i in range(count) for side in ("lo", "hi")]
    joined = _join(rows, brackets, keys, ["_n", *names])
    inside = " OR ".join(f"(_least >= _lo{i} AND _least <= _hi{i})" for i in range(count))
    gap = " + ".join(f"cast(_least > _hi{i} AS int)" for i in range(count))
    marked = joined.selectExpr(*map(quote, keys), "_n", f"if({inside}, -1, {gap}) AS _gap",
                               f"if({inside}, _least, null) AS _at", "_v", "_c", "_least", "_most")
    return marked.groupBy(*keys, "_n", "_gap", "_at").agg(
        F.expr("if(_gap = -1, max(_v), null)").alias("_v"), F.sum("_c").alias("_c"),
        F.min("_least").alias("_least"), F.max("_most").alias("_most")).drop("_gap", "_at")


def _ranked(rows: DataFrame, keys: list[str], order: str = "_least") -> DataFrame:
    """``rows`` with the ranks ``_start`` to ``_end`` (exclusive) that they take in their group."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("_end", F.sum("_c").over(upto))
    return ended.withColumn("_start", F.col("_end") - F.col("_c"))


def lower_rank(q: float) -> str:
    return f"cast(floor((_n - 1) * {float(q)!r}D) AS bigint)"


def upper_rank(q: float) -> str:
    return f"cast(ceil((_n - 1) * {float(q)!r}D) AS bigint)"


def nearest_rank(q: float) -> str:
    """Rank of the ``nearest`` quantile: round((n - 1) * q), halves up."""
    return f"cast(floor((_n - 1) * {float(q)!r}D + 0.5D) AS bigint)"


def _holds(rank: str) -> str:
    return f"(_start <= {rank} AND {rank} < _end)"


def _refined(rows: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Brackets narrowed to the part of each group's kept values that holds the rank."""
    points = ", ".join(f"{i / PARTS!r}D" for i in range(1, PARTS))
    groups = _cut(rows.where("_v IS NOT NULL").groupBy(*keys).agg(
        F.expr(f"kll_sketch_agg_double(_v, {SKETCH_K})").alias("_s")).selectExpr(
            *map(quote, keys), f"kll_sketch_get_quantile_double(_s, array({points})) AS _splits"))
    placed = _join(rows, groups, keys, ["_splits"]).withColumn(
        "_part", F.expr("size(filter(_splits, s -> s < _least))"))
    parts = placed.groupBy(*keys, "_n", "_part").agg(F.sum("_c").alias("_c"), F.any_value("_splits").alias("_splits"))
    out = []
    for i, q in enumerate(qs):
        out += [f"max(if({_holds(lower_rank(q))}, if(_part = 0, {_LOW}, _splits[_part - 1]), null)) AS _lo{i}",
                f"max(if({_holds(upper_rank(q))}, if(_part = {PARTS - 1}, {_HIGH}, _splits[_part]), null)) AS _hi{i}"]
    return _ranked(parts, keys, "_part").groupBy(*keys, "_n").agg(*map(F.expr, out))


def _largest(kept: DataFrame, keys: list[str]) -> int:
    return kept.groupBy(*keys).agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0


def _kept(rows: DataFrame, keys: list[str], qs: list[float], margin: float) -> DataFrame:
    """Steps 1 to 3: few rows per group, those near the wanted ranks value by value."""
    values = rows.selectExpr("*", "1L AS _c", "_v AS _least", "_v AS _most")
    kept = _cut(_fold(values, _cut(_brackets(rows, keys, qs, margin)), keys, len(qs)))
    before, now = None, _largest(kept, keys)
    while now > GROUP_ROWS and now != before:  # a part that cannot be cut further stays as it is
        kept = _cut(_fold(kept.drop("_n"), _cut(_refined(kept, keys, qs)), keys, len(qs)))
        before, now = now, _largest(kept, keys)
    return kept


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str], qs: list[float]) -> DataFrame:
    """Per group of ``keys``: ``n`` (non-null values) and, for each entry of ``ranks``, the
    value (a double) at that 0-based rank of the sorted non-null values.

    ``ranks`` maps an output name to SQL text over ``_n``; each lies between the
    lower and the upper rank of one of ``qs``.  NaN is the largest value.
    Groups without any non-null value have no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = MARGIN
    while True:
        ranked = _ranked(_kept(rows, keys, qs, margin), keys)
        in_gap = "_v IS NULL AND NOT _least <=> _most AND (" + " OR ".join(map(_holds, ranks.values())) + ")"
        if margin >= 1 or ranked.where(in_gap).isEmpty():
            break
        margin *= WIDER
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *[
        F.expr(f"max(if({_holds(r)}, coalesce(_v, _least), null)) AS {quote(name)}") for name, r in ranks.items()])


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    spec: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact quantiles per group.

    ``spec`` maps an output name to ``(q, method)`` with method one of
    ``nearest`` (rank round((n-1)q)), ``midpoint`` (mean of the two
    neighbouring ranks; the median for q=0.5) or ``linear`` (interpolated
    between them).  Output: keys, ``n`` and one double column per name.
    """
    ranks: dict[str, str] = {}
    outs: list[str] = []
    rank_of: dict[str, Callable[[float], str]] = {"v": nearest_rank, "lo": lower_rank, "hi": upper_rank}
    for name, (q, method) in spec.items():
        if method not in ("nearest", "midpoint", "linear"):
            raise ValueError(f"unknown quantile method {method!r}")
        own = ("v",) if method == "nearest" else ("lo", "hi")
        ranks |= {f"_{name}_{x}": rank_of[x](q) for x in own}
        v, lo, hi = (quote(f"_{name}_{x}") for x in ("v", "lo", "hi"))
        pos = f"((n - 1) * {float(q)!r}D)"
        outs.append({"nearest": v, "midpoint": f"({lo} + {hi}) / 2",
                     "linear": f"{lo} + ({hi} - {lo}) * ({pos} - floor({pos}))"}[method] + f" AS {quote(name)}")
    keys = list(keys)
    rv = ranked_values(df, keys, value, ranks, sorted({float(q) for q, _ in spec.values()}))
    return rv.selectExpr(*map(quote, keys), "n", *outs)
