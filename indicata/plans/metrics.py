"""What a run of a query did, as rows: one per plan node and metric."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_SCHEMA = "node int, parent int, operator string, metric string, value long"


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan, parent: int | None = None, found: list | None = None) -> list[tuple]:
    """(number, parent's number, plan node) from the root down, adaptive wrappers left out."""
    found = [] if found is None else found
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _nodes(plan.executedPlan(), parent, found)
    if kind.endswith("QueryStageExec"):
        return _nodes(plan.plan(), parent, found)
    if kind == "InputAdapter":
        return _nodes(plan.child(), parent, found)
    number = len(found)
    found.append((number, parent, plan))
    for below in (plan.children(), plan.subqueries()):
        for child in _items(below):
            _nodes(child, number, found)
    return found


def plan_metrics(df: DataFrame) -> DataFrame:
    """Run ``df`` once and return (node, parent, operator, metric, value) of its final plan.

    Nodes are numbered from the root (0, parent null) down; the metrics are
    those Spark counts for each (``numOutputRows``, ``filesSize``,
    ``shuffleBytesWritten``, times in ms or ns, ..), as often as it ran: a global
    sort samples its input first, so what lies between it and the next shuffle
    below counts twice.  The root also has ``resultRows``.  Result rows are counted
    in the tasks and go nowhere; the driver holds one row per node and metric.  A
    node without metrics has one row with a null metric, a shuffle that is read
    twice counts where it is first met.  Every call runs the query anew.  Needs a
    classic session (a remote one shows no plan).
    """
    ran = df.alias("run")._jdf.queryExecution()  # a new execution: its metrics start at zero
    result = ran.toRdd().count()
    rows = []
    for number, parent, plan in _nodes(ran.executedPlan()):
        metrics = sorted((m._1(), m._2().value()) for m in _items(plan.metrics()))
        if parent is None:
            metrics.append(("resultRows", result))
        rows += [(number, parent, plan.nodeName().strip(), name, value) for name, value in metrics or [(None, None)]]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def row_flow(df: DataFrame) -> DataFrame:
    """(step, rows) of one run of ``df``: rows of all scans of files, and rows of the result."""
    rows = plan_metrics(df)
    of_files = F.col("operator").startswith("Scan") & (F.col("metric") == "numOutputRows")
    return (rows.withColumn("step", F.when(of_files, "scan").when(F.col("metric") == "resultRows", "result"))
            .where("step is not null").groupBy("step").agg(F.sum("value").alias("rows")))


def observe(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with named aggregates that are filled in while any action runs: read ``observation.get`` after it."""
    if not metrics:
        raise ValueError("observe: name at least one metric")
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
