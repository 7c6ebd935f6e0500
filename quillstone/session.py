"""Making the package's Python code available to a session's executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Nodes of a plan that shuffle, or that give more rows than they are given.
_SHUFFLES = {"Join", "Aggregate", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Window", "Sort", "Distinct", "Deduplicate", "Generate"}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of ``spark`` (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillstone-ship-")) / "quillstone_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("quillstone") / p.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores where it comes from fewer files than there are cores, before work that is heavy per row.

    Only plans without a shuffle are looked at (asking others for their partitions would run them); large tables have splits enough
    and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _SHUFFLES.intersection(_nodes(df._jdf.queryExecution().optimizedPlan())) or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _nodes(plan) -> Iterator[str]:
    yield plan.nodeName()
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))
