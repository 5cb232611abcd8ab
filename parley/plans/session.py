"""Session helpers: reading tables, and bringing this package to the executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from math import ceil
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
# What has no known size counts as endless, so there is a limit.
MOST_PARTITIONS = 4096


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once for each session, so that no installation is needed there."""
    context = spark.sparkContext
    if getattr(context, "_parley_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="parley-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    context.addPyFile(out.name)
    context._parley_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table dealt by keys into a partition for each MB of its files, and as many as there are cores at least: a task's share stays the same, however large the table is."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(max(least, ceil(expected / (1 << 20))), MOST_PARTITIONS), *keys)


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """What action() gives, if its jobs end in time; else they are cancelled and TimeoutError is raised."""
    context, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
        while not done.wait(0.2):  # an action has several jobs, and planning between them
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        return action()
    except Exception as e:
        if late.is_set() and (isinstance(e, PySparkException) or "cancel" in str(e).lower()):
            raise TimeoutError(f"not done in {seconds} s") from e
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
