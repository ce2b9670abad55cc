"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; only where it is unset and all runs in one process, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodegraph-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in reliable storage."""
    ensure_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_alone(df: DataFrame) -> DataFrame:
    """As cut(); the shuffles that made `df` go at once, not when the driver happens to collect what refers to them.

    For a `df` that nothing else is worked out from; if something is, Spark shuffles again.
    """
    out = cut(df)
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession._jsc.sc().cleaner()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and cleaner.isDefined():
        for shuffle in plan.context().shuffleIds().keySet().toArray():
            cleaner.get().doCleanupShuffle(int(shuffle), True)
    return out
