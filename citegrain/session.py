"""Session defaults and the few helpers that touch cluster settings."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(master: str = "local[8]", app: str = "citegrain", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a session on one machine that names
    none gets a private one: on a cluster executors would write to disks of their own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="citegrain-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def hinted(df: DataFrame, limit: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """The broadcast hint where a counted table of short rows has at most ``limit`` of them, else
    the table as it is."""
    return F.broadcast if df.count() <= limit else lambda table: table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` so that later groupings by a superset need no shuffle; the
    number of partitions is left to adaptive execution."""
    return df.repartition(*[F.col(key) for key in keys])


def spread_scan(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan when the session asks for it by ``spark.citegrain.spreadScans``: for
    tables of a few unsplittable files, as on one machine. Off unless set."""
    asked = scan.sparkSession.conf.get("spark.citegrain.spreadScans", "false") == "true"
    return spread(scan, *keys) if asked else scan
