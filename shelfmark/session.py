"""Session settings the library is written for, and where checkpoints go."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# No join in the library is hinted unless its size was counted first, so the
# planner's own size-checked choice and its runtime re-planning must be on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go when nothing refers to the table any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` adds to or overrides them.

    Cluster sizing (shuffle partitions, executor memory) is left to the
    cluster's own defaults.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so there
    the setting is required, and must not name a folder of one machine there
    unless all executors share it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
        context.setCheckpointDir(current)
    return current
