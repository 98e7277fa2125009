"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

#: Runtime SQL settings; all can be changed on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even when the split costs one more shuffle: most plans
    # here aggregate right after the join, which is what the default gives up on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Lets the planner prune the large side of a shuffle join before it is shuffled.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Estimated size up to which the planner may broadcast a side on its own. The estimate is of
#: compressed bytes; in the driver's memory a table of ids is about ten times that.
BROADCAST_KEY = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_BYTES = 256 * 1024


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) * 1024 ** "bkmgtp".index(unit[:1] or "b")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder is known."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    # Lowered only, so that the joins of a plan cannot send the driver a share of every table.
    if _bytes(spark.conf.get(BROADCAST_KEY)) > BROADCAST_BYTES:
        spark.conf.set(BROADCAST_KEY, str(BROADCAST_BYTES))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a scratch one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="cohortry-"), "checkpoints"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def build_session(app: str = "cohortry", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session carrying :data:`SQL_SETTINGS` plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
