"""SparkSession construction and shared-folder helpers.

Settings the library relies on:

* session time zone UTC — calendar parts and year splits are defined on the UTC hour;
* ANSI mode on (Spark 4 default) — arithmetic on mismatched types raises instead of guessing;
* AQE on, with skew-join splitting and runtime broadcast conversion — aggregated sides that turn
  out small at run time are broadcast, hot keys are split, without hand-placed hints.

Scratch output (round-trip files, saved models, lineage cuts) goes under the folder the cluster names
in ``spark.checkpoint.dir``; only a local session may leave that unset (tests, laptops).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE coalesce the partitions of persisted intermediates too (small model outputs would
    # otherwise keep the full shuffle width and schedule hundreds of near-empty tasks)
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wattframe", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's settings.

    On a cluster call it without ``master``; the launcher decides.  ``shuffle_partitions`` should be
    sized so one shuffle partition holds ~128-256 MB at the target scale; AQE coalesces small ones.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


RUNTIME_CONF = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime SQL settings to a session someone else built (idempotent)."""
    for k in RUNTIME_CONF:
        if spark.conf.get(k, None) != DEFAULT_CONF[k]:
            spark.conf.set(k, DEFAULT_CONF[k])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session (tests, laptops), whose tasks
    all run in the driver, may leave it unset: it gets a folder of its own that goes when Python ends.
    On a cluster a missing setting raises, because executors would write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        d = _own_folder()
        spark.conf.set("spark.checkpoint.dir", d)
    context = getattr(spark, "_sc", None)  # a Spark Connect session has none; its checkpoints read the setting
    if context is not None and not context.getCheckpointDir():
        context.setCheckpointDir(d)
    return d


@lru_cache(maxsize=1)
def _own_folder() -> str:
    d = tempfile.mkdtemp(prefix="wattframe-local-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder ."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "wattframe", *parts, uuid.uuid4().hex])


def cut_lineage(df):
    """Write a frame once to the shared folder and read it back.

    Later reads are column-pruned file scans, and a lost executor does not send the plan behind the frame
    back to work.  (``checkpoint`` would run that plan twice, once to count and once to write.)
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p


__all__ = ["get_session", "configure", "ensure_checkpoint_dir", "scratch_path", "cut_lineage", "local_path"]
