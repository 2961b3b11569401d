"""Session settings used by the tests and the bench.

A cluster brings its own session; nothing in the library reads these values
except ``shared_dir``, which only looks at what the running session declares.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: The session time zone every operator assumes when it turns a timestamp into a date.
TIME_ZONE = "UTC"


def local_session(cores: str = "8", app: str = "spreadlake") -> SparkSession:
    """A small local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", TIME_ZONE)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint folder the session names.

    The cluster names a folder every executor can reach in
    ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only a session whose
    one process is all there is may do without and use a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = named.get() if named.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Rows up to which a stored dimension is broadcast.
SMALL_ROWS = 100_000


def stored_dimension(df, label: str = "dimension"):
    """One row per group, written once, to be joined to raw rows.

    It is broadcast if it has at most ``SMALL_ROWS`` rows, so that a group which holds a third of
    the raw rows is not shuffled; beyond, the join is shuffled and adaptive execution splits it.
    """
    from pyspark.sql import functions as F

    table = cut_lineage(df, label)
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def cut_lineage(df, label: str = "cut"):
    """Materialise a frame in the shared folder and read it back."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
