"""Idempotent snapshot writes to versioned folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadlake.functions.frames import row_hash
from spreadlake.functions.numeric import publish as published


def canonical(df: DataFrame, places: int = 6) -> DataFrame:
    """Columns by name, doubles rounded for publication, so equal content looks equal."""
    out = []
    for name, kind in sorted(df.dtypes):
        out.append(published(name, places).alias(name) if kind in ("double", "float") else F.col(name))
    return df.select(*out)


def content_digest(df: DataFrame) -> str:
    """Row count and an order-free sum of row hashes: one small row comes back."""
    body = df.select(row_hash(df.columns).alias("h"))
    row = body.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['s']}-{','.join(f'{name}:{kind}' for name, kind in df.dtypes)}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class PublishConflict(RuntimeError):
    """Another writer published since this one looked."""


def last_commit(spark: SparkSession, root: str) -> int:
    """Number of the newest commit, 0 where nothing was ever published."""
    path, fs = _fs(spark, f"{root}/commits")
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _read_commit(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/commits/{number:012d}.json").collect()[0][0]) if number else {}


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The published version, or None where nothing was ever published."""
    commit = _read_commit(spark, root, last_commit(spark, root))
    return spark.read.parquet(f"{root}/{commit['version']}") if commit else None


def _commit(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Put a commit under its number unless one is there; the file appears whole or not at all."""
    side, fs = _fs(spark, f"{root}/side-{uuid.uuid4().hex}.json")
    stream = fs.create(side, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _fs(spark, f"{root}/commits/{number:012d}.json")
    fs.mkdirs(target.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri())
    # without the option to overwrite, a rename fails where the name is taken
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(side, target, options)
        return True
    except Py4JJavaError as error:
        fs.delete(side, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise


def publish(df: DataFrame, root: str, order: Sequence[str] = (), expected: int | None = None) -> bool:
    """Write a new version when the content differs; True when something was written.

    The data goes to its own folder first, then a commit with the next number names it. A commit that
    is there is never written over: of two writers that saw the same last commit the second one gets
    ``PublishConflict`` and its data is removed. ``expected`` is the commit that ``df`` was made from,
    by default the last one now.
    """
    spark = df.sparkSession
    table = canonical(df)
    version = f"v-{uuid.uuid4().hex}"
    seen = last_commit(spark, root) if expected is None else expected
    before = _read_commit(spark, root, seen)
    out = table.repartitionByRange(*order).sortWithinPartitions(*order) if order else table
    out.write.parquet(f"{root}/{version}")
    digest = content_digest(spark.read.parquet(f"{root}/{version}"))
    path, fs = _fs(spark, f"{root}/{version}")
    if before.get("digest") == digest and last_commit(spark, root) == seen:
        fs.delete(path, True)
        return False
    if not _commit(spark, root, seen + 1, json.dumps({"version": version, "digest": digest})):
        fs.delete(path, True)
        raise PublishConflict(f"{root}: commit {seen + 1} was made by another writer")
    return True


def build_marts(builders: Mapping[str, Callable[[], DataFrame]], root: str, shared: Sequence[DataFrame] = ()) -> dict[str, bool]:
    """Publish one table per concern; frames several marts read are persisted for the run."""
    for frame in shared:
        frame.persist()
    try:
        return {name: publish(build(), f"{root}/{name}") for name, build in builders.items()}
    finally:
        for frame in shared:
            frame.unpersist()
