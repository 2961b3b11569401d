"""Incremental forms of three batch operators on Structured Streaming.

The mean and the upsert are streaming aggregations: their state, and the watermark if a delay is
given, are the engine's. A batch writes the rows it changed under its number, so one that is replayed
after a lost executor writes the same folder again, and the newest row of a key counts. Results do not
depend on how rows fall into micro-batches, unless a delay says that old rows are late. Folders belong
to the caller: with the same ones a later run goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spreadlake.functions import calendar as cal
from spreadlake.operators import quality
from spreadlake.session import shared_dir


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stored table, one file or a folder of part files, as a file stream with the schema its files declare."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at, fs = _located(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    # a stream watches folders: the file is the one of its name in its own
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def _folder(spark: SparkSession, folder: str | None, label: str) -> str:
    return folder.rstrip("/") if folder else shared_dir(spark, label)


def _run(stream: DataFrame, write, root: str) -> None:
    query = (
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches written below ``path``, with their number in ``batch``; nothing yet is an empty frame."""
    at, fs = _located(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("long"))


def _changes(result: DataFrame, keys: Sequence[str], root: str) -> tuple[DataFrame, int]:
    """The newest row per key of a streaming aggregation, and how many rows its watermark dropped."""
    spark = result.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    query = (
        result.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    rows = _batches(spark, f"{root}/changes", result.schema)
    others = [c for c in result.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]), dropped


def streaming_period_mean(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, min_obs: int, grain: str = "daily", delay: str | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, int]:
    """(mean per period, rows dropped as late) of what has arrived.

    Counts and sums per key and period are the state. Without ``delay`` no row is late and no state is
    given up. With it, for daily periods, the watermark closes a day once the newest row is ``delay``
    past its end: rows of closed days are dropped and counted, as the engine counts them after partial
    sums. A period below the floor is NULL with its count.
    """
    root = _folder(stream.sparkSession, folder, "stream-mean")
    dated = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if delay is None:
        grouped = dated.groupBy(*keys, cal.anchor("_ts", grain).cast("date").alias("period"))
    elif grain == "daily":
        grouped = dated.withWatermark("_ts", delay).groupBy(*keys, F.window("_ts", "1 day").alias("_day"))
    else:
        raise ValueError("a delay needs daily periods")
    sums = grouped.agg(F.count(value).alias("observations"), F.sum(F.col(value).cast("double")).alias("_total"))
    if delay is not None:
        sums = sums.select(*keys, F.to_date("_day.start").alias("period"), "observations", "_total")
    means, dropped = _changes(sums, [*keys, "period"], root)
    mean = F.col("_total") / F.col("observations")
    return means.select(*keys, "period", F.when(F.col("observations") >= min_obs, mean).alias("value"), "observations"), dropped


def streaming_vintage_upsert(
    stream: DataFrame, keys: Sequence[str], vintage_col: str, doc: str, provisional: str, values: Sequence[str], folder: str | None = None
) -> DataFrame:
    """Newest final print per key as documents arrive, with what its revisions were.

    The winner is a ``max_by`` and the rest are minima, maxima and sets, so the engine's state per key
    is all that a batch needs, and it writes only the keys it touched. ``first_vintage`` is the oldest
    print's, ``revised`` says that the first value printed is not the one kept, ``largest_revision`` is
    the widest range of prints (both of the first value column), ``documents`` those that contributed.
    """
    root = _folder(stream.sparkSession, folder, "stream-vintage")
    rank = F.struct((~F.col(provisional)).alias("f"), F.col(vintage_col).alias("v"), F.col(doc).alias("d"))
    age = F.struct(F.col(vintage_col).alias("v"), F.col(doc).alias("d"))
    body = F.struct(*values, F.col(provisional).alias("_p"), F.col(vintage_col).alias("_v"))
    main = values[0]
    state = stream.groupBy(*keys).agg(
        F.max_by(body, rank).alias("kept"), F.count("*").alias("n_prints"), F.min_by(main, age).alias("first_value"), F.min(age).alias("age"),
        F.min(main).alias("low"), F.max(main).alias("high"), F.array_sort(F.collect_set(doc)).alias("documents"),
    )
    table, _ = _changes(state, keys, root)
    return table.select(
        *keys, *[F.col(f"kept.{v}").alias(v) for v in values], F.col("kept._p").alias("provisional"), F.col("kept._v").alias("vintage"), "n_prints",
        F.col("age.v").alias("first_vintage"), (~F.col(f"kept.{main}").eqNullSafe(F.col("first_value"))).alias("revised"),
        (F.col("high") - F.col("low")).alias("largest_revision"), "documents",
    )


def streaming_guarded_append(stream: DataFrame, unit: Sequence[str], spec: quality.Spec, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their problems); a ``unit`` is judged on all its rows.

    A batch stages its rows and beside them its counts per unit and date, which add up over batches:
    the verdict reads those, not the rows, so it does not matter which rows arrived together, and a
    unit that becomes complete later moves over. Rules about the order of rows in a file or about
    columns that are missing do not add up; with those, all staged rows are judged.
    """
    spark = stream.sparkSession
    root = _folder(spark, folder, "stream-guard")
    sums = not spec.position and not quality.missing_columns(stream, [spec.date, *spec.required])
    counts = quality.date_counts(spark.createDataFrame([], stream.schema), unit, spec).schema if sums else None

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/staged/batch={number}")
        if sums:
            quality.date_counts(batch, unit, spec).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    _run(stream, write, root)
    staged = _batches(spark, f"{root}/staged", T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).drop("batch")
    if sums:
        parts = _batches(spark, f"{root}/counts", T.StructType([*counts.fields, T.StructField("batch", T.LongType())])).drop("batch")
        judged = quality.with_problems(quality.tallied(quality.added(parts, unit), unit, spec), spec)
    else:
        judged = quality.validate(staged, unit, spec)
    verdict = judged.select(*unit, "problems")
    good = staged.join(verdict.filter(F.size("problems") == 0), list(unit), "left_semi")
    return good, staged.join(verdict.filter(F.size("problems") > 0), list(unit))
