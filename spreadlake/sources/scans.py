"""Table scans with explicit schemas, declared missing tokens and a quarantine frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spreadlake.functions import text
from spreadlake.functions.frames import split_rejects


class MissingTable(FileNotFoundError):
    """A table that is declared but not there: a condition of its own, not an empty frame."""


def read_series(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """A stored series with its schema given, never inferred."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop_path)
    if matches is None or len(matches) == 0:
        raise MissingTable(path)
    if fmt == "csv":
        options = {"header": True, "dateFormat": "yyyy-MM-dd", **options}
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def match_header(columns: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Find each wanted column by its label, never by its position."""
    folded = {c.strip().strip('"').casefold(): c for c in columns}
    found = {}
    for name, labels in wanted.items():
        hits = [folded[x.casefold()] for x in labels if x.casefold() in folded]
        if len(hits) != 1:
            raise ValueError(f"column {name!r}: {len(hits)} of the labels {list(labels)} in header {list(columns)}")
        found[name] = hits[0]
    return found


def scan_daily_csv(
    spark: SparkSession, path: str, date_labels: Sequence[str], value_labels: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a dated CSV; a declared missing token is NULL and keeps its row."""
    header = spark.read.option("header", True).csv(path).columns
    found = match_header(header, {"date": date_labels, "value": value_labels})
    schema = StructType([StructField(c, StringType()) for c in header] + [StructField("_corrupt", StringType())])
    raw = spark.read.schema(schema).csv(
        path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    )
    d, v = F.col(found["date"]), F.col(found["value"])
    parsed = F.when(F.trim(d).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(d).try_cast("date"))
    rows = raw.select(
        parsed.alias("date"), text.parse_number(F.coalesce(v, F.lit(""))).alias("value"), *keep,
        d.alias("_raw_date"), v.alias("_raw_value"), "_corrupt",
    )
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "wrong_width")
        .when(F.col("date").isNull(), "bad_date")
        .when(text.number_rejected("_raw_value"), "bad_value")
    )
    good, bad = split_rejects(rows, reason)
    return good.select("date", "value", *keep), bad.select("reason", "_raw_date", "_raw_value", *keep)


def scan_long_stats(
    spark: SparkSession, path: str, areas: Sequence[str], unit: str, pairs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Long statistics from many files: wanted areas, one unit, wanted (flow, product) pairs.

    The year in a file's path must be the year of its periods; other rows go to
    the second frame with their reason. ``pairs`` is a literal dimension.
    """
    schema = "ref_area string, time_period string, product string, flow string, unit string, obs_value string, code string"
    # a plain path column keeps a year folder from overriding the data's own columns
    raw = (
        spark.read.schema(schema)
        .option("header", True).option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("file_year", F.regexp_extract(F.col("_metadata.file_path"), r"(?:year=|_)(\d{4})", 1).cast("int"))
    )
    wanted = raw.filter(F.col("ref_area").isin(*areas) & (F.col("unit") == unit)).join(
        F.broadcast(pairs), ["flow", "product"], "left_semi"
    )
    month = F.when(F.col("time_period").rlike(r"^\d{4}-\d{2}$"), F.concat("time_period", F.lit("-01")).try_cast("date"))
    rows = wanted.withColumn("m", month).withColumn("value", text.parse_number("obs_value"))
    reason = (
        F.when(F.col("m").isNull(), "bad_period")
        .when(F.year("m") != F.col("file_year"), "year_not_of_file")
        .when(text.number_rejected("obs_value"), "bad_value")
    )
    return split_rejects(rows, reason)


SEED_SCHEMA = """name string,
  figures array<struct<key string, value double, unit string, source_url string>>,
  anchors map<string, double>,
  events array<struct<id string, day string, kind string, source_url string>>"""


def scan_seed(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Figures, anchors and events of nested seed documents, and the figures that lack a fact."""
    docs = spark.read.schema(SEED_SCHEMA).json(path, multiLine=multi_line)
    figures = docs.select("name", F.inline("figures"))
    reason = (
        F.when(F.col("value").isNull(), "no_value")
        .when(F.coalesce(F.trim("unit"), F.lit("")) == "", "no_unit")
        .when(F.coalesce(F.trim("source_url"), F.lit("")) == "", "no_source_url")
    )
    good, bad = split_rejects(figures, reason)
    return {
        "figures": good,
        "rejected": bad,
        "anchors": docs.select("name", F.explode("anchors").alias("anchor", "printed")),
        "events": docs.select("name", F.inline("events")),
    }


def normalise_bars(
    df: DataFrame, ts: str, zone: str, cutoff: str, keys: Sequence[str], prices: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Bars on their exchange day: all-null bars and the unsettled day go, double days are rejected."""
    local = df.withColumn("day", F.to_date(F.from_utc_timestamp(ts, zone)))
    real = local.filter(F.coalesce(*prices).isNotNull() & (F.col("day") < F.lit(cutoff).cast("date")))
    count = real.groupBy(*keys, "day").agg(F.count("*").alias("_n"))
    tagged = real.join(count, [*keys, "day"])
    good, bad = split_rejects(tagged, F.when(F.col("_n") > 1, "duplicate_day"))
    return good.drop("_n"), bad.drop("_n")


QUOTE_PAYLOAD = "struct<zone:string, timestamps:array<bigint>, close:array<double>, volume:array<bigint>>"


def explode_payload(df: DataFrame, payload: Column | str, schema: str = QUOTE_PAYLOAD) -> DataFrame:
    """One row per quote of a payload holding parallel arrays."""
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    zipped = F.arrays_zip(
        F.col("_p.timestamps").alias("timestamps"), F.col("_p.close").alias("close"), F.col("_p.volume").alias("volume")
    )
    rest = [c for c in df.columns if not isinstance(payload, str) or c != payload]
    return parsed.select(*rest, F.inline(zipped).alias("epoch", "close", "volume"))
