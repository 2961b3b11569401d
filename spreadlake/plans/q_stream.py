"""Streaming forms: each equals its batch operator on the same rows."""

from pyspark.sql import functions as F

from spreadlake.operators.quality import Spec
from spreadlake.plans.registry import query
from spreadlake.streaming import incremental


def _stream(v, name="events.parquet"):
    return incremental.table_stream(v.spark, f"{v.sf_dir}/{name}")


@query("o01_streaming_period_mean", "event_type period:date value:num observations:int", """
    select event_type, cast(ts as date) period, case when count(*) >= 60 then avg(value) end as value, count(*) observations from events group by 1, 2""")
def o01(v):
    return incremental.streaming_period_mean(_stream(v), ["event_type"], "ts", "value", 60, delay=None)[0]


@query("o02_streaming_vintage_upsert", "date:date field value:num provisional:bool n_prints:int", """
    with k as (select *, row_number() over (partition by date, field order by provisional, vintage desc, doc desc) r, count(*) over (partition by date, field) n from readings)
    select date, field, value, provisional, n n_prints from k where r = 1""")
def o02(v):
    return _upserted(v)


def _upserted(v):
    rows = _stream(v).select(
        (F.col("user_id") % 12).alias("doc"), F.to_date("ts").alias("date"), F.col("event_type").alias("field"),
        F.col("ts").alias("vintage"), "value", (F.get_json_object("props", "$.k").cast("int") % 3 == 0).alias("provisional"),
    )
    return incremental.streaming_vintage_upsert(rows, ["date", "field"], "vintage", "doc", "provisional", ["value"])


@query("o02_streaming_revision_facts", "date:date field first_vintage:str revised:bool largest_revision:num n_documents:int", """
    with k as (select *, row_number() over (partition by date, field order by provisional, vintage desc, doc desc) r,
      row_number() over (partition by date, field order by vintage, doc) f from readings)
    select date, field, strftime(min(vintage), '%Y-%m-%d %H:%M:%S') first_vintage, max(case when r = 1 then value end) <> max(case when f = 1 then value end) revised,
      max(value) - min(value) largest_revision, count(distinct doc) n_documents from k group by 1, 2""")
def o02_facts(v):
    out = _upserted(v).withColumn("n_documents", F.size("documents"))
    return out.withColumn("first_vintage", F.date_format("first_vintage", "yyyy-MM-dd HH:mm:ss"))


def _guard(v):
    rows = _stream(v).select("user_id", F.to_date("ts").alias("date"), "value")
    spec = Spec(bounds={"value": (0.0, 220.0)}, min_rows=3, unique_dates=False)
    return incremental.streaming_guarded_append(rows, ["user_id"], spec)


PASSED = "count(*) filter (where value < 0 or value > 220) = 0 and count(*) >= 3"


@query("o03_streaming_guard_accepted", "user_id:int n:int", f"select user_id, count(*) n from events group by 1 having {PASSED}")
def o03(v):
    return _guard(v)[0].groupBy("user_id").agg(F.count("*").alias("n"))


@query("o03_streaming_guard_quarantine", "user_id:int n:int", f"select user_id, count(*) n from events group by 1 having not ({PASSED})")
def o03q(v):
    return _guard(v)[1].groupBy("user_id").agg(F.count("*").alias("n"))
