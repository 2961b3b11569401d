"""Vintages and revisions over the readings view."""

from pyspark.sql import functions as F

from spreadlake.operators import calendar_ops, vintage
from spreadlake.plans.registry import query

FIELDS = ("click", "view", "error")


def _issues(v):
    """One row per (date, document) with the last value of each field."""
    order = F.col("vintage")
    return v.readings.groupBy("date", "doc").agg(
        *[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, order)).alias(f) for f in FIELDS]
    )


@query("i01_latest_document_wins", "date:date source_document:int click:num view:num error:num n_documents:int documents", """
    with d as (select date, doc, max_by(value, vintage) filter (where field = 'click') click, max_by(value, vintage) filter (where field = 'view') as view,
      max_by(value, vintage) filter (where field = 'error') as error from readings group by 1, 2),
    w as (select date, max(doc) source_document, count(*) n_documents, string_agg(cast(doc as varchar), ';' order by doc) documents from d group by 1)
    select w.*, d.click, d.view, d.error from w join d on d.date = w.date and d.doc = w.source_document""")
def i01(v):
    return vintage.latest_document_wins(_issues(v), [], "date", "daily", "doc", FIELDS)


@query("i02_final_beats_provisional", "date:date field value:num provisional:bool vintage first_vintage n_prints:int revised:bool max_revision:num n_documents:int documents", """
    with k as (select *, row_number() over (partition by date, field order by provisional, vintage desc, doc desc) rk,
      row_number() over (partition by date, field order by vintage, doc) rf from readings),
    a as (select date, field, max(case when rk = 1 then value end) as value, bool_or(provisional) filter (where rk = 1) provisional,
      max(case when rk = 1 then vintage end) vintage, max(case when rf = 1 then vintage end) first_vintage, max(case when rf = 1 then value end) fv, count(*) n from k group by 1, 2),
    s as (select date, field, count(distinct doc) n_documents, string_agg(distinct cast(doc as varchar), ';' order by cast(doc as varchar)) documents0 from readings group by 1, 2),
    o as (select date, field, string_agg(cast(doc as varchar), ';' order by doc) documents from (select distinct date, field, doc from readings) group by 1, 2)
    select a.date, a.field, a.value, a.provisional, strftime(a.vintage, '%Y-%m-%d %H:%M:%S.%f') vintage, strftime(a.first_vintage, '%Y-%m-%d %H:%M:%S.%f') first_vintage,
      n n_prints, n > 1 and a.value <> fv revised, case when n > 1 then abs(a.value - fv) end max_revision, n_documents, documents
    from a join s using (date, field) join o using (date, field)""")
def i02(v):
    out = vintage.final_beats_provisional(v.readings, ["date", "field"], "vintage", "doc", "provisional", ["value"])
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.withColumn("vintage", F.date_format("vintage", fmt)).withColumn("first_vintage", F.date_format("first_vintage", fmt))


@query("i02_revision_history", "date:date field entry n:int", """
    select date, field, strftime(vintage, '%Y-%m-%d') || '|' || case when provisional then 'provisional' else 'final' end || '|value=' || printf('%.2f', value) entry, count(*) n
    from readings group by all""")
def i02h(v):
    entry = vintage.format_print(F.to_date("vintage"), F.col("provisional"), {"value": F.format_string("%.2f", F.col("value"))})
    return v.readings.groupBy("date", "field", entry.alias("entry")).agg(F.count("*").alias("n"))


@query("i03_first_print_kept", "date:date field value:num n_prints:int disagreement:num", """
    with d as (select date, field, doc, min_by(value, vintage) as value from readings group by 1, 2, 3)
    select date, field, min_by(value, doc) as value, count(*) n_prints, case when count(*) > 1 then max(value) - min(value) end disagreement from d group by 1, 2""")
def i03(v):
    one = v.readings.groupBy("date", "field", "doc").agg(F.min_by("value", "vintage").alias("value"))
    return vintage.first_print(one, ["date", "field"], "doc", "value")


STITCH_SOURCE = "(select user_id, cast(ts as date) date, event_type doc, length(event_type) geometry, value from events)"


@query("i04_stitched_series", "user_id:int date:date value:num spread:num n_notes:int n_geometries:int cross_checked:bool evidence_class", f"""
    with o as (select user_id, date, doc, geometry, avg(value) x from {STITCH_SOURCE} group by 1, 2, 3, 4),
    a as (select user_id, date, median(x) as value, case when count(*) > 1 then max(x) - min(x) end spread, count(*) n_notes, count(distinct geometry) g from o group by 1, 2),
    s as (select user_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) date from a group by 1),
    d as (select s.user_id, s.date, a.value, a.spread, coalesce(n_notes, 0) n_notes, coalesce(g, 0) g from s left join a on a.user_id = s.user_id and a.date = s.date),
    b as (select user_id, min(case when g > 1 then date end) f, max(case when g > 1 then date end) l from d group by 1)
    select d.user_id, d.date, value, spread, n_notes, g n_geometries, g > 1 cross_checked,
      case when n_notes = 0 then 'no_coverage' when g > 1 then 'cross_checked' when d.date < f then 'single_geometry_oldest'
        when d.date > l then 'single_geometry_newest' else 'single_geometry_interior' end evidence_class from d join b on b.user_id = d.user_id""")
def i04(v):
    rows = v.table("events").select(
        "user_id", F.to_date("ts").alias("date"), F.col("event_type").alias("doc"), F.length("event_type").alias("geometry"), "value"
    )
    return vintage.stitch(rows, ["user_id"], "date", "daily", "doc", "geometry", "value")


@query("e12_evidence_class_counts", "evidence_class n:int", f"""
    with o as (select user_id, date, count(distinct geometry) g from {STITCH_SOURCE} group by 1, 2),
    s as (select user_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) date from o group by 1),
    d as (select s.user_id, s.date, coalesce(g, 0) g from s left join o on o.user_id = s.user_id and o.date = s.date),
    b as (select user_id, min(case when g > 1 then date end) f, max(case when g > 1 then date end) l from d group by 1)
    select case when g = 0 then 'no_coverage' when g > 1 then 'cross_checked' when d.date < f then 'single_geometry_oldest'
        when d.date > l then 'single_geometry_newest' else 'single_geometry_interior' end evidence_class, count(*) n from d join b on b.user_id = d.user_id group by 1""")
def e12(v):
    return i04(v).groupBy("evidence_class").agg(F.count("*").alias("n"))


@query("i05_wide_slots", "date:date field n_readings:int r1_doc:int r1_value:num r2_doc:num r2_value:num r12_doc:num", """
    with d as (select date, field, doc, avg(value) x, row_number() over (partition by date, field order by doc) r from readings group by 1, 2, 3)
    select date, field, count(*) n_readings, max(case when r = 1 then doc end) r1_doc, max(case when r = 1 then x end) r1_value,
      max(case when r = 2 then doc end) r2_doc, max(case when r = 2 then x end) r2_value, max(case when r = 12 then doc end) r12_doc from d group by 1, 2""")
def i05(v):
    one = v.readings.groupBy("date", "field", "doc").agg(F.avg("value").alias("value"))
    return vintage.to_slots(one, ["date", "field"], "doc", "value", 12)


@query("i05_slots_back_to_long", "date:date field doc:int value:num", "select date, field, doc, avg(value) as value from readings group by 1, 2, 3")
def i05b(v):
    one = v.readings.groupBy("date", "field", "doc").agg(F.avg("value").alias("value"))
    # five slots for twelve documents: the others go round behind them
    return vintage.from_slots(vintage.to_slots(one, ["date", "field"], "doc", "value", 5), ["date", "field"], 5)


ONE = "(select doc, date, field, avg(value) as value from readings group by 1, 2, 3)"


def _one(v):
    return v.readings.groupBy("doc", "date", "field").agg(F.avg("value").alias("value"))


@query("i06_redecode_agreement", "doc:int date:date field problem new_value:num", f"""
    select doc, date, field, case when doc = 11 then 'missing' else 'differs' end problem,
      value + case when day(date) = 7 then 0.5 else 0.0 end new_value from {ONE} where doc = 11 or day(date) = 7""")
def i06(v):
    stored = _one(v).filter("doc <> 11")
    new = _one(v).withColumn("value", F.col("value") + F.when(F.dayofmonth("date") == 7, 0.5).otherwise(0.0))
    return vintage.agreement(new, stored, ["doc", "date", "field"], "value", 0.01)


@query("i07_merge_stored_decode", "doc:int n:int total:num3", f"select doc, count(*) n, sum(case when doc < 9 then value else value + 1 end) total from {ONE} group by 1")
def i07(v):
    stored = _one(v).filter("doc < 9")
    new = _one(v).withColumn("value", F.col("value") + 1)
    return vintage.merge_stored(stored, new, "doc").groupBy("doc").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


SWAP = """(select a.m, a.spread h, b.spread x, coalesce(b.spread > a.spread, false) disputed from spreads a join spreads b on b.m = a.m and b.product = 'SMALL' where a.product = 'LARGE')"""


def swapped(v):
    wide = v.spreads.groupBy("m").agg(
        F.max(F.when(F.col("product") == "LARGE", F.col("spread"))).alias("h"),
        F.max(F.when(F.col("product") == "SMALL", F.col("spread"))).alias("x"),
        F.count_if(F.col("product").isin("LARGE", "SMALL")).alias("rows"),
    ).filter("rows = 2").drop("rows")  # both products have a row in the month, be its value missing or not
    return vintage.substitute_disputed(wide, "h", "x")


@query("i08_row_swap_substitute", "m:date disputed:bool substituted:num sign_changes:str", f"""
    select m, disputed, case when disputed then x else h end substituted, sign(h) <> sign(case when disputed then x else h end) sign_changes from {SWAP}""")
def i08(v):
    return swapped(v).withColumn("sign_changes", F.signum("h") != F.signum("substituted"))


@query("i08_dispute_windows", "first:date last:date length:int", f"""
    with f as (select m, disputed, row_number() over (order by m) rn from {SWAP}), g as (select m, rn - row_number() over (order by m) g from f where disputed)
    select min(m) as first, max(m) as last, count(*) as length from g group by g""")
def i08w(v):
    return calendar_ops.runs_of(swapped(v), [], "m", F.col("disputed"))


@query("i09_provisional_month_rule", "product m:date provisional:bool", "select product, m, date_trunc('month', m) = date '2001-06-01' provisional from monthly")
def i09(v):
    return v.monthly.withColumn("provisional", vintage.provisional_month("m", "2001-06-17"))
