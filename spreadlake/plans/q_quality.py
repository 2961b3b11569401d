"""Validation, profiling and provenance queries."""

from pyspark.sql import functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.numeric import within
from spreadlake.operators import calendar_ops, quality
from spreadlake.plans.registry import query


def _orders(v):
    return v.table("orders").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"), "o_orderkey", "o_custkey", "o_orderstatus",
    )


ORDERS = """(select o_orderpriority series, cast(o_orderdate as date) date, o_totalprice value,
  o_orderkey, o_custkey, o_orderstatus from orders)"""


@query(
    "b01_validate_frame",
    "series rows:int empty_dates:int duplicate_dates:int order_breaks:int outside_value:int observations_value:int problems",
    f"""
    with o as (select *, lag(date) over (partition by series order by o_orderkey) prev from {ORDERS}),
    d as (select series, date, count(*) c from o group by 1, 2),
    dup as (select series, count(*) filter (where c > 1) duplicate_dates from d group by 1),
    a as (select series, count(*) rows, count(*) filter (where date is null) empty_dates,
      count(*) filter (where date < prev) order_breaks,
      count(*) filter (where value < 1000 or value > 400000) outside_value, count(value) observations_value
      from o group by 1)
    select a.*, duplicate_dates,
      concat_ws(';', case when duplicate_dates > 0 then 'duplicate_dates' end,
        case when order_breaks > 0 then 'dates_not_increasing' end,
        case when outside_value > 0 then 'outside_bounds_value' end,
        case when observations_value < 3000 then 'too_few_observations_value' end) problems
    from a join dup using (series)
    """,
)
def b01(v):
    spec = quality.Spec(
        required=("value",), bounds={"value": (1000.0, 400000.0)}, min_observations={"value": 3000}, position="o_orderkey"
    )
    return quality.validate(_orders(v), ["series"], spec).withColumn("problems", F.array_join("problems", ";"))


@query(
    "b02_shrink_against_previous",
    "series rows_old:int rows_new:int value_old:int value_new:int shrunk",
    f"""
    with o as (select series, count(*) rows_old, count(value) value_old from {ORDERS} group by 1),
    n as (select series, count(*) rows_new, count(case when value < 450000 then value end) value_new
          from {ORDERS} where not (series = '1-URGENT' and o_orderstatus = 'P') group by 1)
    select series, rows_old, rows_new, value_old, value_new,
      concat_ws(';', case when coalesce(rows_new,0) < rows_old then 'rows' end,
                case when coalesce(value_new,0) < value_old then 'value' end) shrunk
    from o full join n using (series)
    """,
)
def b02(v):
    old = _orders(v)
    new = old.filter("not (series = '1-URGENT' and o_orderstatus = 'P')").withColumn(
        "value", F.when(F.col("value") < 450000, F.col("value"))
    )
    return quality.shrink_check(new, old, ["series"], ["value"]).withColumn("shrunk", F.array_join("shrunk", ";"))


@query(
    "b03_domain_bounds",
    "product price_out:int rows:int",
    """select product, count(*) filter (where price < 100 or price > 4000) price_out, count(*) as rows
       from quotes group by 1""",
)
def b03(v):
    return v.quotes.groupBy("product").agg(
        F.count_if(~within("price", 100.0, 4000.0)).alias("price_out"), F.count("*").alias("rows")
    )


@query(
    "b04_late_start",
    "area flow declared_first:date first_observation:date late:bool",
    """select area, flow, date '1995-03-01' declared_first, min(m) first_observation,
       min(m) > date '1995-03-01' late from long_stats group by 1, 2""",
)
def b04(v):
    declared = v.long_stats.select("area", "flow").distinct().withColumn("declared_first", F.lit("1995-03-01").cast("date"))
    return quality.late_start(v.long_stats, declared, ["area", "flow"], "m", "v")


@query(
    "b05_unknown_codes",
    "code rows:int",
    "select code, count(*) as rows from long_stats where code not in ('1','2') group by 1",
)
def b05(v):
    return quality.unknown_codes(v.long_stats, "code", v.values("('1'),('2')", "code"))


@query(
    "b05_duplicate_composite_key",
    "o_custkey:int date:date rows:int",
    f"select o_custkey, date, count(*) as rows from {ORDERS} group by 1, 2 having count(*) > 1",
)
def b05_dup(v):
    return quality.duplicate_keys(_orders(v), ["o_custkey", "date"])


def _gap_counts(df, keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("gap").alias("first_gap"), F.max("gap").alias("last_gap"))


def _gap_sql(source, keys, anchor, step, keep=""):
    return f"""
    with p as (select distinct {keys}, {anchor} d from {source}),
    s as (select {keys}, min(d) a, max(d) b from p group by all),
    e as (select {keys}, cast(unnest(generate_series(a, b, interval {step})) as date) d from s)
    select {keys}, count(*) n, min(d) first_gap, max(d) last_gap from e anti join p using ({keys}, d) {keep} group by all
    """


AREA_ORDERS = """(select n_name area, o_orderpriority flow, cast(o_orderdate as date) date, o_custkey from orders
  join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"""


def _area_orders(v):
    return v.orders_by_area.select("area", F.col("o_orderpriority").alias("flow"), F.to_date("o_orderdate").alias("date"), "o_custkey")


@query("b06_gaps_daily", "area n:int first_gap:date last_gap:date",
       _gap_sql(AREA_ORDERS, "area", "date", "1 day", "where isodow(d) < 6"))
def b06(v):
    return _gap_counts(calendar_ops.gaps(_area_orders(v), ["area"], "date", "daily"), ["area"])


@query("b07_gaps_weekly", "area flow n:int first_gap:date last_gap:date",
       _gap_sql(AREA_ORDERS, "area, flow", "cast(date_trunc('week', date) as date)", "7 day"))
def b07(v):
    return _gap_counts(calendar_ops.gaps(_area_orders(v), ["area", "flow"], "date", "weekly"), ["area", "flow"])


@query("b08_gaps_monthly", "area flow gap:date", f"""
    with p as (select distinct area, flow, cast(date_trunc('month', date) as date) d from {AREA_ORDERS}),
    s as (select area, flow, min(d) a, max(d) b from p group by all),
    e as (select area, flow, cast(unnest(generate_series(a, b, interval 1 month)) as date) d from s)
    select area, flow, d gap from e anti join p using (area, flow, d)""")
def b08(v):
    return calendar_ops.gaps(_area_orders(v), ["area", "flow"], "date", "monthly")


@query("b08_gaps_annual", "o_custkey:int gap:date", f"""
    with p as (select distinct o_custkey, cast(date_trunc('year', date) as date) d from {AREA_ORDERS}),
    s as (select o_custkey, min(d) a, max(d) b from p group by all),
    e as (select o_custkey, cast(unnest(generate_series(a, b, interval 1 year)) as date) d from s)
    select o_custkey, d gap from e anti join p using (o_custkey, d)""")
def b08a(v):
    return calendar_ops.gaps(_area_orders(v), ["o_custkey"], "date", "annual")


PROFILE = f"""
    with p as (select distinct area, flow, m d from long_stats),
    s as (select area, flow, min(d) a, max(d) b from p group by all),
    e as (select area, flow, cast(unnest(generate_series(a, b, interval 1 month)) as date) d from s),
    g as (select area, flow, count(*) gap_count, min(d) first_gap, max(d) last_gap from e anti join p using (area, flow, d) group by all),
    base as (select area, flow, count(*) file_rows, count(v) observations, min(m) first_date, max(m) last_date, max(strftime(m, '%Y-%m') || '/' || code) vintage from long_stats group by all),
    f as (select area, flow, m, bool_or(code = '3') f from long_stats where v is not null group by all),
    cl as (select area, flow, max(m) filter (where not f) c from f group by all),
    pv as (select f.area, f.flow, min(m) provisional_from from f join cl on cl.area = f.area and cl.flow = f.flow where f and (c is null or m > c) group by all)
    select base.*, coalesce(gap_count, 0) gap_count, first_gap, last_gap, provisional_from, case when flow in ('1-URGENT', '2-HIGH') then 'published' else 'computed' end as method,
      case when observations = 0 then 'failed' when last_date < date '2001-08-01' then 'stale' else 'ok' end status
    from base left join g using (area, flow) left join pv using (area, flow)
"""
PROFILE_COLUMNS = "area flow file_rows:int observations:int first_date:date last_date:date gap_count:int first_gap:date last_gap:date vintage provisional_from:date method status"


def profile_frame(v):
    rows = v.long_stats.withColumn("edition", F.concat_ws("/", F.date_format("m", "yyyy-MM"), "code")).withColumn("estimated", F.col("code") == "3")
    methods = v.values("('1-URGENT','published'),('2-HIGH','published'),('3-MEDIUM','computed'),('4-NOT SPECIFIED','computed'),('5-LOW','computed')", "flow, method")
    return quality.profile(
        rows, ["area", "flow"], "m", "v", "monthly", stale_before="2001-08-01", vintage="edition", flag="estimated", declared=methods
    )


@query("b09_series_profile", PROFILE_COLUMNS, PROFILE)
def b09(v):
    return profile_frame(v)


@query("b10_manifest_upsert", "o_custkey:int n:int last_date:date", f"""
    with a as (select o_custkey, count(*) n, max(date) last_date from {ORDERS} where date < date '1999-01-01' group by 1),
    b as (select o_custkey, count(*) n, max(date) last_date from {ORDERS} where date >= date '2001-01-01' group by 1)
    select * from a anti join b using (o_custkey) union all select * from b""")
def b10(v):
    def rows(df):
        return df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))

    o = _orders(v)
    return quality.upsert(rows(o.filter("date < '1999-01-01'")), rows(o.filter("date >= '2001-01-01'")), ["o_custkey"])


REGISTRY_SQL = """(select 'S' || user_id series, case user_id % 7 when 0 then 'fine' else 'ok' end status, case when user_id % 11 = 3 then null else 'published' end method,
    case when user_id % 13 <> 5 then user_id % 3 <> 0 end publish, user_id % 2 = 0 machine_fetched, case when user_id % 4 < 2 then '2024-01-01' end fetched_at,
    case when user_id % 5 <> 0 then 'licence' end withheld_reason, count(*) n from events group by user_id)"""
REGISTRY_REASON = """case when status <> 'ok' then 'unknown_status' when method is null then 'unknown_method' when publish is null then 'publish_not_stated'
    when not machine_fetched and fetched_at is not null then 'fetch_time_on_a_hand_made_series' when not publish and withheld_reason is null then 'withheld_without_a_reason' end"""


def _registry(v):
    u = F.col("user_id")
    entries = v.table("events").groupBy("user_id").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("S"), u.cast("string")).alias("series"), F.when(u % 7 == 0, "fine").otherwise("ok").alias("status"),
        F.when(u % 11 != 3, "published").alias("method"), F.when(u % 13 != 5, u % 3 != 0).alias("publish"), (u % 2 == 0).alias("machine_fetched"),
        F.when(u % 4 < 2, "2024-01-01").alias("fetched_at"), F.when(u % 5 != 0, "licence").alias("withheld_reason"), "n",
    )
    stored = entries.filter("n % 2 = 0").withColumn("n", F.lit(0).cast("long"))
    return quality.register(stored, entries)


@query("b10_registry_rules", "series n:int", f"""
    with e as (select *, {REGISTRY_REASON} reason from {REGISTRY_SQL}) select series, case when reason is null then n else 0 end n from e where reason is null or n % 2 = 0""")
def b10_rules(v):
    return _registry(v)[0]


@query("b10_registry_refusals", "series reason", f"select series, reason from (select *, {REGISTRY_REASON} reason from {REGISTRY_SQL}) where reason is not null")
def b10_refused(v):
    return _registry(v)[1]


@query("b01_missing_column_is_a_problem", "user_id:int rows:int problems", "select user_id, count(*) as rows, 'missing_column_price' problems from events group by 1")
def b01_missing(v):
    rows = v.table("events").select("user_id", F.to_date("ts").alias("date"), "value")
    out = quality.validate(rows, ["user_id"], quality.Spec(required=("value", "price")))
    return out.withColumn("problems", F.array_join("problems", ";"))


@query("b24_waterfall_end_rules", "m:date step:int reason", """
    with c as (select s.m, s.product, y.yield * s.spread c from spreads s join yields y on y.product = s.product where s.spread is not null),
    r as (select m, product, row_number() over w step, sum(c) over w e, c from c window w as (partition by m order by c desc, product rows unbounded preceding))
    select m, step, case when month(m) = 2 and step = 2 then 'end_is_not_start_plus_value' when month(m) = 2 and step = 3 then 'start_is_not_the_end_before' end reason
    from r where month(m) = 2 and step in (2, 3)
    union all select m, max(step) + 1, 'total_is_not_the_running_total' from r where month(m) = 5 group by m""")
def b24_ends(v):
    from spreadlake.operators.margin import waterfall

    rows = v.spreads.join(v.yields, "product").withColumn("c", F.col("yield") * F.col("spread")).filter("c is not null")
    steps = waterfall(rows, ["m"], "product", "c").select("m", "step", "start", "end", F.col("c"), F.lit("part").alias("kind"))
    steps = steps.withColumn("end", F.when((F.month("m") == 2) & (F.col("step") == 2), F.col("end") + 1).otherwise(F.col("end")))
    total = rows.groupBy("m").agg(F.count("*").cast("int").alias("n"), F.sum("c").alias("t"))
    wrong = F.when(F.month("m") == 5, 3.0).otherwise(0.0)
    total = total.select("m", (F.col("n") + 1).alias("step"), F.lit(0.0).alias("start"), (F.col("t") + wrong).alias("end"), F.lit(None).cast("double").alias("c"), F.lit("total").alias("kind"))
    return quality.waterfall_breaks(steps.unionByName(total), ["m"], "step", "start", "end", 1e-5, value="c", kind="kind")


@query("b11_guarded_append", "series n:int", f"""
    with o as (select * from {ORDERS}),
    f as (select series, count(*) c from o where date >= date '2000-01-01' group by 1)
    select series, count(*) n from o join f using (series)
    where date < date '2000-01-01' or (c >= 700 and series <> '5-LOW') group by 1""")
def b11(v):
    # the 5-LOW batch arrives with a broken date, so it must keep its stored rows
    o = _orders(v).select("series", F.col("date").cast("string").alias("date"), "value")
    broken = F.when(F.col("series") == "5-LOW", F.lit("n.a.")).otherwise(F.col("date"))
    new = o.filter("date >= '2000-01-01'").withColumn("date", broken)
    per_day = quality.Spec(min_rows=700, unique_dates=False)
    merged, _ = quality.guarded_append(o.filter("date < '2000-01-01'"), new, ["series"], per_day)
    return merged.groupBy("series").agg(F.count("*").alias("n"))


@query("b12_carry_forward", "o_custkey:int low:num2 n:int", f"""
    with a as (select o_custkey, min(case when o_orderstatus='P' then value end) low, count(*) n from {ORDERS} where date >= date '2000-01-01' group by 1),
    b as (select o_custkey, min(case when o_orderstatus='P' then value end) low from {ORDERS} where date < date '2000-01-01' group by 1)
    select a.o_custkey, coalesce(a.low, b.low) low, a.n from a left join b using (o_custkey)""")
def b12(v):
    o = _orders(v).withColumn("p", F.when(F.col("o_orderstatus") == "P", F.col("value")))
    new = o.filter("date >= '2000-01-01'").groupBy("o_custkey").agg(F.min("p").alias("low"), F.count("*").alias("n"))
    old = o.filter("date < '2000-01-01'").groupBy("o_custkey").agg(F.min("p").alias("low"))
    return quality.carry_forward(new, old, ["o_custkey"], ["low"])


@query("b13_change_detection", "o_custkey:int change", f"""
    with a as (select o_custkey, count(*) n, min(value) low from {ORDERS} where date >= date '1995-03-01' group by 1),
    b as (select o_custkey, count(*) n, min(value) low from {ORDERS} where date < date '2001-06-01' group by 1)
    select coalesce(a.o_custkey, b.o_custkey) o_custkey,
      case when b.o_custkey is null then 'added' when a.o_custkey is null then 'removed' else 'changed' end change
    from a full join b on a.o_custkey = b.o_custkey
    where b.o_custkey is null or a.o_custkey is null or a.n <> b.n or a.low <> b.low""")
def b13(v):
    def rows(df):
        return df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("date").alias("fetched"))

    o = _orders(v)
    return quality.changed_rows(
        rows(o.filter("date >= '1995-03-01'")), rows(o.filter("date < '2001-06-01'")), ["o_custkey"], volatile=["fetched"]
    )


AREA_MONTH = "(select area, m, max(case when code = '3' then 1 else 0 end) = 1 flagged from long_stats group by 1, 2)"
TAIL = f"""(select area, min(m) provisional_from from {AREA_MONTH} x
   where m > coalesce((select max(m) from {AREA_MONTH} y where y.area = x.area and not y.flagged), date '0001-01-01') group by 1)"""


def _area_month(v):
    return v.long_stats.groupBy("area", "m").agg(F.bool_or(F.col("code") == "3").alias("flagged"))


@query("b14_provisional_tail", "area provisional_from:date",
       f"select a.area, provisional_from from (select distinct area from long_stats) a left join {TAIL} t on t.area = a.area")
def b14(v):
    return quality.provisional_from(_area_month(v), ["area"], "m", "flagged")


@query("b15_status_word", "area m:date status", f"""
    select a.area, a.m, case when provisional_from is not null and a.m >= provisional_from then 'provisional'
      when a.area in ('NATION_1','NATION_2') then 'reconstructed' else 'final' end status
    from {AREA_MONTH} a left join {TAIL} t on t.area = a.area""")
def b15(v):
    months = _area_month(v)
    prof = quality.provisional_from(months, ["area"], "m", "flagged").withColumn(
        "method", F.when(F.col("area").isin("NATION_1", "NATION_2"), "reconstructed").otherwise("fetched")
    )
    return months.join(prof, "area").withColumn("status", quality.status_word("m", "provisional_from", "method"))


@query("b16_table_digest", "rows:int first_margin:num last_margin:num first_bench:num last_bench:num",
       """select count(*) as rows, min_by(margin, m) first_margin, max_by(margin, m) last_margin,
          min_by(bench, m) first_bench, max_by(bench, m) last_bench from margins""")
def b16(v):
    return quality.digest(v.margins, "m", ["margin", "bench"])


@query("b13_value_moves_across_null", "m:date change", "select m, 'changed' as change from margins where month(m) = 5 and margin is not null")
def b13_null(v):
    old = v.margins.select("m", F.when(F.month("m") != 5, F.lit(1.0)).alias("a"), "margin")
    moved = F.month("m") == 5
    new = old.select("m", F.when(moved, F.col("margin")).otherwise(F.col("a")).alias("a"), F.when(~moved, F.col("margin")).alias("margin"))
    return quality.changed_rows(new, old, ["m"])


@query("b16_digest_sees_moved_null", "same_rows:bool same_hash:bool", "select true same_rows, false same_hash")
def b16_null(v):
    # month means are never empty, unlike margins, so a value does move across the null
    means = v.monthly.select("product", "m", F.col("v").alias("margin"))
    rows = means.select("product", "m", F.lit(None).cast("double").alias("a"), "margin")
    moved = means.select("product", "m", F.col("margin").alias("a"), F.lit(None).cast("double").alias("margin"))
    one, other = (quality.digest(x, "m", ["a"]).select("rows", "content_hash") for x in (rows, moved))
    both = one.withColumn("k", F.lit(1)).join(other.select(F.col("rows").alias("r"), F.col("content_hash").alias("h")).withColumn("k", F.lit(1)), "k")
    return both.select((F.col("rows") == F.col("r")).alias("same_rows"), (F.col("content_hash") == F.col("h")).alias("same_hash"))


@query("b17_anchor_reproduction", "product m:date printed:num verdict", """
    with a as (select product, cast(case when n % 10 = 0 then m + interval 40 year else m end as date) m,
                      floor(v * 100) / 100 printed from monthly)
    select a.product, a.m, a.printed, case when t.v is null then 'absent'
      when round_even(t.v, 2) = a.printed then 'reproduced' else 'differs' end verdict
    from a left join monthly t on t.product = a.product and t.m = a.m""")
def b17(v):
    shifted = F.when(F.col("n") % 10 == 0, F.add_months("m", 480)).otherwise(F.col("m"))
    anchors = v.monthly.select("product", shifted.alias("m"), (F.floor(F.col("v") * 100) / 100).alias("printed"))
    return quality.anchors_reproduced(anchors, v.monthly, ["product", "m"], "v")


def _side(v, letter, grain_col, min_obs=0):
    q = v.quotes.filter(F.substring("market", 1, 1) == letter).withColumn("t", grain_col)
    return q.groupBy("product", "t").agg(F.avg("price").alias("v"), F.count("*").alias("n")).withColumn(
        "v", F.when(F.col("n") >= min_obs, F.col("v"))
    )


@query("b18_two_source_reconciliation", "product shared:int max_abs_diff:num worst_date:date left_only:int right_only:int", """
    with a as (select product, date t, avg(price) v from quotes where market like 'A%' group by 1, 2),
    b as (select product, date t, avg(price) v from quotes where market like 'R%' group by 1, 2),
    j as (select coalesce(a.product, b.product) product, coalesce(a.t, b.t) t, a.v a, b.v b, abs(a.v - b.v) d
          from a full join b on a.product = b.product and a.t = b.t)
    select product, count(d) shared, max(d) max_abs_diff, (array_agg(t order by d desc nulls last, t))[1] worst_date,
      count(*) filter (where a is not null and b is null) left_only,
      count(*) filter (where a is null and b is not null) right_only from j group by 1""")
def b18(v):
    return quality.reconcile(_side(v, "A", F.col("date")), _side(v, "R", F.col("date")), ["product"], "t", "v")


@query("b19_calendar_disagreement", "product n_both:int left_only:int right_only:int neither:int", """
    with a as (select product, date_trunc('month', date) t, case when count(*) >= 30 then avg(price) end v from quotes where market like 'A%' group by 1, 2),
    b as (select product, date_trunc('month', date) t, case when count(*) >= 30 then avg(price) end v from quotes where market like 'R%' group by 1, 2)
    select product, count(*) filter (where a.v is not null and b.v is not null) n_both,
      count(*) filter (where a.v is not null and b.v is null) left_only,
      count(*) filter (where a.v is null and b.v is not null) right_only,
      count(*) filter (where a.v is null and b.v is null) neither
    from a join b using (product, t) group by 1""")
def b19(v):
    month = cal.month_start("date")
    out = quality.calendar_disagreement(_side(v, "A", month, 30), _side(v, "R", month, 30), ["product"], "t", "v")
    return out.withColumnRenamed("both", "n_both")


AB = """a as (select product, cast(date_trunc('month', date) as date) t, avg(price) v from quotes where market like 'A%' group by 1, 2),
    b as (select product, cast(date_trunc('month', date) as date) t, avg(price) v from quotes where market like 'R%' group by 1, 2)"""


@query("b20_tolerance_share", "product share:num n:int", f"""
    with {AB} select product, avg(case when abs(a.v - b.v) <= 300 then 1.0 else 0.0 end) share, count(*) n
    from a join b using (product, t) group by 1""")
def b20(v):
    month = cal.month_start("date")
    rows = quality.tolerance_check(_side(v, "A", month), _side(v, "R", month), ["product", "t"], "v", 300.0)
    return rows.groupBy("product").agg(F.avg(F.col("within").cast("double")).alias("share"), F.count("*").alias("n"))


@query("b20_tolerance_outliers", "product t:date difference:num", f"""
    with {AB} select product, t, a.v - b.v difference from a join b using (product, t) where abs(a.v - b.v) > 300""")
def b20_out(v):
    month = cal.month_start("date")
    rows = quality.tolerance_check(_side(v, "A", month), _side(v, "R", month), ["product", "t"], "v", 300.0)
    return rows.filter(~F.col("within"))


@query("b21_low_print_report", "product year:int days:int first:date last:date low:num", """
    with d as (select product, date, avg(price) v from quotes group by 1, 2)
    select product, year(date) as year, count(*) as days, min(date) as first, max(date) as last, min(v) low
    from d where v < 700 group by 1, 2""")
def b21(v):
    day = v.quotes.groupBy("product", "date").agg(F.avg("price").alias("v"))
    return quality.extreme_prints(day, ["product"], "date", "v", 700.0)


@query("b22_flat_bars", "user_id:int flat_bars:int zero_volume_bars:int first_non_flat_bar:date first_bar_with_volume:date", """
    with bars as (select user_id, cast(ts as date) date, min_by(value, ts) o, max(value) h, min(value) l, max_by(value, ts) c,
                  count(*) - 1 vol from events group by 1, 2)
    select user_id, count(*) filter (where o = h and h = l and l = c) flat_bars, count(*) filter (where vol = 0) zero_volume_bars,
      min(case when not (o = h and h = l and l = c) then date end) first_non_flat_bar,
      min(case when vol <> 0 then date end) first_bar_with_volume from bars group by 1""")
def b22(v):
    bars = v.table("events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"),
        F.max_by("value", "ts").alias("c"), (F.count("*") - 1).alias("vol"),
    )
    return quality.flat_bars(bars, ["user_id"])


@query("b23_roll_jumps", "series date:date previous_date:date percent:num sessions_to_month_end:int", """
    with x as (select *, lag(date) over w previous_date, lag(c) over w pc,
        row_number() over (partition by series, date_trunc('month', date) order by date desc) - 1 sessions_to_month_end
        from ohlc window w as (partition by series order by date))
    select series, date, previous_date, 100.0 * (c - pc) / pc percent, sessions_to_month_end from x
    where abs(100.0 * (c - pc) / pc) >= 30""")
def b23(v):
    return quality.roll_jumps(v.ohlc, ["series"], "date", "c", 30.0)


@query("b24_waterfall_integrity", "m:date step:int start:num end_:num", """
    with c as (select s.m, s.product, y.yield * s.spread c from spreads s join yields y on y.product = s.product where s.spread is not null),
    r as (select m, product, row_number() over w step, sum(c) over w e, c from c
          window w as (partition by m order by c desc, product rows unbounded preceding)),
    t as (select m, step, round(e - c, 0) start, e end_ from r),
    u as (select *, coalesce(lag(end_) over (partition by m order by step), 0) expected from t)
    select m, step, start, end_ from u where abs(start - expected) > 0.25""")
def b24(v):
    from spreadlake.operators.margin import waterfall

    rows = v.spreads.join(v.yields, "product").withColumn("c", F.col("yield") * F.col("spread")).filter("c is not null")
    steps = waterfall(rows, ["m"], "product", "c").withColumn("start", F.round("start", 0)).withColumnRenamed("end", "end_")
    return quality.waterfall_breaks(steps, ["m"], "step", "start", "end_", tolerance=0.25)


EVENT_TABLE = """(select cast(user_id as varchar) || event_type || cast(cast(floor(value) as int) as varchar) event_id, event_type kind,
   case when event_id % 2 = 0 then 'day' else 'month' end date_precision,
   case when event_id % 3 = 0 then strftime(ts, '%Y-%m') else strftime(ts, '%Y-%m-%d') end date_text,
   case when event_id % 5 = 0 then '' else 'https://example.org' end source_url from events)"""


@query("b25_event_table_check", "reason n:int", f"""
    with e as (select * from {EVENT_TABLE}), d as (select event_id from e group by 1 having count(*) > 1),
    t as (select case when trim(e.event_id) = '' then 'no_id' when d.event_id is not null then 'duplicate_id'
      when kind not in ('click','view','purchase','error') then 'unknown_kind'
      when date_precision = 'day' and length(date_text) <> 10 then 'date_not_a_day'
      when date_precision = 'month' and length(date_text) <> 7 then 'date_not_a_month'
      when source_url = '' then 'no_url' end reason from e left join d on d.event_id = e.event_id)
    select reason, count(*) n from t group by 1""")
def b25(v):
    i = F.col("event_id")
    rows = v.table("events").select(
        F.concat(F.col("user_id").cast("string"), "event_type", F.col("value").cast("int").cast("string")).alias("id"),
        F.col("event_type").alias("kind"),
        F.when(i % 2 == 0, "day").otherwise("month").alias("date_precision"),
        F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date_text"),
        F.when(i % 5 == 0, "").otherwise("https://example.org").alias("source_url"),
    ).withColumnRenamed("id", "event_id")
    return quality.event_problems(rows, ["click", "view", "purchase", "error"]).groupBy("reason").agg(F.count("*").alias("n"))


REGISTRY_DIM = "('click',true,''),('view',true,''),('purchase',false,'licence'),('error',false,'')"


@query("b26_publishable_rows", "series n:int", "select series, count(*) n from daily where series in ('click','view') group by 1")
def b26(v):
    shown, _ = quality.publishable(v.daily, v.values(REGISTRY_DIM, "series, publish, withheld_reason"))
    return shown.groupBy("series").agg(F.count("*").alias("n"))


@query("b26_withheld_without_reason", "series n:int", "select series, count(*) n from daily where series = 'error' group by 1")
def b26_silent(v):
    _, silent = quality.publishable(v.daily, v.values(REGISTRY_DIM, "series, publish, withheld_reason"))
    return v.daily.join(silent, "series", "left_semi").groupBy("series").agg(F.count("*").alias("n"))


@query("h02_expected_minus_present", "area m:date", """
    with all_months as (select distinct m from long_stats), areas as (select distinct area from long_stats where code = '3'),
    span as (select area, min(m) a, max(m) b from long_stats where code = '3' group by 1),
    e as (select area, cast(unnest(generate_series(a, b, interval 1 month)) as date) m from span)
    select area, m from e except select area, m from long_stats where code = '3'""")
def h02(v):
    flagged = v.long_stats.filter("code = '3'")
    span = flagged.groupBy("area").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    expected = span.select("area", F.explode(F.sequence("a", "b", cal.step("monthly"))).alias("m"))
    return calendar_ops.expected_minus_present(expected, flagged, ["area", "m"])
