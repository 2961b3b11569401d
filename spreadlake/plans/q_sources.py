"""Scans and sinks: what each one reads is derived from the given tables."""

from pyspark.sql import functions as F

from spreadlake.plans.registry import query
from spreadlake.session import shared_dir
from spreadlake.sources import corpus, scans, sinks


@query("a01_series_scan", "area flow m:date v:num2", "select area, flow, m, sum(v) v from long_stats group by 1, 2, 3")
def a01(v):
    path = shared_dir(v.spark, "series")
    v.long_stats.groupBy("area", "flow", "m").agg(F.sum("v").alias("v")).write.option("header", True).csv(path)
    return scans.read_series(v.spark, path, "area string, flow string, m date, v double", fmt="csv")


def _daily_csv(v):
    """Orders as a printed daily file: a date, a value with missing tokens and some junk."""
    path = shared_dir(v.spark, "daily_csv")
    k = F.col("o_orderkey")
    cell = F.when(k % 17 == 0, ".").when(k % 29 == 0, "n.a. see note").otherwise(F.col("o_totalprice").cast("string"))
    stamp = F.when(k % 97 == 0, "31/12/99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    v.table("orders").select(
        k.cast("string").alias("row_id"), stamp.alias("observation_date"), cell.alias("TOTALPRICE")
    ).write.option("header", True).csv(path)
    return scans.scan_daily_csv(
        v.spark, path, ["observation_date", "DATE"], ["totalprice"], keep=["row_id"]
    )


CSV = """(select o_orderkey k, cast(o_orderdate as date) date,
  case when o_orderkey % 17 = 0 then null else o_totalprice end v,
  case when o_orderkey % 97 = 0 then 'bad_date' when o_orderkey % 17 <> 0 and o_orderkey % 29 = 0 then 'bad_value' end reason from orders)"""


@query("a02_daily_csv_rows", "date:date n:int missing:int total:num2",
       f"select date, count(*) n, count(*) - count(v) missing, sum(v) total from {CSV} where reason is null group by 1")
def a02(v):
    rows, _ = _daily_csv(v)
    return rows.groupBy("date").agg(
        F.count("*").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.sum("value").alias("total")
    )


@query("a02_daily_csv_quarantine", "row_id reason", f"select cast(k as varchar) row_id, reason from {CSV} where reason is not null")
def a02_bad(v):
    _, bad = _daily_csv(v)
    return bad


def _stats_files(v):
    path = shared_dir(v.spark, "long_stats")
    s = v.long_stats
    year = F.year("m")
    rows = s.select(
        F.col("area").alias("ref_area"), F.date_format("m", "yyyy-MM").alias("time_period"),
        F.col("code").alias("product"), "flow",
        F.when(F.col("area") == "NATION_9", "KTONS").otherwise("KBD").alias("unit"),
        F.when(F.month("m") == 12, "x").otherwise(F.col("v").cast("decimal(20,2)").cast("string")).alias("obs_value"),
        F.col("code"),
        # a few rows sit in the file of the wrong year
        F.when((F.month("m") == 1) & (F.col("code") == "3"), year + 1).otherwise(year).alias("year"),
    )
    rows.repartition("year").write.partitionBy("year").option("header", True).csv(path)
    pairs = v.values("('1-URGENT','1'),('2-HIGH','2'),('3-MEDIUM','3')", "flow, product")
    return scans.scan_long_stats(
        v.spark, path, [f"NATION_{i}" for i in range(0, 12)], "KBD", pairs
    )


STATS = """(select area, flow, code, m, case when month(m) = 12 then null else v end v, month(m) = 1 and code = '3' wrong
  from long_stats where area in (select 'NATION_' || i from range(0, 12) t(i)) and area <> 'NATION_9'
  and (flow, code) in (('1-URGENT','1'),('2-HIGH','2'),('3-MEDIUM','3')))"""


@query("a03_long_stats_scan", "ref_area flow m:date value:num2", f"select area ref_area, flow, m, v as value from {STATS} where not wrong")
def a03(v):
    rows, _ = _stats_files(v)
    return rows


@query("a03_long_stats_rejects", "reason n:int", f"select 'year_not_of_file' reason, count(*) n from {STATS} where wrong having count(*) > 0")
def a03_bad(v):
    _, bad = _stats_files(v)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def _seed(v):
    """One seed document per customer segment and nation, written as JSON lines."""
    path = shared_dir(v.spark, "seed")
    c = v.table("customer")
    bucket = F.floor(F.col("c_custkey") / 1000).alias("bucket")  # at most a thousand figures in one document
    figure = F.struct(
        F.col("c_name").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"),
        F.when(F.col("c_custkey") % 13 == 0, "").otherwise("usd_bbl").alias("unit"),
        F.when(F.col("c_custkey") % 11 == 0, "").otherwise("https://example.org/f").alias("source_url"),
    )
    event = F.struct(
        F.col("c_name").alias("id"), F.lit("1999-01-01").alias("day"), F.col("c_mktsegment").alias("kind"),
        F.lit("https://example.org/e").alias("source_url"),
    )
    docs = c.groupBy("c_mktsegment", "c_nationkey", bucket).agg(
        F.collect_list(figure).alias("figures"), F.collect_list(event).alias("events"),
        F.map_from_arrays(F.array(F.lit("total")), F.array(F.sum("c_acctbal"))).alias("anchors"),
    ).withColumn("name", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")))
    docs.select("name", "figures", "anchors", "events").write.json(path)
    return scans.scan_seed(v.spark, path, multi_line=False)


SEED_REASON = """case when c_acctbal < 0 then 'no_value' when c_custkey % 13 = 0 then 'no_unit' when c_custkey % 11 = 0 then 'no_source_url' end"""


@query("a04_seed_figures", "key value:num2", f"select c_name as key, c_acctbal as value from customer where {SEED_REASON} is null")
def a04(v):
    return _seed(v)["figures"]


@query("a04_seed_rejects", "reason n:int", f"select {SEED_REASON} reason, count(*) n from customer where {SEED_REASON} is not null group by 1")
def a04_bad(v):
    return _seed(v)["rejected"].groupBy("reason").agg(F.count("*").alias("n"))


@query("a04_seed_events_and_anchors", "kind events:int anchors:num2", """
    select c_mktsegment kind, count(*) events, sum(c_acctbal) anchors from customer group by 1""")
def a04_events(v):
    parts = _seed(v)
    events = parts["events"].groupBy("kind").agg(F.count("*").alias("events"))
    anchors = parts["anchors"].groupBy(F.regexp_extract("name", r"^(.*)-\d+$", 1).alias("kind")).agg(F.sum("printed").alias("anchors"))
    return events.join(anchors, "kind")


def _bars(v):
    bars = v.ohlc.withColumn("t", F.timestamp_seconds(F.unix_date("date") * 86400 + 23 * 3600))
    thin = F.col("vol") % 7 == 0
    bars = bars.select("series", "t", *[F.when(~thin, F.col(c)).alias(c) for c in "ohlc"], "vol")
    echo = bars.filter("vol % 11 = 0").withColumn("t", F.col("t") + F.expr("interval 2 hours"))
    return scans.normalise_bars(bars.unionByName(echo), "t", "Europe/Paris", "2024-01-28", ["series"], list("ohlc"))


BARS = """(select series, date + 1 as day, c, vol from ohlc where vol % 7 <> 0 and date + 1 < date '2024-01-28')"""


@query("a05_zoned_bars", "series day:date c:num", f"select series, day, c from {BARS} where vol % 11 <> 0")
def a05(v):
    return _bars(v)[0]


@query("a05_zoned_bars_rejects", "series day:date reason n:int",
       f"select series, day, 'duplicate_day' reason, 2 n from {BARS} where vol % 11 = 0")
def a05_bad(v):
    return _bars(v)[1].groupBy("series", "day", "reason").agg(F.count("*").alias("n"))


@query("a06_quote_payload", "series day:date n:int close:num volume:int", """
    select event_type series, cast(ts as date) as day, count(*) n, sum(value) as close, sum(user_id) volume from events group by 1, 2""")
def a06(v):
    # one payload per hundred events and series, so a payload is bounded by its source page
    e = v.table("events").withColumn("page", F.floor(F.col("event_id") / 100))
    payloads = e.groupBy("event_type", "page").agg(
        F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value", "user_id"))).alias("q")
    ).select(
        F.col("event_type").alias("series"),
        F.to_json(F.struct(
            F.lit("UTC").alias("zone"),
            F.transform("q", lambda x: x["t"]).alias("timestamps"),
            F.transform("q", lambda x: x["value"]).alias("close"),
            F.transform("q", lambda x: x["user_id"]).alias("volume"),
        )).alias("payload"),
    )
    quotes = scans.explode_payload(payloads, "payload")
    return quotes.groupBy("series", F.to_date(F.timestamp_seconds("epoch")).alias("day")).agg(
        F.count("*").alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume")
    )


LINKS = r"""(select distinct page_id, href, trim(regexp_replace(
     replace(replace(translate(lower(regexp_replace(title, '<[^>]*>', '', 'g')),
       'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '€', 'eur'), '$', 'usd'), '\s+', ' ', 'g')) title
   from (select page_id,
     unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1)) href,
     unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 2)) title from pages))"""


@query("a07_page_links", "page_id:int href title", f"select * from {LINKS}")
def a07(v):
    return corpus.page_links(v.table("pages"), "page_id", "html")


@query("a07_wanted_titles", "page_id:int title status href", f"""
    with l as (select * from {LINKS}), w as (select page_id, unnest(['the','of','and','der','la']) title from pages),
    h as (select page_id, title, count(distinct href) c, min(href) href from l group by 1, 2)
    select w.page_id, w.title, case when c is null then 'missing' when c > 1 then 'ambiguous' else 'ok' end status,
      case when c = 1 then href end href from w left join h on h.page_id = w.page_id and h.title = w.title""")
def a07_wanted(v):
    pages = v.table("pages")
    return corpus.wanted_titles(corpus.page_links(pages, "page_id", "html"), pages, "page_id", ["the", "of", "and", "der", "la"])


@query("a07_missing_years", "lang year:int", r"""
    with p as (select regexp_extract(html, 'lang="(\w+)"', 1) lang, 1990 + page_id % 37 as year from pages)
    select lang, year from (select distinct lang from p), (select 1990 + i as year from range(0, 40) t(i))
    except select lang, year from p""")
def a07_years(v):
    p = v.table("pages").select(
        F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"), (1990 + F.col("page_id") % 37).cast("int").alias("year")
    )
    return corpus.missing_years(p, ["lang"], "year", 1990, 2029)


@query("a08_capture_ranking", "issue:int best candidates:int alternates", """
    with p as (select page_id % 24 issue, url, length(html) len, page_id,
       row_number() over (partition by page_id % 24 order by (url like 'https:%') desc, length(html) desc, page_id desc) r from pages)
    select issue, max(case when r = 1 then url end) best, count(*) candidates,
      concat_ws(' ', max(case when r = 2 then url end), max(case when r = 3 then url end)) alternates from p group by 1""")
def a08(v):
    p = v.table("pages").select((F.col("page_id") % 24).alias("issue"), "url", F.length("html").alias("len"), "page_id")
    out = corpus.rank_captures(p, ["issue"], F.col("url").startswith("https:"), "len", "page_id", "url")
    return out.withColumn("alternates", F.array_join("alternates", " "))


def _printed_pages(v):
    """One printed page per order: a running head, then one row per line item."""
    line = v.table("lineitem").join(
        v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"
    )
    revised = F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("")
    row = F.concat(
        F.initcap("p_type"), F.lit("  Oil ("), F.col("l_linenumber").cast("string"), F.lit("% S)   "),
        F.col("l_quantity").cast("int").cast("string"), F.lit("  –"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), revised,
    )
    rows = line.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))).alias("r")
    )
    months = F.element_at(F.array(*[F.lit(m) for m in corpus_months]), (F.col("l_orderkey") % 12 + 1).cast("int"))
    head = F.concat(F.lit("Monthly Report, "), months, F.lit(" "), (2000 + F.col("l_orderkey") % 20).cast("string"))
    body = F.array_join(F.concat(F.array(F.lit("In March 1999 prices fell"), head), F.transform("r", lambda x: x["row"])), "\n")
    return rows.select("l_orderkey", body.alias("body"))


# English month names in calendar order.
corpus_months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query("a09_table_rows", "label_key rows:int first_sum:num2 second_sum:num2 revised:int", """
    select lower(p_type) || 'oil(' || l_linenumber || '%s)' label_key, count(*) as rows,
      sum(floor(l_quantity)) first_sum, -sum(l_extendedprice) second_sum,
      count(*) filter (where l_linenumber % 2 = 0) revised
    from lineitem join part on p_partkey = l_partkey group by 1""")
def a09(v):
    rows = corpus.table_rows(_printed_pages(v), "l_orderkey", "body").filter("numbers = 2")
    return rows.groupBy("label_key").agg(
        F.count("*").alias("rows"), F.sum(F.col("values")[0]).alias("first_sum"), F.sum(F.col("values")[1]).alias("second_sum"),
        F.count_if("revised").alias("revised"),
    )


@query("a09_slot_lookup", "slot rows:int total:num2", """
    select case p_type when 'SMALL' then 'gasoil' else 'naphtha' end slot, count(*) as rows, -sum(l_extendedprice) total
    from lineitem join part on p_partkey = l_partkey where l_linenumber = 1 and p_type in ('SMALL','LARGE') group by 1""")
def a09_slots(v):
    slots = v.values("('smalloil(1%s)','gasoil'),('largeoil(1%s)','naphtha')", "label_key, slot")
    rows = corpus.slot_rows(corpus.table_rows(_printed_pages(v), "l_orderkey", "body"), slots)
    return rows.groupBy("slot").agg(F.count("*").alias("rows"), F.sum(F.col("values")[1]).alias("total"))


@query("a09_issue_month", "issue n:int", """
    select cast(2000 + k % 20 as varchar) || '-' || lpad(cast(k % 12 + 1 as varchar), 2, '0') issue, count(*) n
    from (select distinct l_orderkey k from lineitem) group by 1""")
def a09_issue(v):
    months = {m.lower(): i + 1 for i, m in enumerate(corpus_months)}
    pages = _printed_pages(v).withColumn("issue", corpus.issue_month(F.col("body"), "Monthly Report", months))
    return pages.groupBy("issue").agg(F.count("*").alias("n"))


@query("a09_document_rows", "source lines:int rows:int blank:int no_label:int number_inside:int no_number:int", r"""
    with l as (select source, list_filter(regexp_split_to_array(unnest(string_split(text, chr(10))), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') t from documents where text is not null),
    n as (select source, t, list_transform(t, lambda x: regexp_matches(x, '^[+\-\x{2010}-\x{2015}\x{2212}]?[0-9]+(\.[0-9]+)?R?$')) f from l),
    k as (select source, case when len(t) = 0 then 'blank' when not list_contains(f, false) then 'no_label' when f[-1] then 'row' when list_contains(f, true) then 'number_inside' else 'no_number' end kind from n)
    select source, count(*) as lines, count(*) filter (where kind = 'row') as rows, count(*) filter (where kind = 'blank') blank, count(*) filter (where kind = 'no_label') no_label,
      count(*) filter (where kind = 'number_inside') number_inside, count(*) filter (where kind = 'no_number') no_number from k group by 1""")
def a09_documents(v):
    boxed = v.table("documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    lines = corpus.printed_lines(boxed, "doc", "text")
    return lines.groupBy(F.col("doc.source").alias("source")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("kind") == "row").alias("rows"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("blank", "no_label", "number_inside", "no_number")],
    )


@query("a09_page_rows", "page_id:int row:int kind label cells:int first_cell last_cell", r"""
    with c as (select page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g') h from pages),
    r as (select page_id, x, i - 1 as "row" from (select page_id, regexp_extract_all(h, '(?is)<ul\b[^>]*>(.*?)</ul>', 1) e from c), unnest(e) with ordinality u(x, i)),
    t as (select page_id, "row", list_transform(regexp_extract_all(x, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda y: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(y, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&minus;', '-'), '&ndash;', '-'), '&amp;', '&'), '\s+', ' ', 'g'))) t from r),
    n as (select *, coalesce(list_max(list_transform(t, lambda y, k: case when regexp_matches(replace(replace(y, ' ', ''), ',', ''), '^[+-]?[0-9]*\.?[0-9]+$') then 0 else k end)), 0) cut from t)
    select page_id, "row", case when len(t) = 0 then 'no_cells' when cut = 0 then 'no_label' when cut = len(t) then 'no_number' else 'row' end kind,
      array_to_string(t[1:cut], ' ') as label, len(t) as cells, t[1] first_cell, t[-1] last_cell from n""")
def a09_pages(v):
    rows = corpus.html_rows(v.table("pages"), "page_id", "html", rows=("ul", "ol", "tr"), cells=("li", "td", "th"))
    return rows.select(
        "page_id", "row", "kind", "label", F.size("cells").alias("cells"), F.get("cells", F.lit(0)).alias("first_cell"),
        F.try_element_at("cells", F.lit(-1)).alias("last_cell"),
    )


@query("a10_idempotent_publish", "m:date margin:num bench:num first_write:bool second_write:bool", """
    select m, margin, bench, true first_write, false second_write from margins""")
def a10(v):
    root = shared_dir(v.spark, "mart")
    first = sinks.publish(v.margins, root, ["m"])
    second = sinks.publish(v.margins.orderBy(F.col("m").desc()), root, ["m"])
    return sinks.current(v.spark, root).withColumn("first_write", F.lit(first)).withColumn("second_write", F.lit(second))


@query("a10_publish_sees_moved_null", "m:date a:num b:num second_write:bool", "select m, bench a, null::double b, true second_write from margins")
def a10_null(v):
    root = shared_dir(v.spark, "mart")
    empty = F.lit(None).cast("double")
    sinks.publish(v.margins.select("m", empty.alias("a"), F.col("bench").alias("b")), root, ["m"])
    second = sinks.publish(v.margins.select("m", F.col("bench").alias("a"), empty.alias("b")), root, ["m"])
    return sinks.current(v.spark, root).withColumn("second_write", F.lit(second))


@query("a11_mart_build", "mart rows:int", """
    select 'margins' mart, count(*) as rows from margins union all select 'spreads', count(*) from spreads
    union all select 'carriers', count(distinct m) from spreads""")
def a11(v):
    from spreadlake.operators.ranking import carrier

    root = shared_dir(v.spark, "marts")
    builders = {
        "margins": lambda: v.margins,
        "spreads": lambda: v.spreads,
        "carriers": lambda: carrier(v.spreads, ["m"], "product", "spread"),
    }
    sinks.build_marts(builders, root, shared=[v.ruled])
    out = None
    for name in builders:
        part = sinks.current(v.spark, f"{root}/{name}").agg(F.count("*").alias("rows")).withColumn("mart", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
