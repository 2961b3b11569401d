"""The domain views as SQL text, prefixed to an oracle that names them."""

from __future__ import annotations

import re

# Literal dimension tables. The same text feeds Spark and the oracle.
YIELDS = "('ECONOMY',0.20,7.45),('LARGE',0.12,8.33),('MEDIUM',0.18,7.90),('PROMO',0.08,6.50),('SMALL',0.32,7.00)"
YIELD_COLUMNS = "product, yield, bbl_per_t"

EVENTS = (
    "('price_war','1996-03-01','month','macro','https://example.org/a'),"
    "('strike','1998-09-14','day','outage','https://example.org/b'),"
    "('cold_snap','2000-12-20','day','weather','https://example.org/c'),"
    "('cut','2001-10-01','month','policy','https://example.org/d')"
)
EVENT_COLUMNS = "event_id, day, date_precision, kind, source_url"

EPISODES = "('episode_1997','1997-03-01'),('episode_1999','1999-02-01'),('episode_2001','2001-02-01')"
EPISODE_COLUMNS = "episode, start"

FACTORS = (
    "('STANDARD','usd_bbl',cast(null as double)),('ECONOMY','usd_t',7.45),('LARGE','usd_t',8.33),"
    "('MEDIUM','usd_bbl',cast(null as double)),('PROMO','usd_t',cast(null as double)),"
    "('SMALL','usd_bbl',7.0)"
)
FACTOR_COLUMNS = "product, unit, bbl_per_t"

VIEWS = {
    "quotes": """
        select p.p_type product, cast(l.l_shipdate as date) date,
               l.l_returnflag || l.l_linestatus market,
               l.l_extendedprice / l.l_quantity price, l.l_partkey instrument
        from lineitem l join part p on p.p_partkey = l.l_partkey""",
    "monthly": """
        select product, cast(date_trunc('month', date) as date) m, avg(price) v, count(*) n
        from quotes group by 1, 2""",
    "ruled": """
        select product, m, case when n >= 15 then v end v, n from monthly""",
    "daily": """
        select event_type series, cast(ts as date) date, avg(value) v, count(*) n
        from events group by 1, 2""",
    "long_stats": """
        select n.n_name area, r.r_name region, o.o_orderpriority flow,
               case o.o_orderstatus when 'O' then '1' when 'F' then '2' else '3' end code,
               cast(date_trunc('month', o.o_orderdate) as date) m, sum(o.o_totalprice) v
        from orders o join customer c on c.c_custkey = o.o_custkey
             join nation n on n.n_nationkey = c.c_nationkey
             join region r on r.r_regionkey = n.n_regionkey
        group by 1, 2, 3, 4, 5""",
    "capacity": """
        select r.r_name region, year(o.o_orderdate) y, max(o.o_totalprice) * count(*) cap
        from orders o join customer c on c.c_custkey = o.o_custkey
             join nation n on n.n_nationkey = c.c_nationkey
             join region r on r.r_regionkey = n.n_regionkey
        group by 1, 2""",
    "readings": """
        select user_id % 12 doc, cast(ts as date) date, event_type field, ts vintage,
               value, cast(json_extract(props, '$.k') as int) % 3 = 0 provisional
        from events""",
    "ohlc": """
        select event_type series, cast(ts as date) date, min_by(value, ts) o,
               max(value) h, min(value) l, max_by(value, ts) c, count(*) vol
        from events group by 1, 2""",
    "yields": f"select * from (values {YIELDS}) t({YIELD_COLUMNS})",
    "event_dim": f"select event_id, cast(day as date) as day, date_precision, kind, source_url from (values {EVENTS}) t({EVENT_COLUMNS})",
    "event_table": """
        select o.o_orderkey event_id, r.r_name region, cast(o.o_orderdate as date) as day
        from orders o join customer c on c.c_custkey = o.o_custkey
             join nation n on n.n_nationkey = c.c_nationkey
             join region r on r.r_regionkey = n.n_regionkey
        where o.o_orderpriority = '1-URGENT'""",
    "returns": """
        select l_orderkey || '-' || l_linenumber event_id, l_partkey instrument, cast(l_shipdate as date) as day
        from lineitem where l_returnflag = 'R'""",
    "episodes": f"select episode, cast(start as date) as start from (values {EPISODES}) t({EPISODE_COLUMNS})",
    "factors": f"select * from (values {FACTORS}) t({FACTOR_COLUMNS})",
    # spread of each product over the STANDARD benchmark leg, thin months missing
    "spreads": """
        select p.product, p.m, p.v price, b.v bench, p.v - b.v spread, p.n
        from ruled p join ruled b on b.m = p.m and b.product = 'STANDARD'
        where p.product <> 'STANDARD'""",
    # one market margin per month: strict over the slate
    "margins": """
        select s.m, case when count(s.spread) = 5 then sum(y.yield * s.spread) end margin,
               max(s.bench) bench
        from spreads s join yields y on y.product = s.product group by s.m""",
    "runs": """
        select region, m, sum(v) / 1e6 intake,
               sum(case when flow in ('1-URGENT','2-HIGH') then v end) / 1e6 imports
        from long_stats group by 1, 2""",
    "panel": """
        select r.region, r.m, r.intake, r.imports, c.cap / 1e6 as capacity, c.y source_year,
               1200.0 * r.intake / (c.cap / 1e6) util, g.margin, g.bench
        from runs r join capacity c on c.region = r.region and c.y = year(r.m) - 1
             join margins g on g.m = r.m""",
    "lagged": """
        select p.*, l1.margin lag1, l2.margin lag2, l3.margin lag3,
               (l1.margin + l2.margin + l3.margin) / 3 margin_lag,
               (l1.bench + l2.bench + l3.bench) / 3 bench_lag
        from panel p
             left join margins l1 on l1.m = p.m - interval 1 month
             left join margins l2 on l2.m = p.m - interval 2 month
             left join margins l3 on l3.m = p.m - interval 3 month""",
}


def with_views(body: str) -> str:
    """``body`` prefixed by the views it names, directly or through another view."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name in needed or not re.search(rf"\b{name}\b", text):
                continue
            visit(sql)
            if name not in needed:
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
    return f"with {ctes}\n{body}"
