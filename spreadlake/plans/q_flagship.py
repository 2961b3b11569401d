"""The flagship: latest month's spread per product, its trailing rank and the carrier."""

from pyspark.sql import functions as F

from spreadlake.operators import ranking
from spreadlake.plans.registry import query


@query(
    "flagship_latest_spreads",
    "product m:date spread:num percentile:num window_obs:int carrier",
    """
    with ranked as (
      select a.product, a.m, a.spread,
             100.0 * count(case when b.spread <= a.spread then 1 end) / count(b.spread) percentile,
             count(b.spread) window_obs
      from spreads a join spreads b on b.product = a.product
           and b.m between a.m - interval 119 month and a.m
      where a.spread is not null group by 1, 2, 3),
    last as (select product, m, spread, percentile, window_obs from ranked
             qualify row_number() over (partition by product order by m desc) = 1),
    best as (select product carrier, m from (
        select s.product, s.m, row_number() over (partition by s.m order by s.spread * y.yield desc, s.product) r
        from spreads s join yields y on y.product = s.product where s.spread is not null) where r = 1)
    select l.*, b.carrier from last l left join best b on b.m = l.m
    """,
)
def flagship(v):
    ranked = ranking.trailing_rank(v.spreads.filter("spread is not null"), ["product"], "m", "spread")
    last = ranked.groupBy("product").agg(
        F.max("m").alias("m"),
        F.max_by(F.struct("spread", "percentile", "window_obs"), "m").alias("_l"),
    ).select("product", "m", "_l.*")
    weighted = v.spreads.join(v.yields, "product").withColumn("c", F.col("spread") * F.col("yield"))
    best = ranking.carrier(weighted, ["m"], "product", "c").select("m", "carrier")
    return last.join(best, "m", "left")
