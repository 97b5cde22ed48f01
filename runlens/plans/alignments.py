"""Queries: runs aligned by cost, hidden pools, and what stands at a run's cuts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import alignment as A
from runlens.operators import factors as K
from runlens.operators import multivariate as V

from .catalog import query

ALIGNED = """, cost as (select run, step, wall - min(wall) over (partition by run) as cost from axis), lim as (select min(m) as m from (select max(cost) as m from cost group by run)),
g as (select unnest(range(1, 200)) * 43200.0::double as c), pts as (select run, tag, cost as x, value as y from fact join cost using (run, step) where value is not null),
b as (select run, tag, c, max(x) filter (x <= c) as x0, arg_max(y, x) filter (x <= c) as y0, min(x) filter (x >= c) as x1, arg_min(y, x) filter (x >= c) as y1 from pts, g, lim where c <= m group by all),
i as (select run, tag, c, case when x0 = x1 then y0 else y0 + (c - x0) * (y1 - y0) / (x1 - x0) end as y from b),
al as (select tag, c as cost, max(case when run = 'r0' then y end) as a, max(case when run = 'r1' then y end) as b from i group by all having a is not null or b is not null)"""


def _aligned(v):
    cost = v.axis.select("run", "step", (F.col("wall") - F.min("wall").over(Window.partitionBy("run"))).alias("cost"))
    return A.aligned_by_cost(v.fact, cost, "r0", "r1", 43_200.0)


@query(f"{ALIGNED} select tag, cost, round(a, 6) as a, round(b, 6) as b from al")
def sta23_aligned_by_cost(v):
    """Both runs' series where they had cost the same, each half day's cost."""
    return _aligned(v).select("tag", "cost", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""{ALIGNED} select tag, count(*) as n, count(*) filter (b < a) as a_leads, count(*) filter (b > a) as b_leads, round(avg(b - a), 6) as mean_diff, round(min(b - a), 6) as least_diff,
round(max(b - a), 6) as most_diff, min(cost) as first_cost, max(cost) as last_cost from al where a is not null and b is not null group by tag""")
def sta23_leads_by_cost(v):
    found = A.lead_counts(_aligned(v))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_diff", "least_diff", "most_diff")})


@query(""", p as (select case when substr(dataset, 7, 1) in ('1', '2') then 'low' else 'high' end as run, dataset as part, step, weight, rate, dataset like '%5' as unseen from panel),
t as (select run, step, sum(weight * rate) / sum(weight) + case when step % 4 = 0 then 0.5 else 0 end as rate, coalesce(sum(weight) filter (unseen), 0) as hidden from p group by run, step),
s as (select run, part, step, weight, rate from p where not unseen and rate is not null and weight > 0), e as (select run, min(step) as f, max(step) as l from t group by run),
c as (select run, part from s join e using (run) group by all having count(*) filter (step = f) > 0 and count(*) filter (step = l) > 0),
m as (select run, step, sum(weight * rate) as num, sum(weight) as den, count(*) as all_parts, sum(weight * rate) filter (c.part is not null) / nullif(sum(weight) filter (c.part is not null), 0) as common_rate,
count(c.part) as common_parts from s left join c using (run, part) group by all),
x as (select *, case when hidden > 0 then (t.rate * (den + hidden) - num) / hidden end as hr from t left join m using (run, step))
select run, step, round(rate, 6) as rate, round(common_rate, 6) as common_rate, coalesce(common_parts, 0) as common_parts, round(num / nullif(den, 0), 6) as all_rate, coalesce(all_parts, 0) as all_parts,
round(hr, 6) as hidden_rate, hr between 0 and 1 as feasible, round(common_rate - rate, 6) as gap from x""")
def dom12_hidden_pool(v):
    """Brands that end in 5 are not listed: their share of returns follows from the total, which is reported too high every fourth quarter."""
    low = F.substring("dataset", 7, 1).isin("1", "2")
    p = v.panel.select(F.when(low, "low").otherwise("high").alias("run"), F.col("dataset").alias("part"), "step", "weight", "rate", F.col("dataset").endswith("5").alias("unseen"))
    bias = F.when(F.col("step") % 4 == 0, 0.5).otherwise(0.0)
    total = p.groupBy("run", "step").agg((F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).alias("r"), F.coalesce(F.sum(F.when(F.col("unseen"), F.col("weight"))), F.lit(0.0)).alias("hidden"))
    total = total.select("run", "step", (F.col("r") + bias).alias("rate"), "hidden")
    found = A.hidden_pool(p.where("not unseen"), total)
    return found.withColumns({c: F.round(c, 6) for c in ("rate", "common_rate", "all_rate", "hidden_rate", "gap")})


@query()
def mlt14_cut_diagnostics(v):
    """What changes at the four best places to cut a run, whether it stays, and the restart nearest to each."""
    z = V.cohort(v.fact, v.axis)
    return A.cut_diagnostics(z, K.split_candidates(z), v.axis, v.restarts, F.element_at(F.split("tag", "/"), 2))
