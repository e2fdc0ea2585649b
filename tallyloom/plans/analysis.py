"""Joins, statistics, attribution, alerts, result shaping, scenarios and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.context import Filters
from tallyloom.functions.numbers import exact_sum, round2, round_half_up
from tallyloom.operators import (compare as P, drivers as DR, evidence as EV, insights as IN, joins as J, metrics as MT,
                                 reshape as RS, scenario as SC, stats as ST)
from tallyloom.plans import oracle as O
from tallyloom.plans.kpis import SIDES_SQL, _CHANGE_SQL, _HALF_SQL, schema_of
from tallyloom.plans.registry import query
from tallyloom.plans.scalars import ALIAS_VALUES, _NORM_SQL
from tallyloom.plans.views import SALES_SCHEMA as S, SALES_SQL, load, sales

# --- joins ----------------------------------------------------------------------------------------

_BLANKED = "case when o_orderkey % 10 = 0 then '  ' when o_orderkey % 10 = 1 then 'x' || o_custkey else ' ' || o_custkey end"


def _order_keys(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", f"{_BLANKED} as customer")


def _customers(spark, sf):
    return load(spark, sf, "customer").selectExpr("cast(c_custkey as string) as customer", "c_mktsegment as segment", "c_acctbal as o_totalprice")


@query("g1_guarded_join", f"""with o as (select o_orderkey, o_totalprice, {_BLANKED} as customer from orders)
select o_orderkey, o.o_totalprice, customer, coalesce(c_mktsegment, '') as segment, c_acctbal as "customers.o_totalprice"
from o left join customer on lower(nullif(trim(customer), '')) = cast(c_custkey as varchar)""")
def _(spark, sf):
    joined, made = J.guarded_join(_order_keys(spark, sf), _customers(spark, sf), J.Relation("customer", "customers", "customer"))
    assert made
    return joined


@query("g1_refused_join", "select c_custkey, c_nationkey from customer")
def _(spark, sf):
    left = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined, made = J.guarded_join(left, load(spark, sf, "supplier"), J.Relation("c_nationkey", "suppliers", "s_nationkey"))
    assert not made
    return joined


@query("g2_join_analysis", f"""with l as (select lower(nullif(trim({_BLANKED}), '')) as k, count(*) as l from orders group by 1),
r as (select cast(c_custkey as varchar) as k, count(*) as r from customer group by 1),
b as (select coalesce(l.k, r.k) as k, coalesce(l, 0) as l, coalesce(r, 0) as r from l full join r on l.k = r.k)
select case when max(case when k is not null then l end) > 1 then 'many' else 'one' end || '_to_' || case when max(case when k is not null then r end) > 1 then 'many' else 'one' end as kind,
  count(*) filter (k is not null and r > 1) = 0 as safe, cast(sum(l) as bigint) as left_rows, cast(sum(r) as bigint) as right_rows,
  cast(sum(l) filter (k is not null and r > 0) as bigint) as matched_left, cast(coalesce(sum(l) filter (k is not null and r = 0), 0) as bigint) as unmatched_left,
  cast(coalesce(sum(l) filter (k is null), 0) as bigint) as blank_left, cast(coalesce(sum(r) filter (k is not null and l = 0), 0) as bigint) as unmatched_right,
  count(*) filter (k is not null and r > 1) as duplicate_keys,
  {O.half_up("(sum(l * greatest(r, 1)) filter (k is not null) + coalesce(sum(l) filter (k is null), 0)) / sum(l)", 4)} as fan_out from b""")
def _(spark, sf):
    return J.join_report(J.key_counts(_order_keys(spark, sf), _customers(spark, sf), "customer", "customer"))


@query("g5_hops", """select 0 as position, 'customer' as right_name, max(k) = 1 as applied from (select count(*) as k from customer group by c_custkey)
union all select 1, 'supplier', max(k) = 1 from (select count(*) as k from supplier group by s_nationkey)
union all select 2, 'nation', max(k) = 1 from (select count(*) as k from nation group by n_nationkey)""")
def _(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("customer", "nation", "supplier")}
    relations = [J.Relation("o_custkey", "customer", "c_custkey"), J.Relation("c_nationkey", "supplier", "s_nationkey"), J.Relation("c_nationkey", "nation", "n_nationkey")]
    return J.deferred_chain(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), tables, relations)[1]


@query("g5_join_chain", """select r_name, c_mktsegment, count(*) as n, sum(l_linenumber)::bigint as lines from lineitem left join orders on l_orderkey = o_orderkey
left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2""")
def _(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("orders", "customer", "nation", "region", "supplier")}
    relations = [
        J.Relation("l_orderkey", "orders", "o_orderkey"), J.Relation("o_custkey", "customer", "c_custkey"),
        J.Relation("c_nationkey", "supplier", "s_nationkey"),  # repeats, so this hop is refused
        J.Relation("c_nationkey", "nation", "n_nationkey"), J.Relation("n_regionkey", "region", "r_regionkey")]
    left = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    joined, _ = J.deferred_chain(left, tables, relations)
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


_BARE = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"],
         "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"]}
_PAIRS = [(lt, lc, rt, rc) for lt, lcs in _BARE.items() for lc in lcs for rt, rcs in _BARE.items() if lt != rt for rc in rcs if lc[2:] == rc[2:]]
_G6 = " union all ".join(f"""select '{lt}' as left_table, '{lc[2:]}' as left_column, '{rt}' as right_table, '{rc[2:]}' as right_column,
  (select max(k) from (select count(*) k from {lt} group by {lc})) > 1 as many, (select max(k) from (select count(*) k from {rt} group by {rc})) as rk,
  (select count(*) filter ({lc} in (select {rc} from {rt})) / count({lc}) from {lt}) as o""" for lt, lc, rt, rc in _PAIRS)


@query("g6_relation_suggestion", f"""with p as ({_G6}) select left_table, left_column, right_table, right_column,
  case when many then 'many_to_one' else 'one_to_one' end as kind, {O.r2('o')} as overlap, {O.r2('0.4 + o * 0.6')} as confidence
from p where rk <= 1 and o >= 0.5""")
def _(spark, sf):
    tables = {t: load(spark, sf, t).selectExpr(*[f"{c} as {c[2:]}" for c in cs]) for t, cs in _BARE.items()}
    return J.suggest_relations(tables)


@query("g8_anti_join", f"with {_HALF_SQL} select cast(customer_id as varchar) as customer from halves where early and not late")
def _(spark, sf):
    return MT.lapsed_customers(sales(spark, sf, "date", "customer_id"), S)


@query("g9_period_pairing", f"""with {SIDES_SQL} select brand as member, {O.r2('coalesce(sum(revenue) filter (cur), 0)')} as current,
  {O.r2('coalesce(sum(revenue) filter (prev), 0)')} as previous from tagged where cur or prev group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "brand", "revenue")
    members = DR.contributions(df, S, ["brand"], F.col("revenue"), P.period_bounds(sales(spark, sf, "date"), S))
    return members.select("member", "current", "previous")


@query("g10_margin_series", f"""with {SALES_SQL}, s as (select strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as revenue, {O.r2('sum(revenue - cost)')} as profit from sales group by 1)
select period, revenue, profit, case when revenue <> 0 then floor(profit / revenue * 100 * 10000 + 0.5) / 10000 else 0 end as margin_pct from s""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue", "cost")
    both = df.groupBy(F.date_format("date", "yyyy-MM").alias("period")).agg(
        round2(exact_sum("revenue")).alias("revenue"), round2(exact_sum(F.col("revenue") - F.col("cost"))).alias("profit"))
    return both.withColumn("margin_pct", F.when(F.col("revenue") != 0, round_half_up(F.col("profit") / F.col("revenue") * 100, 4)).otherwise(0.0))


_SPELLED = """case n_nationkey % 6 when 0 then 'USA' when 1 then 'united states' when 2 then upper(r_name) when 3 then 'Côte d''Ivoire'
  when 4 then 'England' else n_name end"""
_MAP = ["United States of America", "United Kingdom", "Côte d'Ivoire", "Asia", "Africa", "Europe"]
_MAP_VALUES = ", ".join("('{}')".format(m.replace("'", "''")) for m in _MAP)


@query("g11_region_match", f"""with alias(alias, target) as (values {ALIAS_VALUES}), names(name) as (values {_MAP_VALUES}),
rows_ as (select {_SPELLED} as label, c_acctbal as v from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
norm as (select label, v, {_NORM_SQL.format(v='label')} as k from rows_), n2 as (select name, {_NORM_SQL.format(v='name')} as k from names),
found as (select label, v, coalesce(a.name, b.name) as region from norm left join n2 a on norm.k = a.k
  left join alias on alias.alias = norm.k left join n2 b on b.k = {_NORM_SQL.format(v='target')})
select coalesce(region, label) as region, region is not null as matched, {O.r2('sum(v)')} as value from found group by 1, 2""")
def _(spark, sf):
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    customers = load(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    names = spark.createDataFrame([(m,) for m in _MAP], "name string")
    return J.match_regions(customers.select(F.expr(_SPELLED).alias("label"), "c_acctbal"), "label", F.col("c_acctbal"), names, "name")


# --- series statistics ------------------------------------------------------------------------------

MONTHLY_SQL = f"{SALES_SQL}, s as (select region, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1, 2)"


def monthly(spark, sf, by="region"):
    return MT.time_series(sales(spark, sf, "date", by, "revenue"), S, by=[by])


_MAD_SQL = """m as (select *, median(value) over (partition by {k}) as med, stddev_pop(value) over (partition by {k}) as sd, count(*) over (partition by {k}) as n from s),
m2 as (select *, median(abs(value - med)) over (partition by {k}) as mad from m where n >= 4),
m3 as (select *, case when mad > 0 then mad / 0.6745 else sd end as sc from m2),
m4 as (select *, case when sc > 0 then (value - med) / sc else 0 end as z from m3)"""


@query("k1_anomalies", f"""with s as (select event_type, strftime(ts, '%Y-%m-%d') as period, cast(floor(sum(value) * 100 + 0.5) / 100 as double) as value from events
  group by 1, 2), {_MAD_SQL.format(k='event_type')}
select event_type, period, value, {O.r2('med')} as expected, {O.r2('value - med')} as deviation, {O.r2('med - 3.5 * sc')} as lower, {O.r2('med + 3.5 * sc')} as upper,
  abs(z) >= 3.5 as is_anomaly, case when abs(z) >= 3.5 then floor(z * 100 + 0.5) / 100 end as z_score, case when value >= med then 'spike' else 'drop' end as direction,
  case when abs(z) >= 5 then 'HIGH' when abs(z) >= 3.5 then 'MEDIUM' end as severity from m4""")
def _(spark, sf):
    daily = load(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(
        round_half_up(F.sum("value"), 2).alias("value"))
    return ST.anomalies(daily, ["event_type"])


_K2 = ["quantity", "cost", "inventory", "unit_price"]


@query("k2_metric_correlation", f"""with {SALES_SQL}, pp as (select strftime(date, '%Y-%m') as period, sum(revenue) as x, """ + ", ".join(
    f"cast(sum({c}) as double) as {c}" for c in _K2) + """ from sales group by 1),
l as (""" + " union all ".join(f"select period, x, '{c}' as col, {c} as y from pp" for c in _K2) + f"""),
r as (select *, row_number() over (partition by col order by x, period) as rx, row_number() over (partition by col order by y, period) as ry from l)
select col as "column", count(*) as n, {O.half_up('corr(x, y)', 3)} as pearson, {O.half_up('corr(rx, ry)', 3)} as spearman,
  case when corr(x, y) >= 0 then 'positive' else 'negative' end as direction,
  case when abs(corr(x, y)) >= 0.7 then 'strong' when abs(corr(x, y)) >= 0.4 then 'moderate' else 'weak' end as strength from r group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue", *_K2)
    return ST.correlate_metric(df, S, F.sum("revenue"), _K2)


_K3 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_text"]
_K3_FRAME = "select l_quantity, l_extendedprice, l_discount, l_tax, case when l_linenumber % 5 = 0 then 'n/a' else '$' || cast(cast(floor(l_extendedprice) as bigint) as string) end as price_text from lineitem"
_K3_PAIRS = [(a, b) for i, a in enumerate(_K3) for b in _K3[i + 1:]]


@query("k3_column_correlation", f"""with f as ({_K3_FRAME}), x as (select * replace (try_cast(replace(price_text, '$', '') as double) as price_text) from f),
r as (""" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, regr_count({a}, {b}) as n from x" for a, b in _K3_PAIRS) + f""")
select a, b, {O.half_up('r', 3)} as coefficient, n as sample_size, case when abs(r) >= 0.8 then 'very strong' when abs(r) >= 0.6 then 'strong' when abs(r) >= 0.4 then 'moderate'
  when abs(r) >= 0.2 then 'weak' else 'negligible' end as strength, case when abs(r) < 0.2 then 'none' when r > 0 then 'positive' else 'negative' end as direction from r""")
def _(spark, sf):
    lines = load(spark, sf, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_discount", "l_tax", _K3_FRAME.split("l_tax, ")[1].split(" from lineitem")[0])
    return ST.correlate_columns(lines, _K3)


@query("k4_pearson_spearman", f"""with {SALES_SQL}, p as (select region, strftime(date, '%Y-%m') as period, sum(revenue) as x, sum(quantity) as y from sales group by 1, 2),
r as (select *, row_number() over (partition by region order by x, period) as rx, row_number() over (partition by region order by y, period) as ry from p)
select region, count(*) as n, {O.half_up('corr(x, y)', 3)} as pearson, {O.half_up('corr(rx, ry)', 3)} as spearman from r group by 1""")
def _(spark, sf):
    points = sales(spark, sf, "region", "date", "revenue", "quantity").groupBy("region", F.date_format("date", "yyyy-MM").alias("period")).agg(
        F.sum("revenue").alias("x"), F.sum("quantity").alias("y"))
    return ST.correlate_pairs(points, ["region"]).select("region", "n", "pearson", "spearman")


@query("k5_quartiles", f"""select l_returnflag, {O.half_up('avg(l_extendedprice)', 4)} as mean, {O.half_up('stddev_pop(l_extendedprice)', 4)} as sd,
  {O.half_up('quantile_cont(l_extendedprice, 0.25)', 4)} as q1, {O.half_up('quantile_cont(l_extendedprice, 0.5)', 4)} as median,
  {O.half_up('quantile_cont(l_extendedprice, 0.75)', 4)} as q3, {O.half_up('quantile_cont(l_extendedprice, 0.9)', 4)} as p90 from lineitem group by 1""")
def _(spark, sf):
    return ST.describe(load(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("k6_trend_line", f"""with {MONTHLY_SQL}, x as (select *, row_number() over (partition by region order by period) - 1 as x from s)
select region, count(*) as n, {O.half_up('regr_slope(value, x)', 3)} as slope, {O.half_up('regr_intercept(value, x)', 3)} as intercept,
  {O.half_up('sqrt((regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / count(*))', 3)} as residual_sd from x group by 1""")
def _(spark, sf):
    return ST.trend_line(monthly(spark, sf), ["region"]).select(
        "region", "n", *[round_half_up(F.col(c), 3).alias(c) for c in ("slope", "intercept", "residual_sd")])


# --- attribution ----------------------------------------------------------------------------------------


def _bounds(spark, sf):
    return P.period_bounds(sales(spark, sf, "date"), S)


def _contrib_sql(dims, where="delta <> 0"):
    return f"""{SIDES_SQL}, g as (""" + " union all ".join(
        f"""select '{d}' as dimension, {O.group_label(d)} as member, coalesce(sum(revenue) filter (cur), 0) as c, coalesce(sum(revenue) filter (prev), 0) as p
  from tagged where cur or prev group by 2""" for d in dims) + f"""),
ww as (select *, sum(c - p) over (partition by dimension) as whole from g),
members as (select dimension, member, {O.r2('c')} as current, {O.r2('p')} as previous, {O.r2('c - p')} as delta,
  case when p <> 0 then {O.half_up('(c - p) / abs(p) * 100', 2)} end as change_pct, case when whole <> 0 then {O.half_up('(c - p) / whole * 100', 2)} end as share_pct,
  {O.r2('whole')} as total_delta from ww)"""


@query("l1_driver_contributions", f"""with {_contrib_sql(['product_name'])}, r as (select *, row_number() over (order by abs(delta) desc, member) as rank, count(*) over () as n from members where delta <> 0)
select dimension, member, rank, delta, total_delta from r where rank <= 10
union all select 'product_name', '(other)', 11, {O.r2('sum(delta) filter (rank > 10)')}, max(total_delta) from r where n > 10""")
def _(spark, sf):
    df = sales(spark, sf, "date", "product_name", "revenue")
    return DR.top_contributions(DR.contributions(df, S, ["product_name"], F.col("revenue"), _bounds(spark, sf)), 10)


_L3 = ["product_name", "customer_name", "region", "category", "state", "department"]


@query("l3_multi_dimension_drivers", f"with {_contrib_sql(_L3)} select * from members where delta <> 0")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue", *_L3)
    return DR.contributions(df, S, _L3, F.col("revenue"), _bounds(spark, sf))


@query("l1_reconciled", f"""with {_contrib_sql(['region', 'category'])} select dimension, max(total_delta) as total_delta, count(*) as members,
  abs(sum(delta) - max(total_delta)) < 0.01 as reconciled from members where delta <> 0 group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue", "region", "category")
    return DR.reconciled(DR.contributions(df, S, ["region", "category"], F.col("revenue"), _bounds(spark, sf)))


_PVM_SQL = f"""{SIDES_SQL}, t as (select sum(quantity) filter (cur) q2, sum(quantity) filter (prev) q1, sum(revenue) filter (cur) r2, sum(revenue) filter (prev) r1 from tagged),
d as (select *, (q2 - q1) * (r1 / q1) as v, q2 * (r2 / q2 - r1 / q1) as p from t)"""


@query("l2_price_volume_mix", f"""with {_PVM_SQL} select {O.r2('v')} as volume_delta, {O.r2('p')} as price_delta, {O.r2('r2 - r1 - v - p')} as mix_delta, {O.r2('r2 - r1')} as total_delta,
  {O.r2('q2')} as current_units, {O.r2('q1')} as previous_units, {O.r2('r2 / q2')} as current_price, {O.r2('r1 / q1')} as previous_price from d""")
def _(spark, sf):
    df = sales(spark, sf, "date", "quantity", "unit_price", "revenue")
    return DR.price_volume_mix(df, schema_of(df), _bounds(spark, sf))


def _short(e):
    return f"""case when abs({e}) >= 1000 then case when {e} < 0 then '-' else '' end || format('{{:,}}', cast(floor(abs({e}) + 0.5) as bigint))
    else regexp_replace(cast(floor({e} * 100 + 0.5) / 100 as varchar), '\\.0$', '') end"""


_SPLIT = ", ".join(f"case when abs({p}_delta) > 0.01 then '{p} ' || {_short(p + '_delta')} end" for p in ("volume", "price", "mix"))


@query("l4_investigation", f"""with {_contrib_sql(_L3)}, {_PVM_SQL.split(SIDES_SQL + ', ')[1]},
split as (select {O.r2('v')} as volume_delta, {O.r2('p')} as price_delta, {O.r2('r2 - r1 - v - p')} as mix_delta, {O.r2('r2 - r1')} as total_delta from d where q1 <> 0 and q2 <> 0),
pp as (select strftime(date, '%Y-%m') as period, sum(revenue) as x, sum(cost) as cost, cast(sum(quantity) as double) as quantity from sales group by 1),
co as (select 'cost' as col, {O.half_up('corr(x, cost)', 3)} as r, corr(x, cost) as raw, count(*) as n from pp union all select 'quantity', {O.half_up('corr(x, quantity)', 3)}, corr(x, quantity), count(*) from pp),
s as (select 1 as one, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 2), {_MAD_SQL.format(k='one')},
an as (select period, {O.r2('med')} as expected, {O.r2('value - med')} as deviation from m4 where abs(z) >= 3.5)
select 'driver' as kind, dimension as subject, member || ': ' || {_short('delta')} as detail, delta as value
  from (select *, row_number() over (partition by dimension order by abs(delta) desc, member) as rank from members where delta <> 0) where rank = 1
union all select 'decomposition', 'revenue', 'Of the change: ' || concat_ws(', ', {_SPLIT}), total_delta from split
union all select 'correlation', col, col || ' follows revenue, correlation ' || printf('%.2f', r), r from co where n >= 3 and abs(raw) >= 0.4
union all select 'anomaly', period, period || ': ' || {_short('deviation')} || ' away from the usual ' || {_short('expected')}, deviation from an""")
def _(spark, sf):
    from tallyloom.operators.investigate import investigate

    df = sales(spark, sf, "date", "revenue", "quantity", "unit_price", "cost", *_L3)
    return investigate(df, schema_of(df), _bounds(spark, sf), _L3, ["cost", "quantity"])


def _usd(e):
    return f"case when {e} < 0 then '-$' else '$' end || format('{{:,}}', cast(floor(abs({e}) + 0.5) as bigint))"


@query("l5_headline", f"""with {_contrib_sql(['category'])}, x as (select region, category, sum(revenue) filter (cur) c, sum(revenue) filter (prev) p from tagged where cur or prev group by 1, 2),
t as (select region, {O.r2('sum(c)')} as current, {O.r2('sum(p)')} as previous, sum(c) - sum(p) as whole from x group by 1),
m as (select x.region, category, {O.r2('c - p')} as d, {O.half_up('(c - p) / whole * 100', 2)} as s, row_number() over (partition by x.region order by abs({O.r2('c - p')}) desc, category) as r from x join t on x.region = t.region),
h as (select t.region, {O.pct('current', 'previous')} as change_pct, {O.r2('current - previous')} as delta, current, previous, category, d, s,
    (select ct - cf + 1 from w limit 1) as days from (select * from t) t left join m on m.region = t.region and r = 1),
k as (select *, 'the previous ' || case when days <= 10 then 'week' when days <= 45 then 'month' when days <= 135 then 'quarter' when days <= 400 then 'year' else 'period' end as "window",
    case when delta = 0 or abs(change_pct) < 0.05 then 'flat' when delta > 0 then 'up' else 'down' end as direction from h),
dr as (select *, case when direction <> 'flat' and sign(d) = sign(delta) and abs(s) >= 25 then category end as driver from k)
select region, direction, change_pct, "window", driver, case when direction = 'flat' then 'Revenue: level at ' || {_usd('current')} || ', compared with ' || "window"
  else 'Revenue: ' || direction || ' ' || regexp_replace(cast(abs(change_pct) as varchar), '\\.0$', '') || '% compared with ' || "window" || ' (' || {_usd('previous')}
    || ' then, ' || {_usd('current')} || ' now)' || coalesce('; moved most by ' || driver, '') end as text from dr""")
def _(spark, sf):
    df = sales(spark, sf, "date", "region", "category", "revenue")
    bounds = _bounds(spark, sf)
    return DR.headlines_by_group(df, S, "region", "category", F.col("revenue"), bounds, "Revenue")


_SERIES3 = f"""{SALES_SQL}, s as (select region, metric, strftime(date, '%Y-%m') as period, value from (
  select region, 'revenue' as metric, date_trunc('month', date) as date, {O.r2('sum(revenue)')} as value from sales group by 1, 3
  union all select region, 'profit', date_trunc('month', date), {O.r2('sum(revenue - cost)')} from sales group by 1, 3
  union all select region, 'orders', date_trunc('month', date), cast(count(distinct order_id) as double) from sales group by 1, 3)),
l as (select *, row_number() over (partition by region, metric order by period desc) as r from s),
two as (select region, metric, max(period) filter (r = 1) as period, max(value) filter (r = 1) as current, max(value) filter (r = 2) as previous from l where r <= 2 group by 1, 2),
j as (select *, {O.pct('current', 'previous')} as change_pct, case when metric = 'revenue' then -5.0 else -10.0 end as lim from two where previous > 0),
alerts as (select region, metric, metric || case when change_pct <= lim then '_drop' else '_spike' end as type,
  case when change_pct <= lim * 2 then 'HIGH' when change_pct <= lim then 'MEDIUM' else 'LOW' end as severity, period, current, previous, change_pct from j where change_pct <= lim or change_pct >= 15)"""


def _key_series(spark, sf):
    df = sales(spark, sf, "date", "region", "revenue", "cost", "order_id")
    wide = df.groupBy("region", F.date_format("date", "yyyy-MM").alias("period")).agg(
        round2(exact_sum("revenue")).alias("revenue"), round2(exact_sum(F.col("revenue") - F.col("cost"))).alias("profit"),
        F.count_distinct("order_id").cast("double").alias("orders"))
    return wide.unpivot(["region", "period"], ["revenue", "profit", "orders"], "metric", "value")


@query("l6_metric_alerts", f"with {_SERIES3} select * from alerts")
def _(spark, sf):
    return IN.series_alerts(_key_series(spark, sf), ["region"])


@query("l7_thin_margin", f"""with {SALES_SQL}, t as (select product_id, quantity, sum(revenue) r, sum(revenue - cost) p from sales group by 1, 2),
m as (select product_id, quantity, floor(p / r * 100 * 10 + 0.5) / 10 as margin_pct from t where r > 0)
select product_id, quantity, margin_pct, case when margin_pct < 0 then 'HIGH' else 'MEDIUM' end as severity from m where margin_pct < 10""")
def _(spark, sf):
    df = sales(spark, sf, "product_id", "revenue", "cost", "quantity")
    totals = df.groupBy("product_id", "quantity").agg(
        exact_sum("revenue").alias("revenue"), exact_sum(F.col("revenue") - F.col("cost")).alias("profit"))
    return IN.thin_margin(totals, ["product_id", "quantity"])


@query("l8_inventory_shortage", """select 'inventory_shortage' as type, 'MEDIUM' as severity, count(*) as products from (
  select p_name || p_brand as k from part where p_partkey in (select l_partkey from lineitem) group by 1 having min(p_size) < 20) having count(*) > 0""")
def _(spark, sf):
    df = sales(spark, sf, "product_name", "brand", "inventory")
    return IN.inventory_shortage(MT.low_inventory(df.withColumn("product", F.concat("product_name", "brand")), "product", "inventory"))


@query("l9_recommendations", f"""with {_CHANGE_SQL}, f as (select * from changes where change_pct <= -10 order by change_pct, label limit 3),
rose as (select * from changes where change_pct >= 10 order by change_pct desc, label limit 1)
select 'Shrinking groups' as title, 'Below the period before: ' || string_agg(label || ' (' || change_pct || '%)', ', ' order by change_pct, label) as observation from f
union all select 'Fastest grower', label || ': up ' || change_pct || '% on the period before' from rose""")
def _(spark, sf):
    df = sales(spark, sf, "date", "customer_name", "revenue")
    return IN.recommendations(P.change_by_group(df, S, "customer_name", F.col("revenue"), _bounds(spark, sf)))


@query("l11_alert_dedup", f"with {_SERIES3} select region, metric, type, severity from alerts where not (region in ('ASIA', 'EUROPE') and metric = 'revenue')")
def _(spark, sf):
    fresh = IN.series_alerts(_key_series(spark, sf), ["region"]).select("region", "metric", "type", "severity")
    opened = fresh.where("region in ('ASIA', 'EUROPE') and metric = 'revenue'").select("region", "type", "metric")
    again = fresh.unionByName(fresh)  # the same alerts derived a second time
    return IN.new_alerts(again, opened, ["region", "type", "metric"])


_RULES = [(1, "revenue", "GT", 1000000.0), (2, "profit", "LT", 0.0), (3, "orders", "GTE", 100.0), (4, "margin", "LTE", 99.0), (5, "customers", "LT", 10.0), (6, "unknown", "GT", 0.0)]


@query("l12_threshold_rules", f"""with {SALES_SQL}, m as (select region, unnest(['revenue','profit','orders','customers','margin']) as metric,
    unnest([{O.r2('sum(revenue)')}, {O.r2('sum(revenue - cost)')}, count(distinct order_id), count(distinct customer_id), floor(sum(revenue - cost) / sum(revenue) * 100 * 10 + 0.5) / 10]) as value from sales group by region),
r(rule_id, metric, comparator, threshold) as (values {', '.join(str(r) for r in _RULES)})
select region, rule_id, m.metric, value from m join r on m.metric = r.metric
where case comparator when 'LT' then value < threshold when 'LTE' then value <= threshold when 'GT' then value > threshold else value >= threshold end""")
def _(spark, sf):
    df = sales(spark, sf, "region", "revenue", "cost", "order_id", "customer_id")
    revenue, profit = F.sum("revenue"), F.sum(F.col("revenue") - F.col("cost"))
    wide = df.groupBy("region").agg(
        round2(revenue).alias("revenue"), round2(profit).alias("profit"), F.count_distinct("order_id").cast("double").alias("orders"),
        F.count_distinct("customer_id").cast("double").alias("customers"), round_half_up(profit / revenue * 100, 1).alias("margin"))
    metrics = wide.unpivot(["region"], ["revenue", "profit", "orders", "customers", "margin"], "metric", "value")
    rules = spark.createDataFrame(_RULES, "rule_id int, metric string, comparator string, threshold double")
    return IN.rule_hits(metrics, rules).select("region", "rule_id", "metric", "value")


_TREE = ["region", "category", "department"]


def _tree_level(where, fields, level, name):
    return f"""g{level} as (""" + " union all ".join(f"select '{f}' as field, {f} as member, sum(revenue) as v from sales {where} group by 2" for f in _TREE) + f"""),
  t{level} as (select field, max_by(member, v) as top, max(v) / sum(v) as share, sum(v) as whole from g{level} {fields} group by 1 having count(*) >= 2),
  {name} as (select * from t{level} order by share desc, field limit 1)"""


@query("l13_decomposition_tree", f"""with {SALES_SQL}, {_tree_level('', '', 1, 'b1')},
{_tree_level("where case (select field from b1) when 'region' then region when 'category' then category else department end = (select top from b1)",
             "where field <> (select field from b1)", 2, 'b2')}
select 1 as level, g1.field, member, {O.r2('v')} as value, {O.half_up('v / whole * 100', 2)} as share_pct, member = top as picked from g1 join b1 on g1.field = b1.field
union all select 2, g2.field, member, {O.r2('v')}, {O.half_up('v / whole * 100', 2)}, member = top from g2 join b2 on g2.field = b2.field""")
def _(spark, sf):
    return DR.decomposition_tree(sales(spark, sf, "revenue", *_TREE), _TREE, F.col("revenue"), 2)


# --- shaping ------------------------------------------------------------------------------------------------

_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("p1_pivot_totals", f"""with {SALES_SQL} select 2 - grouping(department) - grouping(category) as depth, department, category, region, {O.r2('sum(revenue)')} as value
from sales group by grouping sets ((department, category, region), (department, region), (region))""")
def _(spark, sf):
    return RS.pivot_totals(sales(spark, sf, "department", "category", "region", "revenue"), ["department", "category"], "region", F.col("revenue"))


@query("p1_pivot_matrix", f"""with {SALES_SQL}, t as (select 2 - grouping(department) - grouping(category) as depth, department, category, region, {O.r2('sum(revenue)')} as value
from sales group by grouping sets ((department, category, region), (department, region), (region)))
select depth, department, category, """ + ", ".join(f"max(value) filter (region = '{r}') as \"{r}\"" for r in _REGIONS) + f", {O.r2('sum(value)')} as total from t group by 1, 2, 3")
def _(spark, sf):
    df = sales(spark, sf, "department", "category", "region", "revenue")
    return RS.pivot_matrix(df, ["department", "category"], "region", F.col("revenue"), _REGIONS)


@query("p2_percent_of_row", f"""with {SALES_SQL}, c as (select department, category, {O.r2("sum(case when region = 'ASIA' then -revenue else revenue end)")} as value from sales group by 1, 2)
select *, {O.half_up('abs(value) / sum(abs(value)) over (partition by department) * 100', 4)} as share_pct from c""")
def _(spark, sf):
    signed = F.when(F.col("region") == "ASIA", -F.col("revenue")).otherwise(F.col("revenue"))
    cells = sales(spark, sf, "department", "category", "region", "revenue").groupBy("department", "category").agg(round2(exact_sum(signed)).alias("value"))
    return RS.percent_of_row(cells, "department")


@query("p3_rank_by_period", f"""with {MONTHLY_SQL} select period, region, value, row_number() over (partition by period order by value desc, region) - 1 as rank,
  {O.r2('sum(value) over (partition by period order by value desc, region rows unbounded preceding) - value')} as band_from,
  {O.r2('sum(value) over (partition by period order by value desc, region rows unbounded preceding)')} as band_to from s""")
def _(spark, sf):
    return RS.rank_by_period(monthly(spark, sf), "region")


@query("p4_waterfall", f"""with {MONTHLY_SQL}, d as (select region, period, value - lag(value, 1, 0) over (partition by region order by period) as value from s),
c as (select *, sum(value) over (partition by region order by period rows unbounded preceding) as e from d)
select region, period, floor(value * 100 + 0.5) / 100 as value, {O.r2('least(e - value, e)')} as base, {O.r2('abs(value)')} as delta, {O.r2('e')} as cumulative, value >= 0 as positive from c""")
def _(spark, sf):
    deltas = P.series_change(monthly(spark, sf), ["region"]).select(
        "region", "period", (F.col("value") - F.coalesce("previous", F.lit(0.0))).alias("value"))
    return RS.waterfall(deltas, "period", ["region"]).withColumn("value", round_half_up(F.col("value"), 2))


@query("p5_quantile_buckets", f"""with {SALES_SQL}, t as (select state as label, {O.r2('sum(revenue)')} as value from sales group by 1),
o as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from t),
b as (select distinct value from o where i in (floor(0.2 * n), floor(0.4 * n), floor(0.6 * n), floor(0.8 * n)))
select label, value, cast((select count(*) from b where b.value <= t.value) as integer) as bucket from t""")
def _(spark, sf):
    return RS.quantile_buckets(MT.group_totals(sales(spark, sf, "state", "revenue"), S, "state"))


_STAGES = ["view", "click", "signup", "purchase"]


@query("p6_funnel", """with f as (select event_type as stage, cast(count(distinct event_id) as double) as value, list_position(['view','click','signup','purchase'], event_type) as position
  from events where event_type <> 'error' group by 1)
select position, stage, value, floor(value / first_value(value) over (order by position) * 100 * 100 + 0.5) / 100 as of_first_pct,
  floor(value / lag(value) over (order by position) * 100 * 100 + 0.5) / 100 as of_previous_pct from f""")
def _(spark, sf):
    return RS.funnel(load(spark, sf, "events"), "event_type", _STAGES, F.count("*"))


@query("p7_heatmap", "select dayofweek(ts) as x, hour(ts) as y, floor(sum(value) * 100 + 0.5) / 100 as value from events group by 1, 2")
def _(spark, sf):
    return RS.heatmap(load(spark, sf, "events"), F.dayofweek("ts") - 1, F.hour("ts"), round_half_up(F.sum("value"), 2))


# --- scenarios and evidence -------------------------------------------------------------------------------------

_LEVERS = [SC.Lever("revenue", 5), SC.Lever("revenue", -2), SC.Lever("cost", 10), SC.Lever("unit_price", 50), SC.Lever("quantity", 0)]


@query("n1_apply_levers", f"""with {SALES_SQL} select brand, {O.r2('sum(floor(revenue * (1.05 * 0.98) * 1e6 + 0.5) / 1e6)')} as revenue, {O.r2('sum(floor(cost * 1.1 * 1e6 + 0.5) / 1e6)')} as cost,
  {O.r2('sum(quantity)')} as quantity from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "brand", "revenue", "cost", "quantity")
    changed = SC.apply_levers(df, schema_of(df), _LEVERS)
    return changed.groupBy("brand").agg(*[round2(exact_sum(c)).alias(c) for c in ("revenue", "cost", "quantity")])


@query("n3_scenario_kpis", f"""with {SALES_SQL}, s as (select *, floor(revenue * (1.05 * 0.98) * 1e6 + 0.5) / 1e6 as r2_, floor(cost * 1.1 * 1e6 + 0.5) / 1e6 as c2_ from sales),
f as (select unnest(['revenue','profit','orders','customers','margin']) as kpi,
  unnest([{O.r2('sum(revenue)')}, {O.r2('sum(revenue - cost)')}, count(distinct order_id), count(distinct customer_id), {O.r2('sum(revenue - cost) / sum(revenue) * 100')}]) as base,
  unnest([{O.r2('sum(r2_)')}, {O.r2('sum(r2_ - c2_)')}, count(distinct order_id), count(distinct customer_id), {O.r2('sum(r2_ - c2_) / sum(r2_) * 100')}]) as scenario from s)
select kpi, base, scenario, floor((scenario - base) * 100 + 0.5) / 100 as difference from f""")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "revenue", "cost")
    return SC.compare_scenario(df, schema_of(df), _LEVERS, _bounds(spark, sf))


_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority
  || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || cast(floor(o_totalprice * 100 + 0.5) as bigint) || '}'"""


@query("q1_fingerprint", f"""with h as (select sha256({_JSON}) as h from orders)
select count(*) as n_rows, """ + ", ".join(
    f"cast(sum(cast('0x' || substr(h, {1 + i * 12}, 12) as bigint)) as varchar) as part_{i}" for i in range(5)) + " from h")
def _(spark, sf):
    return EV.fingerprint(load(spark, sf, "orders").select(
        "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("o_totalprice")))


@query("q3_kpi_evidence")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "product_name", "region", "revenue", "cost")
    filters = Filters("1998-01-01", "1998-12-31", {"region": "ASIA"})
    bounds = P.period_bounds(sales(spark, sf, "date", "region"), S, filters)
    return EV.evidence_rows(EV.kpi_evidence(df, schema_of(df), "revenue", filters=filters, bounds=bounds))


_Q3 = "region = 'ASIA' and date between '1998-01-01' and '1998-12-31'"


@query("q3_evidence_figures", f"""with {SALES_SQL}, a as (select *, date between '1998-01-01' and '1998-12-31' as cur, date between '1997-01-01' and '1997-12-31' as prev from sales where region = 'ASIA'),
t as (select sum(revenue) filter (cur) as c, sum(revenue) filter (prev) as p from a),
g as (select {O.group_label('product_name')} as member, coalesce(sum(revenue) filter (cur), 0) as c, coalesce(sum(revenue) filter (prev), 0) as p from a where cur or prev group by 1),
r as (select member, {O.r2('c - p')} as delta, row_number() over (order by abs({O.r2('c - p')}) desc, member) as rank, count(*) over () as n, {O.r2('sum(c - p) over ()')} as whole from g where {O.r2('c - p')} <> 0)
select 'figure' as block, 'value' as key, {O.r2('c')} as value from t union all select 'figure', 'change_pct', {O.pct('c', 'p')} from t
union all select 'compared', 'value', {O.r2('c')} from t union all select 'compared', 'previous', {O.r2('p')} from t
union all select 'inputs', 'n', count(*) from sales where {_Q3} union all select 'inputs', 'included', count(revenue) from sales where {_Q3} union all select 'inputs', 'missing', count(*) - count(revenue) from sales where {_Q3}
union all select 'exclusions', 'filter:date', count(*) filter (date not between '1998-01-01' and '1998-12-31') from sales
union all select 'exclusions', 'filter:region', count(*) filter (date between '1998-01-01' and '1998-12-31' and region <> 'ASIA') from sales
union all select 'drivers', member, delta from r where rank <= 10
union all select 'drivers', '(other)', {O.r2('sum(delta) filter (rank > 10)')} from r having count(*) > 10
union all select 'fingerprint', 'n_rows', count(*) from sales""")
def _(spark, sf):
    """The numbers among the evidence, as one table."""
    df = sales(spark, sf, "date", "order_id", "customer_id", "product_name", "region", "revenue", "cost")
    filters = Filters("1998-01-01", "1998-12-31", {"region": "ASIA"})
    bounds = P.period_bounds(sales(spark, sf, "date", "region"), S, filters)
    parts = EV.kpi_evidence(df, schema_of(df), "revenue", filters=filters, bounds=bounds)
    wide = {"figure": ["value", "change_pct"], "compared": ["value", "previous"], "inputs": ["n", "included", "missing"], "fingerprint": ["n_rows"]}
    out = None
    for block, columns in wide.items():
        one = parts[block].select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "key", "value")
        rows = one.select(F.lit(block).alias("block"), "key", "value")
        out = rows if out is None else out.unionByName(rows)
    for block, key, value in (("exclusions", "reason", "excluded"), ("drivers", "member", "delta")):
        out = out.unionByName(parts[block].select(F.lit(block).alias("block"), F.col(key).alias("key"), F.col(value).cast("double").alias("value")))
    return out
