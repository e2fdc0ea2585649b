"""Customer value, churn and baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numbers import round2, round_half_up
from tallyloom.operators import basket as B, customers as CU, metrics as MT
from tallyloom.plans import oracle as O
from tallyloom.plans.registry import query
from tallyloom.plans.views import SALES_SCHEMA as S, SALES_SQL, load, sales
from tallyloom.session import materialise


@query("o1_value_tiers", f"""with {SALES_SQL}, t as (select customer_name as member, {O.r2('sum(revenue)')} as value from sales group by 1 having sum(revenue) > 0),
q as (select quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3, sum(value) as w from t),
x as (select t.*, case when value >= q3 then 'high' when value >= med then 'mid' else 'low' end as tier, med, q3, w from t, q),
r as (select *, row_number() over (partition by tier order by value desc, member) as r from x)
select tier, count(*) as members, {O.r2('sum(value)')} as total, {O.r2(O.r2('sum(value)') + ' / count(*)')} as average, {O.r2('sum(value) / max(w) * 100')} as share_pct,
  {O.r2('max(med)')} as median, {O.r2('max(q3)')} as q3, string_agg(member, ', ' order by r) filter (r <= 12) as top_members from r group by 1""")
def _(spark, sf):
    return CU.value_tiers(MT.group_totals(sales(spark, sf, "customer_name", "revenue"), S, "customer_name"), "label")


@query("o2_rfm", f"""with {SALES_SQL} select customer_id, (select max(date) from sales) - max(date) as recency_days, count(distinct order_id) as frequency, {O.r2('sum(revenue)')} as monetary
from sales group by 1""")
def _(spark, sf):
    return CU.rfm(sales(spark, sf, "customer_id", "date", "order_id", "revenue"), "customer_id", "date", "order_id", "revenue")


_PARTLY = "case when o_orderkey % 5 = 0 then ' ' else 'A' || (o_orderkey % 4000) end"


@query("o3_order_fallback", f"""with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as d, {_PARTLY} as partly from orders)
select o_orderkey, coalesce(nullif(trim(partly), ''), 'row-' || o_orderkey) as partly_key, o_custkey || '|' || d as blank_key from o""")
def _(spark, sf):
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), F.expr(_PARTLY).alias("partly"), F.lit("  ").alias("blank"))
    partly = CU.with_order_keys(orders, "o_custkey", "d", "partly", "o_orderkey").withColumnRenamed("order_key", "partly_key")
    return CU.with_order_keys(partly, "o_custkey", "d", "blank", "o_orderkey").select(
        "o_orderkey", "partly_key", F.col("order_key").alias("blank_key"))


def _rfm(spark, sf):
    return CU.rfm(sales(spark, sf, "customer_id", "date", "order_id", "revenue"), "customer_id", "date", "order_id", "revenue")


@query("o4_rfm_clusters")
def _(spark, sf):
    return CU.cluster(_rfm(spark, sf))[0].select("customer_id", "cluster", "recency_days", "frequency", "monetary")


@query("o5_cluster_description")
def _(spark, sf):
    return CU.describe_clusters(CU.cluster(_rfm(spark, sf))[0])


def _average_rank(column, order=""):
    return f"(rank() over (order by {column}{order}) + (count(*) over (partition by {column}) - 1) / 2.0)"


def _unit(column):
    return f"case when max({column}) over () > min({column}) over () then ({column} - min({column}) over ()) / (max({column}) over () - min({column}) over ()) else 0.5 end"


@query("o5_described_segments", f"""with {SALES_SQL}, r as (select customer_id, (select max(date) from sales) - max(date) as recency_days, count(distinct order_id) as frequency, {O.r2('sum(revenue)')} as monetary from sales group by 1),
c as (select (customer_id % 4 + case when monetary > 2000000 then 4 else 0 end)::int as cluster, count(*) as size, avg(recency_days) as recency_days, avg(frequency) as frequency, avg(monetary) as monetary, sum(monetary) as revenue from r group by 1),
k as (select *, {_average_rank('recency_days', ' desc')} as r_, {_average_rank('frequency')} + {_average_rank('monetary')} as fm from c),
v as (select *, {_average_rank('fm')} as v_ from k), u as (select *, {_unit('r_')} as recent, {_unit('v_')} as worth from v),
n as (select *, case when recent >= 0.6 and worth >= 0.6 then 'Champions' when recent >= 0.6 and worth <= 0.4 then 'New' when recent <= 0.4 and worth >= 0.6 then 'At risk'
  when recent <= 0.4 and worth <= 0.4 then 'Hibernating' else 'Loyal' end as name_ from u)
select cluster, case when count(*) over (partition by name_) > 1 then name_ || ' ' || row_number() over (partition by name_ order by monetary desc, cluster) else name_ end as name, size,
  {O.r2('revenue')} as revenue, {O.half_up('revenue / sum(revenue) over ()', 4)} as revenue_share, {O.half_up('recency_days', 1)} as recency_days, {O.r2('frequency')} as frequency, {O.r2('monetary')} as monetary from n""")
def _(spark, sf):
    """The description over a grouping that SQL can make too."""
    grouped = _rfm(spark, sf).withColumn("cluster", (F.col("customer_id") % 4 + F.when(F.col("monetary") > 2_000_000, 4).otherwise(0)).cast("int"))
    return CU.describe_clusters(grouped)


# --- churn --------------------------------------------------------------------------------------------------


def _purchases(spark, sf):
    df = sales(spark, sf, "customer_id", "order_id", "date", "revenue")
    return df.select(F.col("customer_id").alias("customer"), F.col("order_id").alias("order_key"), "date", "revenue")


_CUTS_SQL = f"""{SALES_SQL}, sp as (select min(date) as a, max(date) as z from sales),
cuts as (select a + cast(floor((z - a) * 0.5) as integer) as t1, a + cast(floor((z - a) * 0.75) as integer) as t2, z from sp)"""


def _features_sql(cut, name):
    return f"""{name}_o as (select customer_id as customer, order_id, min(date) as day, sum(revenue) as r from sales, cuts where date <= {cut} group by 1, 2),
{name}_w as (select *, day - lag(day) over (partition by customer order by day, cast(order_id as varchar)) as gap, row_number() over (partition by customer order by day, order_id) as i, count(*) over (partition by customer) as n from {name}_o),
{name}_g as (select customer, median(gap) as own, stddev_samp(gap) as sd from {name}_w where gap is not null group by 1),
{name}_b as (select customer, max(day) as last, min(day) as first, count(*) as n, sum(r) as r, coalesce(sum(r) filter (i <= floor(n / 2)), 0) as e from {name}_w group by 1),
{name} as (select b.customer, cast({cut} - last as double) as recency_days, cast(n as double) as frequency, cast({cut} - first as double) as tenure_days, r / n as avg_order_value,
  case when n < 2 then 0.0 else (r - e - e) / (e + 1.0) end as spend_trend, coalesce(sd, 0) as gap_sd, r as revenue,
  coalesce(nullif(own, 0), coalesce((select median(own) from {name}_g), 30.0)) as typical_gap from {name}_b b left join {name}_g g on b.customer = g.customer, cuts)"""


_MONEY, _ROUNDED = ["avg_order_value", "revenue"], ["spend_trend", "gap_sd", "typical_gap"]
_FEATURE_SELECT = "customer, recency_days, frequency, tenure_days, " + ", ".join(
    [f"{O.r2(c)} as {c}" for c in _MONEY] + [f"{O.half_up(c, 4)} as {c}" for c in _ROUNDED])


def _rounded(df):
    rule = {c: round2 for c in _MONEY} | {c: lambda x: round_half_up(x, 4) for c in _ROUNDED}
    return [rule[c](F.col(c)).alias(c) if c in rule else F.col(c) for c in df.columns]


@query("o6_churn_features", f"with {_CUTS_SQL}, {_features_sql('t2', 'f')} select {_FEATURE_SELECT} from f")
def _(spark, sf):
    rows = _purchases(spark, sf)
    features = CU.churn_features(rows, CU.time_cuts(rows)["test"])
    return features.select(*_rounded(features))


_LABEL_SQL = "(select customer_id as customer, max(date) as latest from sales, cuts where date <= {at} group by 1)"


@query("o7_churn_label", f"""with {_CUTS_SQL}, {_features_sql('t1', 'f')}
select f.customer, case when t2 - latest > typical_gap * 2.0 then 1 else 0 end as churned from f join {_LABEL_SQL.format(at='t2')} l on f.customer = l.customer, cuts""")
def _(spark, sf):
    rows = _purchases(spark, sf)
    cuts = CU.time_cuts(rows)
    return CU.churn_labels(rows, CU.churn_features(rows, cuts["train"]), cuts["test"]).select("customer", "churned")


@query("o8_time_split", f"""with {_CUTS_SQL}, {_features_sql('t1', 'f')}, {_features_sql('t2', 'g')},
tr as (select case when t2 - latest > typical_gap * 2.0 then 1 else 0 end as churned from f join {_LABEL_SQL.format(at='t2')} l on f.customer = l.customer, cuts),
te as (select case when z - latest > typical_gap * 2.0 then 1 else 0 end as churned from g join {_LABEL_SQL.format(at='z')} l on g.customer = l.customer, cuts)
select (select count(*) from tr) as train_n, (select sum(churned) from tr)::bigint as train_churned, (select count(*) from te) as test_n, (select sum(churned) from te)::bigint as test_churned,
  (select z - a from sp) as span_days, (select count(distinct customer_id) from sales) as customers, null as reason""")
def _(spark, sf):
    rows = _purchases(spark, sf)
    cuts = CU.time_cuts(rows)
    train, test = CU.training_windows(rows, cuts)
    return CU.window_report(train, test, cuts, rows.select("customer").distinct().count())


@query("o9_churn_scores")
def _(spark, sf):
    scored, report = CU.churn_scores(_purchases(spark, sf))
    auc = report.select("auc").scalar()
    return scored.select("customer", round_half_up(F.col("risk"), 4).alias("risk"), round2(F.col("revenue")).alias("revenue"),
                         round_half_up(auc, 4).alias("auc"))


@query("o10_churn_factors")
def _(spark, sf):
    scored, _ = CU.churn_scores(_purchases(spark, sf))
    return scored.select("customer", round_half_up(F.col("risk"), 4).alias("risk"),
                         F.col("factors") if "factors" in scored.columns else F.lit("").alias("factors"))


# --- baskets ---------------------------------------------------------------------------------------------------


def _baskets(spark, sf, product="brand"):
    return B.basket_rows(sales(spark, sf, "order_id", product), "order_id", product)


_BASKET_SQL = f"{SALES_SQL}, b as (select distinct cast(order_id as varchar) as o, trim(brand) as p from sales where brand is not null)"


@query("o11_basket_gates", f"""with {_BASKET_SQL}, s as (select o, count(*) as k from b group by 1),
g as (select count(*) as orders, avg(case when k >= 2 then 1.0 else 0.0 end) as m, avg(k) as mean from s)
select orders, {O.half_up('m', 4)} as multi_share, {O.r2('mean')} as mean_basket, case when orders < 200 or m < 0.15 or mean <= 1.2 then 'insufficient_data' else 'ok' end as status,
  case when orders < 200 then 'too few orders' when m < 0.15 or mean <= 1.2 then 'too few orders hold more than one product' end as reason from g""")
def _(spark, sf):
    return B.basket_gates(_baskets(spark, sf))


@query("o12_product_cap", f"""with {SALES_SQL}, b as (select distinct order_id as o, cast(product_id as varchar) as p from sales),
t as (select p, count(*) as n from b group by 1 order by n desc, p limit 500)
select p as product, count(*) as orders from b where p in (select p from t) group by 1""")
def _(spark, sf):
    return B.best_sellers(_baskets(spark, sf, "product_id"), 500).groupBy("product").agg(F.count("*").alias("orders"))


def _rule_sql(rows):
    return f"""with {_BASKET_SQL}, n as (select count(distinct o) as n from b), i as (select p, count(*) / max(n) as s from b, n group by 1),
pr as (select x.p as a, y.p as c, count(*) as k, count(*) / max(n) as s from b x join b y on x.o = y.o and x.p <> y.p, n group by 1, 2 having count(*) / max(n) >= 0.01)
{rows}"""


# Brands number a few dozen and no three of them meet in one order of a hundred, so SQL stops at pairs and
# checks that: a frequent set of three would be a row the other side does not have.
@query("o13_frequent_itemsets", _rule_sql(f"""select p as items, cast(round(i.s * n) as bigint) as n, {O.half_up('i.s', 4)} as support from i, n where i.s >= 0.01
union all select a || ', ' || c, k, {O.half_up('s', 4)} from pr where a < c
union all select a || ', ' || c || ', ' || d, k, {O.half_up('k / n', 4)} from (select x.p as a, y.p as c, z.p as d, count(*) as k from b x join b y on x.o = y.o and x.p < y.p
  join b z on x.o = z.o and y.p < z.p group by 1, 2, 3), n where k / n >= 0.01"""))
def _(spark, sf):
    return B.frequent_itemsets(_baskets(spark, sf)).select(F.concat_ws(", ", "items").alias("items"), "n", round_half_up(F.col("support"), 4).alias("support"))


_PAIR_RULES = f"""select a as buys, c as also_buys, k as orders, {O.half_up('pr.s', 4)} as support, {O.half_up('pr.s / ia.s', 4)} as confidence, {O.half_up('pr.s / ia.s / ic.s', 3)} as lift
from pr join i ia on ia.p = a join i ic on ic.p = c where pr.s / ia.s >= 0.1 and pr.s / ia.s / ic.s > 1"""


@query("o14_association_rules", _rule_sql(_PAIR_RULES))
def _(spark, sf):
    return B.association_rules(B.frequent_itemsets(_baskets(spark, sf)))


@query("o14_pair_rules", _rule_sql(_PAIR_RULES))
def _(spark, sf):
    return B.association_rules(B.frequent_pairs(_baskets(spark, sf)))


@query("o15_refusal_status", f"""with {SALES_SQL}, s as (select department, category, brand, count(distinct customer_id) as customers, max(date) - min(date) as span_days from sales group by 1, 2, 3)
select department, category, brand, customers, span_days, case when span_days < 365 or customers < 100 then 'insufficient_data' else 'ok' end as status,
  case when span_days < 365 then 'the data covers too few days' when customers < 100 then 'too few customers have usable history' end as reason from s""")
def _(spark, sf):
    # A group is a number until the end, so no name is sorted or grouped with the order lines; nothing known is null.
    numbered = lambda df: materialise(df.distinct().withColumn("_no", F.monotonically_increasing_id()), "numbered")
    parts = load(spark, sf, "part").selectExpr("p_partkey", "p_type as category", "p_brand as brand")
    kinds = numbered(parts.select("category", "brand").where("category is not null or brand is not null")).withColumnRenamed("_no", "kind")
    same = [parts[c].eqNullSafe(kinds[c]) for c in ("category", "brand")]
    part_kinds = parts.join(kinds, same, "left").select("p_partkey", "kind").distinct()
    buyers = load(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment as department")
    departments = numbered(buyers.select("department").where("department is not null")).withColumnRenamed("_no", "unit")
    buyer_units = buyers.join(departments, "department", "left").select("c_custkey", "unit").distinct()
    lines = sales(spark, sf, "customer_id", "date", "product_id")
    lines = lines.join(part_kinds, F.col("product_id") == F.col("p_partkey"), "left")
    bought = lines.groupBy("customer_id", "kind").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    bought = bought.join(buyer_units, F.col("customer_id") == F.col("c_custkey"), "left")
    # a customer is there once in each group
    groups = bought.groupBy("unit", "kind").agg(F.count("customer_id").alias("customers"), F.datediff(F.max("last"), F.min("first")).alias("span_days"))
    each = groups.join(departments, "unit", "left").join(kinds, "kind", "left").select("department", "category", "brand", "customers", "span_days")
    return CU.status_row(each, [(F.col("span_days") < CU.MIN_SPAN_DAYS, "the data covers too few days"),
                                (F.col("customers") < CU.MIN_CUSTOMERS, "too few customers have usable history")])


@query("o16_capped_list", f"""with {SALES_SQL} select customer_id, (select max(date) from sales) - max(date) as recency_days, count(distinct order_id) as frequency, {O.r2('sum(revenue)')} as monetary
from sales group by 1 order by monetary desc, customer_id limit 5000""")
def _(spark, sf):
    return CU.highest(_rfm(spark, sf), "monetary", "customer_id", 5000)
