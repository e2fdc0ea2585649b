"""Filters, key figures, series and period comparison over the sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.context import Calendar, Filters
from tallyloom.functions.calendar import period_key
from tallyloom.functions.numbers import exact_sum, pct_change, round2
from tallyloom.operators import compare as P, filters as FL, formats as FM, metrics as MT
from tallyloom.plans import oracle as O
from tallyloom.plans.registry import query
from tallyloom.plans.scalars import APRIL, RETAIL, _iso_sql, grain_key_sql
from tallyloom.plans.views import MESSY_SQL, SALES_SCHEMA, SALES_SQL, load, messy, sales

S = SALES_SCHEMA


def schema_of(df) -> dict:
    """The part of the sales schema map a narrow frame can answer."""
    return {k: v for k, v in S.items() if v in df.columns}


TRAILING_SQL = """span as (select min(date) lo, max(date) hi, cast(floor((max(date) - min(date) + 1) / 2) as integer) half from sales),
w as (select hi - half + 1 as cf, hi as ct, hi - half - half + 1 as pf, hi - half as pt from span)"""
SIDES_SQL = f"""{SALES_SQL}, {TRAILING_SQL},
tagged as (select sales.*, date between cf and ct as cur, date between pf and pt as prev, cf, ct, pf, pt from sales, w)"""

# --- filters --------------------------------------------------------------------------------

_F1 = Filters(slots={"region": ["asia", " EUROPE "], "category": "economy"})


@query("f1_dimension_filter", f"""with {SALES_SQL}
select department as label, {O.r2('sum(revenue)')} as value from sales
where lower(trim(region)) in ('asia', 'europe') and lower(trim(category)) = 'economy' group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "region", "category", "department", "revenue")
    return MT.group_totals(df, schema_of(df), "department", "revenue", _F1)


@query("f1_unmapped_filter", f"""with {SALES_SQL} select count(*) as n from sales where false""")
def _(spark, sf):
    df = sales(spark, sf, "region", "revenue")
    kept = FL.apply_filters(df, schema_of(df), Filters(slots={"city": "Fresno"}))
    return kept.agg(F.count("*").alias("n"))


@query("f2_any_column_filter", f"""with {SALES_SQL}
select brand, count(*) as n, {O.r2('sum(revenue)')} as value from sales
where lower(brand) in ('brand#1', 'brand#2') and lower(cast(line_no as varchar)) = '2' group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "brand", "line_no", "revenue")
    kept = FL.apply_filters(df, schema_of(df), Filters(columns={"brand": ["BRAND#1", "brand#2"], "line_no": ["2"]}))
    return kept.groupBy("brand").agg(F.count("*").alias("n"), round2(F.sum("revenue")).alias("value"))


@query("f3_date_filter", f"""with {MESSY_SQL}
select iso_text, count(*) as n from messy where try_cast(trim(iso_text) as date) is null
  or try_cast(trim(iso_text) as date) between date '1996-03-01' and date '1996-03-31' group by 1""")
def _(spark, sf):
    df = messy(spark, sf).select("iso_text")
    kept = FL.apply_filters(df, {"date": "iso_text"}, Filters("1996-03-01", "1996-03-31"))
    return kept.groupBy("iso_text").agg(F.count("*").alias("n"))


_WRITTEN = f"{MESSY_SQL}, m as (select order_key, try_cast({_iso_sql('dmy_text', chr(39) + 'dmy' + chr(39))} as date) as d, try_cast({_iso_sql('mdy_text', chr(39) + 'mdy' + chr(39))} as date) as e from messy)"


@query("f3_written_dates", f"""with {_WRITTEN} select d as dmy_text, count(*) as n from m where d is null or d between date '1996-03-01' and date '1996-03-31' group by 1""")
def _(spark, sf):
    """A window over dates that are written day first."""
    df = FM.with_dates(messy(spark, sf).select("dmy_text"), ["dmy_text"])
    kept = FL.apply_filters(df, {"date": "dmy_text"}, Filters("1996-03-01", "1996-03-31"))
    return kept.groupBy("dmy_text").agg(F.count("*").alias("n"))


@query("h7_written_dates", f"""with {_WRITTEN} select 'dmy' as "order", strftime(d, '%Y-%m') as period, sum(order_key % 100)::double as value from m where d is not null group by 2
union all select 'mdy', strftime(e, '%Y-%m'), sum(order_key % 100)::double from m where e is not null group by 2""")
def _(spark, sf):
    """Monthly series over dates that are written day first and month first."""
    df = FM.with_dates(messy(spark, sf).select("dmy_text", "mdy_text", (F.col("order_key") % 100).alias("x")), ["dmy_text", "mdy_text"])
    out = [MT.time_series(df, {"date": c, "revenue": "x"}).select(F.lit(c[:3]).alias("order"), "period", "value") for c in ("dmy_text", "mdy_text")]
    return out[0].unionByName(out[1])


_RAW = "try_cast(regexp_replace(trim(amount_text), '[$€£₹,()]', '', 'g') as double)"


@query("f4_metric_row_filter", f"""with {MESSY_SQL}, v as (select *, {_RAW} as raw, coalesce({O.parse_number('amount_text')}, 0) as a from messy)
select count(*) filter (raw is not null and a > 250000) as above,
  count(*) filter (raw is not null and a <= 0) as not_positive,
  count(*) filter (lower(trim(flag_text)) = 'yes') as yes,
  count(*) filter (lower(coalesce(trim(flag_text), '')) <> 'yes') as not_yes,
  count(*) filter (false) as text_order from v""")
def _(spark, sf):
    df = messy(spark, sf).select("amount_text", "flag_text")

    def n(column, op, value, name):
        return F.count_if(FL.row_condition(df, column, op, value)).alias(name)

    return df.agg(
        n("amount_text", "gt", 250000, "above"), n("amount_text", "lte", "0", "not_positive"),
        n("flag_text", "eq", "YES", "yes"), n("flag_text", "ne", "yes", "not_yes"), n("flag_text", "gt", "a", "text_order"))


_F5 = Filters("1996-01-01", "1998-12-31", {"region": ["ASIA", "EUROPE"], "category": ["PROMO", "SMALL"], "department": "BUILDING"})


@query("f5_cascade_exclusions", f"""with {SALES_SQL}, p as (select date between '1996-01-01' and '1998-12-31' as a,
  region in ('ASIA','EUROPE') as b, category in ('PROMO','SMALL') as c, department = 'BUILDING' as d from sales),
x as (select 'filter:date' as reason, count(*) filter (not a) as excluded from p
  union all select 'filter:region', count(*) filter (a and not b) from p
  union all select 'filter:category', count(*) filter (a and b and not c) from p
  union all select 'filter:department', count(*) filter (a and b and c and not d) from p)
select * from x where excluded > 0""")
def _(spark, sf):
    df = sales(spark, sf, "date", "region", "category", "department")
    return FL.cascade_exclusions(df, schema_of(df), _F5)


@query("f7_drill_down", f"""with {SALES_SQL}
select 'down' as step, state as label, {O.r2('sum(revenue)')} as value from sales where region = 'ASIA' group by 1, 2
union all select 'up', region, {O.r2('sum(revenue)')} from sales group by 1, 2""")
def _(spark, sf):
    df = sales(spark, sf, "region", "state", "revenue")
    schema = schema_of(df)
    geography = FL.GEOGRAPHY.available(schema)
    down = geography.drill_to(Filters(), "region", "asia")
    up = geography.drill_up(down, None)

    def level(name, filters):
        return MT.group_totals(df, schema, geography.next_level(filters), "revenue", filters).select(
            F.lit(name).alias("step"), "label", "value")

    return level("down", down).unionByName(level("up", up))


@query("f8_date_drill", f"""with {SALES_SQL}
select {grain_key_sql('date', APRIL)} as period, {O.r2('sum(revenue)')} as value from sales
where date between '1996-10-01' and '1996-12-31' group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue")
    inside = FL.date_drill(df, S, "1996-Q3", APRIL)
    return inside.groupBy(F.col("bucket").alias("period")).agg(round2(exact_sum("revenue")).alias("value"))


_F8_DAYS = """days as (select cast(unnest(generate_series(date '1990-01-01', date '2010-12-31', interval 1 day)) as date) as d)"""
_F8_TRAIL = " union all ".join(
    f"select {i} as depth, {grain_key_sql('d', RETAIL, g)} as key, min(d) f, max(d) t from days group by 2"
    for i, g in ((1, "year"), (2, "quarter"), (3, "period")))


@query("f8_date_path", f"""with {_F8_DAYS}, trail as ({_F8_TRAIL}),
leaves as (select distinct {grain_key_sql('cast(o_orderdate as date)', RETAIL)} as leaf from orders),
starts as (select leaf, f as d from leaves join trail on key = leaf)
select leaf, 0 as depth, null as key, 'All dates' as label, null as date_from, null as date_to from leaves
union all select leaf, depth, key, case depth when 1 then key when 2 then left(key, 6) || ' ' || right(key, 2)
    else left(key, 6) || ' P' || cast(right(key, 2) as integer) end, cast(f as varchar), cast(t as varchar)
  from starts join trail on f <= d and t >= d""")
def _(spark, sf):
    days = load(spark, sf, "orders").select(period_key(F.to_date("o_orderdate"), RETAIL).alias("leaf")).distinct()
    return FL.date_path(days, "leaf", RETAIL)


@query("f9_table_search", """select o_orderkey, o_orderpriority, cast(o_orderdate as date)::varchar as day from (
  select * from orders where contains(lower(o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus), 'urgent')
  )""")
def _(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    hits = FL.text_search(df, "Urgent", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    page = FL.sort_rows(hits, "o_orderdate", descending=True, ties=["o_orderkey"])
    return page.select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").cast("string").alias("day"))


@query("f10_range_slicer", """select l_returnflag as flag, count(*) as n from lineitem
where l_extendedprice >= 20000 and l_extendedprice <= 30000 group by 1""")
def _(spark, sf):
    kept = FL.range_filter(load(spark, sf, "lineitem"), "l_extendedprice", 20000, 30000)
    return kept.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


# --- key figures ------------------------------------------------------------------------------


def _sum_by_side(name, e, digits=None):
    return f"""select '{name}' as measure, sum({e}) as v, sum(case when cur then {e} end) as c, sum(case when prev then {e} end) as p from tagged"""


@query("h1_row_revenue", f"""with {SALES_SQL}
select category, {O.r2('sum(revenue)')} as stored, {O.r2('sum(quantity * unit_price)')} as derived, 0.0 as unavailable
from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "category", "revenue", "quantity", "unit_price")
    derived = {"quantity": "quantity", "unit_price": "unit_price"}
    return df.groupBy("category").agg(
        round2(exact_sum(MT.row_revenue(df, S))).alias("stored"),
        round2(exact_sum(MT.row_revenue(df, derived))).alias("derived"),
        round2(exact_sum(MT.row_revenue(df, {}))).alias("unavailable"))


@query("h2_row_profit", f"""with {SALES_SQL}
select category, {O.r2('sum(revenue - cost)')} as from_cost, {O.r2('sum(cost)')} as stored, 0.0 as unavailable from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "category", "revenue", "cost")
    return df.groupBy("category").agg(
        round2(exact_sum(MT.row_profit(df, S))).alias("from_cost"),
        round2(exact_sum(MT.row_profit(df, {"profit": "cost"}))).alias("stored"),
        round2(exact_sum(MT.row_profit(df, {"revenue": "revenue"}))).alias("unavailable"))


_COUNTS = " union all ".join(
    f"""select '{m}', count(distinct {c}), count(distinct case when cur then {c} end), count(distinct case when prev then {c} end) from tagged"""
    for m, c in (("orders", "order_id"), ("customers", "customer_id")))


@query("h3_overview", f"""with {SIDES_SQL}, f as ({_sum_by_side('revenue', 'revenue')} union all {_sum_by_side('profit', 'revenue - cost')} union all {_COUNTS})
select measure, {O.r2('v')} as value, {O.r2('p')} as previous, {O.pct('c', 'p')} as change_pct from f
union all select 'margin', floor(sum(revenue - cost) / sum(revenue) * 100 * 10 + 0.5) / 10, null, null from tagged""")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "revenue", "cost")
    bounds = P.period_bounds(sales(spark, sf, "date"), S)
    return MT.overview(df, schema_of(df), bounds=bounds)


_USER_METRICS = [
    MT.MetricSpec("units", "Units", "sum", field="quantity"),
    MT.MetricSpec("avg_line", "Average line", "avg", "money", field="revenue", filter=("quantity", "gt", 10)),
    MT.MetricSpec("big_lines", "Big lines", "count", filter=("revenue", "gte", 50000)),
    MT.MetricSpec("cost_share", "Cost share", "ratio", "percent", field="cost", denominator="revenue"),
]


@query("h4_kpi_table", f"""with {SIDES_SQL}, f as ({_sum_by_side('revenue', 'revenue')} union all {_sum_by_side('profit', 'revenue - cost')} union all {_COUNTS}
  union all select 'margin', sum(revenue - cost) / sum(revenue) * 100, null, null from tagged
  union all {_sum_by_side('units', 'quantity')}
  union all select 'avg_line', {O.r2('avg(revenue) filter (quantity > 10)')}, {O.r2('avg(revenue) filter (quantity > 10 and cur)')}, {O.r2('avg(revenue) filter (quantity > 10 and prev)')} from tagged
  union all select 'big_lines', count(*) filter (revenue >= 50000), count(*) filter (revenue >= 50000 and cur), count(*) filter (revenue >= 50000 and prev) from tagged
  union all select 'cost_share', floor(sum(cost) / sum(revenue) * 100 * 10 + 0.5) / 10, null, null from tagged),
names(position, kpi, label, format) as (values (0, 'revenue', 'Revenue', 'money'), (1, 'profit', 'Profit', 'money'), (2, 'orders', 'Orders', 'number'),
  (3, 'customers', 'Customers', 'number'), (4, 'margin', 'Margin', 'percent'), (5, 'units', 'Units', 'number'),
  (6, 'avg_line', 'Average line', 'money'), (7, 'big_lines', 'Big lines', 'number'), (8, 'cost_share', 'Cost share', 'percent'))
select position, kpi, label, format, {O.r2('v')} as value, {O.pct('c', 'p')} as change_pct from f join names on kpi = measure""")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "revenue", "cost", "quantity")
    bounds = P.period_bounds(sales(spark, sf, "date"), S)
    return MT.kpi_table(df, schema_of(df), metrics=_USER_METRICS, bounds=bounds)


_H4F = Filters("1998-01-01", "1998-06-30", {"region": "ASIA"})


@query("h4_kpi_table_filtered", f"""with {SALES_SQL}, tagged as (select *, true as flt, date between '1998-01-01' and '1998-06-30' as cur,
    date between '1997-01-01' and '1997-06-30' as prev from sales where region = 'ASIA'),
f as (select 'revenue' as kpi, sum(case when cur then revenue end) v, sum(case when prev then revenue end) p from tagged
  union all select 'profit', sum(case when cur then revenue - cost end), sum(case when prev then revenue - cost end) from tagged
  union all select 'orders', count(distinct case when cur then order_id end), count(distinct case when prev then order_id end) from tagged
  union all select 'customers', count(distinct case when cur then customer_id end), count(distinct case when prev then customer_id end) from tagged
  union all select 'margin', sum(case when cur then revenue - cost end) / sum(case when cur then revenue end) * 100, null from tagged)
select kpi, {O.r2('v')} as value, {O.pct('v', 'p')} as change_pct from f""")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "revenue", "cost", "region")
    bounds = P.period_bounds(sales(spark, sf, "date", "region"), S, _H4F, "previous_year")
    return MT.kpi_table(df, schema_of(df), _H4F, bounds=bounds).select("kpi", "value", "change_pct")


@query("h6_group_ranking", f"""with {SALES_SQL}
select label, value from (select trim(customer_name) as label, {O.r2('sum(revenue - cost)')} as value from sales group by 1)
order by value desc, label limit 10""")
def _(spark, sf):
    df = sales(spark, sf, "customer_name", "revenue", "cost")
    return MT.ranking(df, schema_of(df), "customer_name", "profit")


@query("h7_time_series", f"""with {SALES_SQL}
select {grain_key_sql('date', RETAIL)} as period, {O.r2('sum(revenue - cost)')} as value from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue", "cost")
    return MT.time_series(df, schema_of(df), "profit", cal=RETAIL)


@query("h7_series_by_group", f"""with {SALES_SQL}
select region, {grain_key_sql('date', APRIL, 'quarter')} as period, cast(count(*) as double) as value from sales group by 1, 2""")
def _(spark, sf):
    df = sales(spark, sf, "date", "region")
    return MT.time_series(df, schema_of(df), "orders", cal=APRIL, grain="quarter", by=["region"])


def _spec_query(name, spec, sql, slots):
    @query(name, f"with {SALES_SQL} select department as label, {sql} as value from sales group by 1")
    def _(spark, sf):
        df = sales(spark, sf, "department", *slots)
        return MT.group_totals(df, schema_of(df), "department", spec)


_spec_query("h8_sum_metric", MT.MetricSpec("a", "A", "sum", field="revenue", filter=("category", "ne", "promo")),
            O.r2("coalesce(sum(revenue) filter (category <> 'PROMO'), 0)"), ["revenue", "category"])
_spec_query("h10_count_metric", MT.MetricSpec("a", "A", "count", filter=("quantity", "lt", 5)),
            "cast(count(*) filter (quantity < 5) as double)", ["quantity"])
_spec_query("h11_distinct_metric", MT.MetricSpec("a", "A", "distinct", field="customer_id", filter=("quantity", "eq", 7)),
            "cast(count(distinct customer_id) filter (quantity = 7) as double)", ["customer_id", "quantity"])
_spec_query("h12_ratio_metric", MT.MetricSpec("a", "A", "ratio", "percent", "cost", "revenue"),
            O.half_up("sum(cost) / sum(revenue) * 100", 1), ["cost", "revenue"])


@query("h9_avg_metric", f"""with {MESSY_SQL}
select coalesce(nullif(trim(segment_text), ''), 'Unknown') as label,
  {O.r2("sum(coalesce(" + O.parse_number('amount_text') + ", 0)) filter (trim(amount_text) <> '') / count(*) filter (trim(amount_text) <> '')")} as value
from messy group by 1""")
def _(spark, sf):
    df = messy(spark, sf).select("segment_text", "amount_text")
    return MT.group_totals(df, {}, "segment_text", MT.MetricSpec("a", "A", "avg", field="amount_text"))


@query("h15_mrr", f"""with {SALES_SQL} select strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "date", "revenue").withColumnRenamed("revenue", "monthly_recurring")
    return MT.time_series(df, {"date": "date"}, MT.mrr(df, {}))


_HALF_SQL = f"""{SALES_SQL}, ordered as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from sales),
mid as (select date as m from ordered where i = floor(n / 2)),
halves as (select customer_id, bool_or(date < m) as early, bool_or(date >= m) as late from sales, mid group by 1)"""


@query("h16_observed_churn", f"""with {_HALF_SQL}
select count(*) filter (early) as customers, count(*) filter (early and not late) as lapsed,
  floor(count(*) filter (early and not late) / count(*) filter (early) * 100 * 10 + 0.5) / 10 as churn_pct from halves""")
def _(spark, sf):
    return MT.observed_churn(sales(spark, sf, "date", "customer_id"), S)


@query("h17_arpu", f"""with {SALES_SQL} select region as label, {O.r2('sum(revenue) / count(distinct customer_id)')} as value from sales group by 1""")
def _(spark, sf):
    df = sales(spark, sf, "region", "customer_id", "revenue")
    return MT.group_totals(df, schema_of(df), "region", MT.arpu(df, S))


@query("h18_expiry_risk", """with l as (select cast(l_shipdate as date) as s, cast(l_shipdate as date) + cast(l_quantity as integer) as e from lineitem),
m as (select max(s) as latest from l)
select count(*) as n, count(*) filter (e between latest - 90 and latest) as at_risk,
  floor(count(*) filter (e between latest - 90 and latest) / count(*) * 100 * 10 + 0.5) / 10 as expiry_risk_pct from l, m""")
def _(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("ship_date"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("expiry"))
    return MT.expiry_risk(lines, "ship_date", "expiry")


def _industry(spark, sf):
    billable, hours = F.col("quantity") * 0.8, F.col("quantity") + F.col("line_no")
    return sales(spark, sf, "department", "quantity", "line_no", "revenue"), billable, hours


@query("h19_utilisation", f"""with {SALES_SQL} select department, floor(sum(quantity * 0.8) / sum(quantity + line_no) * 100 * 10 + 0.5) / 10 as value
from sales group by 1""")
def _(spark, sf):
    df, billable, hours = _industry(spark, sf)
    return df.groupBy("department").agg(MT.utilisation(billable, hours).alias("value"))


@query("h20_average_rate", f"""with {SALES_SQL} select department, floor(sum(revenue) / sum(quantity * 0.8) * 100 + 0.5) / 100 as value
from sales group by 1""")
def _(spark, sf):
    df, billable, _ = _industry(spark, sf)
    return df.groupBy("department").agg(MT.average_rate(F.col("revenue"), billable).alias("value"))


@query("h21_defect_rate", """select l_linestatus as line, floor(sum(case when l_returnflag = 'R' then l_quantity else 0 end) / sum(l_quantity) * 100 * 10 + 0.5) / 10 as value
from lineitem group by 1""")
def _(spark, sf):
    defects = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return load(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("line")).agg(
        MT.defect_rate(defects, F.col("l_quantity")).alias("value"))


@query("h22_low_inventory", f"""with {SALES_SQL}
select label, value from (select trim(product_name) || ' ' || trim(brand) as label, cast(min(inventory) as double) as value from sales group by 1) where value < 20""")
def _(spark, sf):
    df = sales(spark, sf, "product_name", "brand", "inventory")
    return MT.low_inventory(df.withColumn("product", F.concat_ws(" ", "product_name", "brand")), "product", "inventory")


@query("h23_best_period", f"""with {SALES_SQL}, s as (select strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1)
select 'best' as kind, * from (select * from s order by value desc, period limit 1)
union all select 'worst', * from (select * from s order by value, period limit 1)""")
def _(spark, sf):
    series = MT.time_series(sales(spark, sf, "date", "revenue"), S)
    best, worst = (MT.best_period(series, worst=w) for w in (False, True))
    return best.select(F.lit("best").alias("kind"), "*").unionByName(worst.select(F.lit("worst").alias("kind"), "*"))


@query("h24_composition", f"""with {SALES_SQL}, g as (select product_name as label, {O.r2('sum(revenue)')} as value from sales group by 1),
r as (select *, row_number() over (order by value desc, label) as r from g), l as (select label, value from r where r <= 8 union all select '(other)', {O.r2('sum(value::decimal(38,6))')} from r where r > 8 having count(*) > 0)
select label, value, floor(value / (select sum(value::decimal(38,6))::double from g) * 100 * 100 + 0.5) / 100 as share_pct from l""")
def _(spark, sf):
    df = sales(spark, sf, "product_name", "revenue")
    return MT.composition(df, schema_of(df), "product_name", limit=8)


@query("h25_record_series", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as records from events group by 1, 2")
def _(spark, sf):
    return load(spark, sf, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("records"))


_NON_NUM = f"(trim(amount_text) <> '' and {O.plain_number('amount_text')} is null)"


@query("h26_value_inclusion", f"""with {MESSY_SQL}, f as (select amount_text is null or trim(amount_text) = '' as m, coalesce({_NON_NUM}, false) as u,
  flag_text is null or trim(flag_text) = '' as fm from messy)
select 'sum' as kind, count(*) as n, count(*) filter (m) as missing, count(*) filter (u) as non_numeric,
  count(*) filter (not m and not u) as included from f
union all select 'distinct', count(*), count(*) filter (fm), 0, count(*) filter (not fm) from f
union all select 'count', count(*), 0, 0, count(*) from f""")
def _(spark, sf):
    df = messy(spark, sf).select("amount_text", "flag_text")
    parts = [("sum", ["amount_text"]), ("distinct", ["flag_text"]), ("count", [])]
    rows = [MT.value_inclusion(df, kind, sources).select(F.lit(kind).alias("kind"), "*") for kind, sources in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- comparison ---------------------------------------------------------------------------------


def _bounds_text(bounds, case):
    return bounds.select(F.lit(case).alias("case_name"), *[F.col(c).cast("string").alias(c) for c in bounds.columns])


@query("j1_previous_period", f"""with {SALES_SQL}, {TRAILING_SQL}
select 'trailing' as case_name, 'trailing_equal_period' as basis, null as reason, 'trailing_half' as current_source, cf::varchar as current_from,
  ct::varchar as current_to, pf::varchar as previous_from, pt::varchar as previous_to from w
union all select 'window', 'trailing_equal_period', null, 'filter', '1998-03-01', '1998-03-31', '1998-01-29', '1998-02-28'
union all select 'open_end', 'trailing_equal_period', null, 'filter', '2000-01-01', max(date)::varchar,
  (date '2000-01-01' - cast(max(date) - date '2000-01-01' + 1 as integer))::varchar, '1999-12-31' from sales where date >= '2000-01-01'""")
def _(spark, sf):
    df = sales(spark, sf, "date")
    cases = {"trailing": Filters(), "window": Filters("1998-03-01", "1998-03-31"), "open_end": Filters("2000-01-01")}
    rows = [_bounds_text(P.period_bounds(df, S, f), name) for name, f in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("j2_previous_year", """select 'calendar' as case_name, 'same_period_last_year' as basis, '2000-02-01' as current_from, '2000-02-29' as current_to,
  '1999-02-01' as previous_from, '1999-02-28' as previous_to where (select count(*) from orders where o_orderdate between '1999-02-01' and '1999-02-28') > 0
union all select 'leap_end', 'same_period_last_year', '2000-02-20', '2000-02-28', '1999-02-20', '1999-02-27'
union all select 'retail', 'same_period_last_year', '2000-02-01', '2000-02-29', '1999-02-02', '1999-03-02'""")
def _(spark, sf):
    df = sales(spark, sf, "date")
    cases = [("calendar", Filters("2000-02-01", "2000-02-29"), Calendar()), ("leap_end", Filters("2000-02-20", "2000-02-28"), Calendar()),
             ("retail", Filters("2000-02-01", "2000-02-29"), RETAIL)]
    out = None
    for name, filters, cal in cases:
        row = _bounds_text(P.period_bounds(df, S, filters, "previous_year", cal), name).select(
            "case_name", "basis", "current_from", "current_to", "previous_from", "previous_to")
        out = row if out is None else out.unionByName(row)
    return out


@query("j3_unavailable_reason", """select 'no_date' as case_name, 'unavailable' as basis, 'no_date_column' as reason
union all select 'no_prior', 'unavailable', 'no_prior_data'
union all select 'bad_window', 'unavailable', 'insufficient_history'
union all select 'nothing_dated', 'unavailable', 'insufficient_history' from (select count(*) as n from orders where false) where n < 4""")
def _(spark, sf):
    df = sales(spark, sf, "date", "region")
    cases = [("no_date", {}, Filters()), ("no_prior", S, Filters("1900-01-01", "2100-01-01")),
             ("bad_window", S, Filters("2000-02-01", "2000-01-01")),
             ("nothing_dated", S, Filters(slots={"region": "nowhere"}))]
    out = None
    for name, schema, filters in cases:
        row = P.period_bounds(df, schema, filters).select(F.lit(name).alias("case_name"), "basis", "reason")
        out = row if out is None else out.unionByName(row)
    return out


@query("j4_percent_change", f"""with {SIDES_SQL}, g as (select brand, sum(case when cur then revenue end) c, sum(case when prev then revenue end) p from tagged group by 1)
select brand, {O.pct('c', 'p')} as change_pct from g""")
def _(spark, sf):
    df = sales(spark, sf, "date", "brand", "revenue")
    tagged = P.tag_periods(df, S, Filters(), P.period_bounds(sales(spark, sf, "date"), S))
    sums = tagged.groupBy("brand").agg(exact_sum(F.when(F.col("is_current"), F.col("revenue"))).alias("c"),
                                       exact_sum(F.when(F.col("is_previous"), F.col("revenue"))).alias("p"))
    return sums.select("brand", pct_change(F.col("c"), F.col("p")).alias("change_pct"))


_CHANGE_SQL = f"""{SIDES_SQL}, g as (select customer_name as label, {O.r2('sum(revenue) filter (cur)')} as current, {O.r2('sum(revenue) filter (prev)')} as previous
  from tagged where cur or prev group by 1),
changes as (select label, current, previous, {O.pct('current', 'previous')} as change_pct from g where previous > 0 and current is not null)"""


def _changes(spark, sf):
    df = sales(spark, sf, "date", "customer_name", "revenue")
    return P.change_by_group(df, S, "customer_name", F.col("revenue"), P.period_bounds(sales(spark, sf, "date"), S))


@query("j5_change_by_group", f"with {_CHANGE_SQL} select * from changes")
def _(spark, sf):
    return _changes(spark, sf)


@query("j6_declining_groups", f"with {_CHANGE_SQL} select label, change_pct from changes where change_pct <= -10")
def _(spark, sf):
    return P.declining(_changes(spark, sf)).select("label", "change_pct")


@query("j6_growing_groups", f"with {_CHANGE_SQL} select label, change_pct from changes where change_pct >= 10")
def _(spark, sf):
    return P.growing(_changes(spark, sf)).select("label", "change_pct")


@query("j7_series_change", f"""with {SALES_SQL}, s as (select region, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1, 2),
l as (select *, lag(value) over (partition by region order by period) as previous from s)
select region, period, value, previous, {O.pct('value', 'previous')} as change_pct from l""")
def _(spark, sf):
    series = MT.time_series(sales(spark, sf, "date", "region", "revenue"), S, by=["region"])
    return P.series_change(series, by=["region"])
