"""Sources, sinks and streaming jobs over files made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.numbers import round2
from tallyloom.operators import clean as CL, joins as J, report as RP
from tallyloom.operators.compare import period_bounds
from tallyloom.plans import oracle as O
from tallyloom.plans.bake_off_sql import bake_off_sql
from tallyloom.plans.forecasting import _SAVED_SQL, _saved, many_series
from tallyloom.plans.kpis import SIDES_SQL, _COUNTS, _sum_by_side
from tallyloom.plans.quality import TITLE_SQL
from tallyloom.plans.registry import query
from tallyloom.plans.scalars import _KIND_SQL, _normalised_sql
from tallyloom.plans.views import MESSY_SQL, SALES_SCHEMA as S, load, messy, sales
from tallyloom.session import shared_dir
from tallyloom.sources import append as AP, readers as RD, sinks as SK
from tallyloom.streaming import jobs as ST


def _folder(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _raw_csv(df, path):
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


_TEXTS = ["amount_text", "segment_text", "iso_text", "flag_text", "empty_text"]


@query("a1_csv_scan", f"""with {MESSY_SQL}, t as (select {', '.join(f"coalesce({c}, '') as {c}" for c in ['iso_text', 'flag_text', 'empty_text', 'amount_text'])} from messy)
select *, count(*) as n from t where trim(iso_text) <> '' or trim(flag_text) <> '' or trim(amount_text) <> '' group by all""")
def _(spark, sf):
    path = _folder(spark, "a1")
    columns = ["iso_text", "flag_text", "empty_text", "amount_text"]
    _raw_csv(messy(spark, sf).select(*[F.col(c).alias(f" {c} ") for c in columns]), path)
    return RD.read_csv(spark, path).groupBy(*columns).agg(F.count("*").alias("n"))


@query("a2_ragged_columns", """with a as (select o_orderkey as k, o_orderstatus as status, null as priority, null as total from orders where o_orderkey % 3 = 0
  union all select o_orderkey, o_orderstatus, o_orderpriority, null from orders where o_orderkey % 3 = 1
  union all select o_orderkey, null, o_orderpriority, cast(cast(o_totalprice as bigint) as varchar) from orders where o_orderkey % 3 = 2)
select k, status, priority, total from a""".replace("cast(cast(o_totalprice as bigint) as varchar)", "cast(cast(floor(o_totalprice) as bigint) as varchar)"))
def _(spark, sf):
    orders = load(spark, sf, "orders").selectExpr(
        "o_orderkey as k", "o_orderstatus as status", "o_orderpriority as priority", "cast(cast(floor(o_totalprice) as bigint) as string) as total")
    frames = []
    for i, columns in enumerate((["k", "status"], ["k", "status", "priority"], ["k", "priority", "total"])):
        path = _folder(spark, f"a2-{i}")
        _raw_csv(orders.where(F.col("k") % 3 == i).select(*columns), path)
        frames.append(RD.read_csv(spark, path))
    return RD.union_ragged(frames).withColumn("k", F.col("k").cast("bigint"))


@query("a5_row_cap", "select least(count(*), 1000) as capped, count(*) as uncapped from lineitem")
def _(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey")
    return RD.row_cap(lines, 1000).agg(F.count("*").alias("capped")).select(
        "capped", RD.row_cap(lines).agg(F.count("*")).scalar().alias("uncapped"))


_A6 = ["orders", "customer", "nation", "region", "supplier", "part", "lineitem"]


@query("a6_multi_table_source", " union all ".join(
    f"select '{t}' as table_name, (select count(*) from {t}) as n_rows, (select count(*) from (describe {t})) as n_columns" for t in _A6))
def _(spark, sf):
    tables = RD.read_tables(spark, sf, _A6)
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(table.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


_A6_NAMES = {"customer": {"c_custkey": "customer_id", "c_nationkey": "nation_id"}, "orders": {"o_orderkey": "order_id", "o_custkey": "customer"},
             "nation": {"n_nationkey": "nation id", "n_name": "name"}}


@query("a6_source_relations", f"""select 'customer' as left_table, 'nation_id' as left_column, 'nation' as right_table, 'nation id' as right_column, 'many_to_one' as kind,
  {O.r2('count(*) filter (c_nationkey in (select n_nationkey from nation)) / count(*)')} as overlap, {O.r2('0.4 + 0.6 * count(*) filter (c_nationkey in (select n_nationkey from nation)) / count(*)')} as confidence from customer
union all select 'orders', 'customer', 'customer', 'customer_id', 'many_to_one', {O.r2('count(*) filter (o_custkey in (select c_custkey from customer)) / count(*)')},
  {O.r2('0.32 + 0.6 * count(*) filter (o_custkey in (select c_custkey from customer)) / count(*)')} from orders""")
def _(spark, sf):
    tables = {t: load(spark, sf, t).select(*[F.col(c).alias(n) for c, n in names.items()]) for t, names in _A6_NAMES.items()}
    return J.suggest_relations(tables)


@query("a7_append_problems", """select 'missing_column' as problem, 'flag_text' as "column", 'present' as existing, 'absent' as incoming where (select count(*) from orders) > 0
union all select 'extra_column', 'iso_text', 'absent', 'present' union all select 'type_mismatch', 'amount_text', 'number', 'category'""")
def _(spark, sf):
    table = messy(spark, sf)
    incoming = table.select(F.col("segment_text").alias("amount_text"), "segment_text", "iso_text")
    return AP.append_problems(table.select("amount_text", "segment_text", "flag_text"), incoming)


_A7 = ["order_key", "amount_text", "segment_text"]


def _two_files(spark, sf):
    table = messy(spark, sf).select(F.col("order_key").cast("string").alias("order_key"), "amount_text", "segment_text")
    return table.where("order_key % 3 = 0"), table.where("order_key % 3 <> 0").select("segment_text", "order_key", "amount_text")


@query("a7_append", f"with {MESSY_SQL} select cast(order_key as varchar) as order_key, amount_text, segment_text from messy")
def _(spark, sf):
    return AP.append(*_two_files(spark, sf))


@query("a8_append_recleaned", f"with {MESSY_SQL} select distinct cast(order_key as varchar) as order_key, amount_text, {TITLE_SQL.format(v='trim(segment_text)')} as segment_text from messy")
def _(spark, sf):
    steps = [CL.Step("whitespace", "segment_text"), CL.Step("inconsistent_case", "segment_text"), CL.Step("duplicate_rows")]
    return AP.append(*_two_files(spark, sf), steps)


def _rewritten_sql(column):
    return _normalised_sql(column, f"(rw['{column}'])", "UTC")


@query("a9_ingest", f"""with {_KIND_SQL}, m as (select map(list(col order by col), list(rewrite order by col)) as rw from fmt where rewrite is not null)
select {_rewritten_sql('euro_text')} as euro_text, {_rewritten_sql('dmy_text')} as dmy_text, trim(segment_text) as segment_text,
  case when coalesce(trim(flag_text), '') = '' then 'Unknown' else flag_text end as flag_text, 4 as profiled, 1 as versions from messy, m""")
def _(spark, sf):
    folder = _folder(spark, "a9")
    table = messy(spark, sf).select("euro_text", "dmy_text", "segment_text", "flag_text")
    taken = AP.ingest(table, [CL.Step("whitespace", "segment_text"), CL.Step("missing_values", "flag_text", "Unknown")])
    for _ in range(2):  # a run repeated is there once
        taken.write(folder, "first")
    stored = AP.read_ingested(spark, folder)
    counts = [(stored["profile"], "profiled"), (AP.published(spark, folder), "versions")]
    return stored["rows"].select("*", *[frame.agg(F.count("*").cast("int")).scalar().alias(name) for frame, name in counts])


@query("a10_csv_export", f"""with {MESSY_SQL} select cast(order_key as varchar) as order_key, case when regexp_matches(formula_text, '^[=+\\-@]') then '''' || formula_text else formula_text end as formula_text,
  coalesce(case when regexp_matches(amount_text, '^[=+\\-@]') then '''' || amount_text else amount_text end, '') as amount_text from messy""")
def _(spark, sf):
    path = _folder(spark, "a10")
    SK.write_csv(messy(spark, sf).select("order_key", "formula_text", "amount_text"), path)
    return RD.read_csv(spark, path).select("order_key", "formula_text", "amount_text")


@query("a11_paged_read", """select o_orderkey, o_orderstatus, total, 250 + 50 < total as has_more from (select *, count(*) over () as total, row_number() over (order by o_orderkey) as r
  from orders where o_orderstatus = 'F') where r > 250 and r <= 300""")
def _(spark, sf):
    rows = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    return RD.page(rows, ["o_orderkey"], 5, 50)


@query("a12_preview", "select count(*) as shown, max(total) as total from (select (select count(*) from orders) as total from orders limit 50)")
def _(spark, sf):
    return RD.preview(load(spark, sf, "orders")).agg(F.count("*").alias("shown"), F.max("total").alias("total"))


_SHOWN = ["revenue", "profit", "orders", "customers", "margin"]


@query("a13_report", f"""with recursive {bake_off_sql(f"{SIDES_SQL}, s as (select 'revenue' as k, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 2)", 3)},
f as ({_sum_by_side('revenue', 'revenue')} union all {_sum_by_side('profit', 'revenue - cost')} union all {_COUNTS} union all select 'margin', sum(revenue - cost) / sum(revenue) * 100, null, null from tagged),
chg as (select {O.group_label('product_name')} as label, {O.r2('sum(revenue) filter (cur)')} as now_, {O.r2('sum(revenue) filter (prev)')} as then_ from tagged where cur or prev group by 1),
changes as (select label, {O.pct('now_', 'then_')} as change_pct from chg where then_ > 0 and now_ is not null),
fell as (select * from changes where change_pct <= -10 order by change_pct, label limit 3), rose as (select * from changes where change_pct >= 10 order by change_pct desc, label limit 1)
select 'kpis' as block, measure as key, {O.r2('v')} as value, {O.pct('c', 'p')} as change_pct, null as text from f where measure in ({', '.join(f"'{k}'" for k in _SHOWN)})
union all select 'sections.products', {O.group_label('product_name')}, {O.r2('sum(revenue)')}, null, null from sales group by 2
union all select 'sections.regions', {O.group_label('region')}, {O.r2('sum(revenue)')}, null, null from sales group by 2
union all select 'forecast', period, value, null, method || ', ' || basis from dated
union all select 'recommendations', 'Shrinking groups', null, null, 'Below the period before: ' || string_agg(label || ' (' || change_pct || '%)', ', ' order by change_pct, label) from fell having count(*) > 0
union all select 'recommendations', 'Fastest grower', null, null, label || ': up ' || change_pct || '% on the period before' from rose""")
def _(spark, sf):
    df = sales(spark, sf, "date", "order_id", "customer_id", "revenue", "cost", "product_name", "region")
    blocks = RP.report(df, {k: v for k, v in S.items() if v in df.columns}, period_bounds(sales(spark, sf, "date"), S))
    folder = _folder(spark, "a13")
    # what a reader finds in each block; the summary is left out by the template
    shown = {"kpis": ("kpi", "value", "change_pct", None), "sections.products": ("label", "value", None, None), "sections.regions": ("label", "value", None, None),
             "forecast": ("period", "value", None, F.concat_ws(", ", "method", "basis")), "recommendations": ("title", None, None, F.col("observation"))}
    out = None
    for path in SK.write_report(blocks, folder, {"summary": False}):
        block = path.rsplit("/", 1)[1]
        key, value, change, text = shown[block]
        number = lambda c: (F.col(c) if c else F.lit(None)).cast("double")
        line = spark.read.parquet(path).select(F.lit(block).alias("block"), F.col(key).alias("key"), number(value).alias("value"), number(change).alias("change_pct"),
                                               (text if text is not None else F.lit(None)).cast("string").alias("text"))
        out = line if out is None else out.unionByName(line)
    return out


# --- streams ---------------------------------------------------------------------------------------------

_R1 = ["order_key", "amount_text", "segment_text"]


@query("r1_incremental_ingest", f"""with {MESSY_SQL} select cast(order_key as varchar) as order_key, case when coalesce(trim(amount_text), '') = '' then '0' else trim(amount_text) end as amount_text,
  {TITLE_SQL.format(v='trim(segment_text)')} as segment_text from messy""")
def _(spark, sf):
    folder = _folder(spark, "r1")
    table = messy(spark, sf).select(*_R1)
    steps = [CL.Step("whitespace", "amount_text"), CL.Step("whitespace", "segment_text"), CL.Step("inconsistent_case", "segment_text"),
             CL.Step("missing_values", "amount_text", 0)]
    for part in (0, 1):  # a second run picks up only what arrived since the first
        table.where(F.col("order_key") % 2 == part).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).option("escape", '"').csv(f"{folder}/in")
        ST.ingest_files(spark, f"{folder}/in", "order_key string, amount_text string, segment_text string", steps,
                        f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ST.read_batches(spark, f"{folder}/out")


def _event_stream(spark, sf):
    table = load(spark, sf, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


_DAILY = f"daily as (select cast(ts as date) as day, event_type, {O.r2('sum(value)')} as value, count(*) as n from events group by 1, 2)"


@query("r4_period_totals", f"with {_DAILY} select cast(day as varchar) as day, event_type, value, n, day + interval 2 day <= (select max(ts) from events) as final from daily")
def _(spark, sf):
    folder = _folder(spark, "r4")
    totals = ST.daily_totals(_event_stream(spark, sf), "ts", ["event_type"], "value")
    ST.write_daily_totals(totals, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    days = ST.read_daily_totals(spark, f"{folder}/out", ["event_type"])
    return days.select(F.col("day").cast("string").alias("day"), "event_type", round2(F.col("value")).alias("value"), "n", "final")


_R2_RULES = [(1, "click", "GT", 900.0), (2, "error", "GT", 900.0), (3, "purchase", "LT", 700.0), (4, "view", "GTE", 1.0), (5, "view", "GT", 1e12)]


@query("r2_threshold_rules", f"""with {_DAILY}, r(rule_id, metric, comparator, threshold) as (values {', '.join(str(r) for r in _R2_RULES)}),
h as (select rule_id, metric, day, value, row_number() over (partition by rule_id order by day) as k from daily join r on metric = event_type and case comparator when 'LT' then value < threshold when 'GTE' then value >= threshold else value > threshold end
  where rule_id <> 2)
select rule_id, metric, cast(day as varchar) as day, value from h where k = 1""")
def _(spark, sf):
    folder = _folder(spark, "r2")
    totals = ST.daily_totals(_event_stream(spark, sf), "ts", ["event_type"], "value")
    metrics = totals.select(F.col("event_type").alias("metric"), "day", "value", "latest")
    rules = spark.createDataFrame(_R2_RULES, "rule_id int, metric string, comparator string, threshold double")
    opened = spark.createDataFrame([(2,)], "rule_id int")  # rule 2 already has an open alert
    job = ST.threshold_alerts(metrics, rules, opened, folder, f"{folder}/checkpoint")
    job.awaitTermination()
    ST.close_alerts(spark, rules, folder, job)  # the table of events is all there is
    return ST.read_batches(spark, f"{folder}/alerts").select("rule_id", "metric", F.col("day").cast("string").alias("day"), round2(F.col("value")).alias("value"))


@query("r3_score_upsert", f"with {_SAVED_SQL} select series, period, predicted, actual, abs_error, pct_error, within_band from scored")
def _(spark, sf):
    folder = _folder(spark, "r3")
    history = many_series(spark, sf)
    points = _saved(spark, sf, history)
    for months in (F.col("period") <= "2000-06", F.col("period") > "2000-06"):
        history.where(months).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(history.schema).parquet(f"{folder}/in")
        ST.score_arrivals(stream, points, ["series"], folder, f"{folder}/checkpoint").awaitTermination()
    return ST.latest_scores(spark, folder, ["series"]).select("series", "period", "predicted", "actual", "abs_error", "pct_error", "within_band")
