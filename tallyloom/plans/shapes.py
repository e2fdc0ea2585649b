"""What the columns of a table are, over text sheets made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numbers import round_half_up
from tallyloom.operators import derive as DV, metrics as MT, profile as PR, semantics as SE, shape as SH
from tallyloom.plans import oracle as O
from tallyloom.plans.quality import judged_sql
from tallyloom.plans.registry import query
from tallyloom.plans.views import ORDER_SHEET, SALES_SQL, SHEETS, sales, sheet, sheet_cells_sql

COLUMNS = list(ORDER_SHEET)
_PLAUSIBLE = r"""(select col, count(*) filter (year(try_cast(case when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then t end as date)) between 1900 and 2100) as n_plausible,
  avg(length(t)) as dummy from judged group by 1)"""
_ID = r"((^|[_\s])(id|no|num|number|code|key|ref|uuid|guid|sku|barcode)$|^(id|uuid|guid)$)"

SHAPE_SQL = judged_sql(sheet_cells_sql("orders")) + f""", ev as (select t.*, filled / n_rows as coverage, case when filled > 0 then uniq / filled else 0 end as distinctness,
    coalesce(n_plausible / nullif(filled, 0) >= 0.8, false) as plausible_dates,
    coalesce(all_digits, false) and shortest = longest and shortest >= 4 and filled >= 8 as fixed_width,
    coalesce(whole and lo >= 1900 and hi <= 2100 and hi - lo <= 120, false) as years,
    case when n_number >= 2 and mean <> 0 then abs(sd / mean) else 0 end as variation, dl.avg_length
  from typed t left join {_PLAUSIBLE} p on t.col = p.col left join (select col, avg(length(t)) as avg_length from (select distinct col, t from judged) group by 1) dl on t.col = dl.col),
roles as (select *, type in ('number','currency') and lo is not null as num, type = 'number' and whole and distinctness > 0.9 and filled >= 8 as keyish,
    case when hi > lo then uniq / (hi - lo + 1) else 0 end as density, regexp_matches(lower(col), '{_ID}') as idn from ev),
v as (select *, case when type = 'empty' or filled = 0 then 'ignored' when coverage < 0.05 then 'ignored' when uniq <= 1 then 'ignored'
    when not idn and type = 'date' and plausible_dates then 'time' when type = 'boolean' then 'dimension'
    when keyish and density >= 0.9 then 'identifier' when keyish and idn then 'identifier' when num and years then 'dimension'
    when num and fixed_width and distinctness > 0.9 then 'identifier' when num and fixed_width then 'dimension' when num and lo = hi then 'ignored'
    when num and whole and uniq <= 12 and distinctness < 0.05 and filled >= 40 then 'dimension' when num then 'measure'
    when type = 'category' or (uniq <= greatest(50, n_rows * 0.2) and distinctness <= 0.5) then 'dimension'
    when distinctness > 0.9 and avg_length <= 40 then 'identifier' else 'text' end as role,
  least(1, greatest(0, case when type = 'empty' or filled = 0 then 1 when coverage < 0.05 then 0.9 when uniq <= 1 then 0.95
    when not idn and type = 'date' and plausible_dates then 0.7 + coverage * 0.3 when type = 'boolean' then 0.9
    when keyish and density >= 0.9 then 0.6 + density * 0.35 when keyish and idn then 0.6 when num and years then 0.85
    when num and fixed_width then 0.8 when num and lo = hi then 0.9
    when num and whole and uniq <= 12 and distinctness < 0.05 and filled >= 40 then 0.7 when num then 0.55 + least(variation, 1) * 0.25 + coverage * 0.2
    when type = 'category' or (uniq <= greatest(50, n_rows * 0.2) and distinctness <= 0.5) then 0.5 + (case when uniq <= 25 then 0.35 else 0.15 end) + coverage * 0.15
    when distinctness > 0.9 and avg_length <= 40 then 0.5 + distinctness * 0.3 else 0.8 end)) as conf from roles),
tr as (select *, regexp_matches(lower(col), '(pct|percent|rate|ratio|share|%|score|index|average|avg|mean)') as rateh,
    regexp_matches(lower(col), '(pct|percent|%|rate|share)') as pcth,
    lo >= 0 and hi <= 100 and hi <> floor(hi) as bounded from v),
traits as (select *, case when role = 'measure' then case when rateh or (bounded and type <> 'currency' and distinctness > 0.2) then 'avg' else 'sum' end end as aggregate,
    case when role = 'measure' then lo >= 0 end as additive,
    case when role = 'measure' then case when type = 'currency' then 'money' when rateh and pcth then 'percent' else 'number' end end as format from tr),
ms as (select *, {O.half_up('''least(variation, 1.5) / 1.5 * 0.45 + coverage * 0.3 + (case when additive then 0.15 else 0 end) + (case when format = 'money' then 0.1 else 0 end)
    + (case when regexp_matches(lower(col), '(revenue|sales|amount|price|cost|profit|margin|spend|budget|value|fee|charge|payment|total|salary|income)') then 0.002 else 0 end)
    - (case when aggregate = 'avg' then 0.05 else 0 end)''', 3)} as s from traits where role = 'measure'),
lead as (select col from ms order by s desc, col limit 1),
facts as (select *, row_number() over () as rid from orders_sheet),
sep_in as (""" + " union all ".join(
    f"select '{c}' as col, trim(\"{c}\") as label, abs(coalesce(case (select col from lead) " + " ".join(
        f"when '{m}' then {O.plain_number(chr(34) + m + chr(34))}" for m in ("total_sales", "total_cost", "discount_rate", "balance")) + " end, 0)) as x from facts"
    for c in COLUMNS) + f"""),
sep as (select g.col, case when max(k) < 2 then 0.0 else {O.half_up('coalesce(sum(abs(x / nullif(w, 0) - 1 / k)) / 2, 0)', 3)} end as separation
  from (select col, label, sum(x) as x from sep_in where label <> '' group by 1, 2) g
  join (select col, sum(x) w, count(distinct label) k from sep_in where label <> '' group by 1) t on g.col = t.col group by 1),
scored as (select t.*, {O.half_up('''case role when 'time' then coverage * 0.6 + least(distinctness * 2, 1) * 0.4 + (case when regexp_matches(lower(t.col), '(date|time|day|month|year|period|timestamp|created|updated|when)') then 0.001 else 0 end)
    when 'measure' then least(variation, 1.5) / 1.5 * 0.45 + coverage * 0.3 + (case when additive then 0.15 else 0 end) + (case when format = 'money' then 0.1 else 0 end)
      + (case when regexp_matches(lower(t.col), '(revenue|sales|amount|price|cost|profit|margin|spend|budget|value|fee|charge|payment|total|salary|income)') then 0.002 else 0 end)
      - (case when aggregate = 'avg' then 0.05 else 0 end)
    when 'dimension' then (case when uniq <= 1 then 0 when uniq = 2 then 0.55 when uniq <= 8 then 1 when uniq <= 25 then 0.9 when uniq <= 50 then 0.7 when uniq <= 200 then 0.35 else 0.1 end) * 0.45
      + coalesce(separation, 0) * 0.35 + coverage * 0.2 - (case when idn then 0.05 else 0 end)
    when 'identifier' then distinctness * 0.5 + coverage * 0.4 + (case when idn then 0.002 else 0 end) else 0 end''', 3)} as score, separation
  from traits t left join sep s on t.col = s.col),
ranked as (select *, row_number() over (partition by role order by score desc, case when role = 'dimension' then -uniq else 0 end, col) as rank from scored)"""


def _evidence(spark, sf):
    return SH.column_evidence(sheet(spark, sf, "orders"), COLUMNS)


def _ranked(spark, sf):
    return SH.ranked_columns(sheet(spark, sf, "orders"), COLUMNS)


@query("e5_column_roles", f"""with {SHAPE_SQL} select col as "column", type, role, {O.half_up('conf', 3)} as confidence,
  {O.half_up('coverage', 3)} as coverage, {O.half_up('distinctness', 3)} as distinctness from v""")
def _(spark, sf):
    return SH.classify(_evidence(spark, sf)).select(
        "column", "type", "role", "confidence", round_half_up(F.col("coverage"), 3).alias("coverage"),
        round_half_up(F.col("distinctness"), 3).alias("distinctness"))


def _evidence_query(name, column, sql):
    @query(name, f"""with {SHAPE_SQL} select col as "column", {sql} as {column} from ev""")
    def _(spark, sf):
        value = round_half_up(F.col(column), 4) if column == "variation" else F.col(column)
        return _evidence(spark, sf).select("column", value.alias(column))


_evidence_query("e6_plausible_dates", "plausible_dates", "plausible_dates")
_evidence_query("e7_fixed_width_code", "fixed_width", "fixed_width")
_evidence_query("e8_year_like", "years", "years")
_evidence_query("e9_variation", "variation", O.half_up("variation", 4))


@query("e10_measure_traits", f"""with {SHAPE_SQL} select col as "column", aggregate, additive, format from traits where role = 'measure'""")
def _(spark, sf):
    return SH.measure_traits(SH.classify(_evidence(spark, sf))).where("role = 'measure'").select(
        "column", "aggregate", "additive", "format")


_E11 = ["region", "department", "category", "brand"]


@query("e11_separation", f"""with {SALES_SQL}, g as (""" + " union all ".join(
    f"select '{d}' as col, {d} as label, sum(abs(revenue)) as v from sales group by 2" for d in _E11) + f"""),
w as (select col, sum(v) as w, count(*) as k from g group by 1)
select g.col as "column", {O.half_up('sum(abs(v / w - 1 / k)) / 2', 3)} as separation from g join w on g.col = w.col group by 1""")
def _(spark, sf):
    return SH.separation(sales(spark, sf, *_E11, "revenue"), _E11, F.col("revenue"))


@query("e12_role_ranking", f"""with {SHAPE_SQL} select role, rank, col as "column", score from ranked where role <> 'ignored'""")
def _(spark, sf):
    return _ranked(spark, sf).where("role <> 'ignored'").select("role", "rank", "column", "score")


@query("e13_shape_kind", f"""with {SHAPE_SQL}, n as (select count(*) filter (role <> 'ignored') u, count(*) filter (role = 'measure') m,
  count(*) filter (role = 'time') t, count(*) filter (role = 'dimension') d from v)
select case when u = 0 then 'unusable' when u = 1 then 'single_column' when m > 0 and t > 0 then 'measure_over_time' when m > 0 then 'measure'
  when t > 0 then 'events_over_time' when d > 0 then 'categorical' else 'unusable' end as kind, u as usable_columns from n""")
def _(spark, sf):
    return SH.shape_kind(SH.classify(_evidence(spark, sf)))


@query("e15_financial_pairs", f"""with {SHAPE_SQL}, totals as (""" + " union all ".join(
    f"select '{c}' as col, sum(abs({O.plain_number(chr(34) + c + chr(34))})) as t from orders_sheet" for c in COLUMNS) + f"""),
m as (select ranked.col, rank, t from ranked join totals on ranked.col = totals.col where role = 'measure' and aggregate = 'sum' and additive and format <> 'percent'),
l as (select col as lead, t as lt from m where rank = 1)
select lead, col as "column", case when regexp_matches(lower(col), '(^|[_\\s])(profit|margin|earnings)([_\\s]|$)') then 'profit' else 'cost' end as named,
  {O.half_up('greatest(t, lt) / least(t, lt)', 4)} as scale_ratio, greatest(t, lt) / least(t, lt) <= 50 as accepted
from m, l where rank > 1 and (regexp_matches(lower(col), '(^|[_\\s])(cost|cogs|expense|expenses|spend|outlay)([_\\s]|$)')
  or regexp_matches(lower(col), '(^|[_\\s])(profit|margin|earnings)([_\\s]|$)'))""")
def _(spark, sf):
    table = sheet(spark, sf, "orders")
    return SH.financial_pairs(table, SH.ranked_columns(table, COLUMNS))


_COST, _PROFIT = "(^|[_\\s])(cost|cogs|expense|expenses|spend|outlay)([_\\s]|$)", "(^|[_\\s])(profit|margin|earnings)([_\\s]|$)"
_PLAIN = {c: O.plain_number(chr(34) + c + chr(34)) for c in COLUMNS}
_BOUND_SQL = f"""{SHAPE_SQL}, totals as (""" + " union all ".join(f"select '{c}' as col, sum(abs({_PLAIN[c]})) as t from orders_sheet" for c in COLUMNS) + f"""),
m as (select ranked.col, rank, t, case when regexp_matches(lower(ranked.col), '{_PROFIT}') then 'profit' when regexp_matches(lower(ranked.col), '{_COST}') then 'cost' end as named, format
  from ranked join totals on ranked.col = totals.col where role = 'measure' and aggregate = 'sum' and additive and format <> 'percent'),
fin as (select named as slot, col from (select * from m where rank > 1 and named is not null qualify row_number() over (partition by named order by rank) = 1), (select t as lt from m where rank = 1)
  where greatest(t, lt) / least(t, lt) <= 50 order by slot desc limit 1),
dims as (select *, row_number() over (order by uniq > 50, rank) as nth from ranked where role = 'dimension'),
ents as (select col, row_number() over (order by uniq desc, rank) as nth from dims where nth > 1 or (select count(*) from dims) = 1),
bound as (select 'date' as slot, col from ranked where role = 'time' and rank = 1 union all select 'revenue', col from ranked where role = 'measure' and rank = 1 union all select * from fin
  union all select 'quantity', col from (select col from m where rank > 1 and named is null and format = 'number' order by rank limit 1)
  union all select case nth when 1 then 'category' when 2 then 'region' else 'department' end, col from dims where nth <= 3
  union all select case nth when 1 then 'product_name' else 'customer_name' end, col from ents where nth <= 2
  union all select case rank when 1 then 'order_id' else 'customer_id' end, col from ranked where role = 'identifier' and rank <= 2)"""


@query("e14_slot_binding", f"""with {_BOUND_SQL} select slot, col as "column" from bound""")
def _(spark, sf):
    table = sheet(spark, sf, "orders")
    return DV.slot_binding(table, SH.ranked_columns(table, COLUMNS))


_FIGURE = " ".join(f"when '{c}' then (select case x.aggregate when 'avg' then {O.r2(f'avg({v})')} else {O.r2(f'sum({v})')} end from orders_sheet)" for c, v in _PLAIN.items())
_KEYS = " ".join(f"when '{c}' then (select count(distinct trim(lower({chr(34)}{c}{chr(34)}))) from orders_sheet)" for c in COLUMNS)
_ONE = " ".join(f"when '{c}' then (select sum({v}) from orders_sheet)" for c, v in _PLAIN.items())
_LABEL = "list_reduce(list_transform(string_split(col, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), lambda x, y: x || ' ' || y)"


@query("e16_derived_figures", f"""with {_BOUND_SQL},
shown as (select 0 as part, rank, col, case when aggregate = 'avg' then 'avg' else 'sum' end as kind, format, case col {_FIGURE} end as value from ranked x
    where role = 'measure' and rank <= 3 and col not in (select col from bound where slot = 'cost')
  union all select 1, 1, col, 'distinct', 'number', case col {_KEYS} end from ranked where role = 'identifier' and rank = 1
  union all select case when exists (select 1 from ranked where role = 'measure') then 2 else -1 end, 1, 'records', 'count', 'number', (select count(*) from orders_sheet)
  union all select 3, row_number() over (), c, 'derived', f, case c when 'profit' then {O.r2('p')} else {O.r2('p / r * 100')} end from (
    select unnest(['profit', 'margin']) as c, unnest([(select format from ranked where role = 'measure' and rank = 1), 'percent']) as f, r, case slot when 'cost' then r - v else v end as p
    from (select slot, case b.col {_ONE} end as v, (select case col {_ONE} end from bound where slot = 'revenue') as r from bound b where slot in ('cost', 'profit'))))
select (row_number() over (order by part, rank) - 1)::int as position, col as key, {_LABEL} as label, kind, format, value::double as value from shown""")
def _(spark, sf):
    table = sheet(spark, sf, "orders")
    return DV.derived_figures(table, SH.ranked_columns(table, COLUMNS))


@query("e17_dimension_list", f"""with {SHAPE_SQL} select rank, col as key, col as "column",
  list_reduce(list_transform(string_split(col, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), lambda x, y: x || ' ' || y) as label,
  uniq as cardinality from ranked where role = 'dimension'""")
def _(spark, sf):
    return SH.dimension_list(_ranked(spark, sf))


@query("e18_distinct_values", f"with {SALES_SQL} select distinct trim(product_name) as value from sales")
def _(spark, sf):
    return MT.distinct_values(sales(spark, sf, "product_name"), {}, "product_name")


# --- meanings, over three tables at once -----------------------------------------------------------


def _table_columns(spark, sf):
    """(table_name, position, column, type) of every sheet."""
    out = None
    for name, columns in SHEETS.items():
        typed = PR.column_types(sheet(spark, sf, name), list(columns)).select(F.lit(name).alias("table_name"), "column", "type")
        place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int")
        typed = typed.select("table_name", place.alias("position"), "column", "type")
        out = typed if out is None else out.unionByName(typed)
    return out


def _rules_values(industry=None):
    rules = SE.INDUSTRY_RULES.get(industry, []) + SE.BASE_RULES
    rows = [f"({i * 100 + p}, '{m}', '{x}')" for i, (m, ps) in enumerate(rules) for p, x in enumerate(ps)]
    return "(values " + ", ".join(rows) + ")"


_POSITIONS = "(values " + ", ".join(
    f"('{n}/{c}', '{n}', {i}, '{c}')" for n, cs in SHEETS.items() for i, c in enumerate(cs, 1)) + ")"


def _detect_sql(industry=None):
    return f"""select table_name, position, name, semantic, pattern, row_number() over (partition by table_name, semantic order by position) = 1 and semantic is not null as mapped from (
  select table_name, position, name, case when not (m.semantic = 'date' and type <> 'date') then m.semantic end as semantic,
    case when not (m.semantic = 'date' and type <> 'date') then m.pattern end as pattern
  from (select c.table_name, c.position, c.name, type, min_by(struct_pack(semantic, pattern), rank) as m
    from cols c left join {_rules_values(industry)} r(rank, semantic, pattern) on regexp_matches(lower(c.name), pattern) group by all))"""


_COLS_SQL = judged_sql(sheet_cells_sql("orders", "shipments", "events")) + f""",
cols as (select p.*, type from {_POSITIONS} p(col, table_name, position, name) join typed t on t.col = p.col)"""


@query("e1_semantic_detection", f"""with {_COLS_SQL}, d as ({_detect_sql('pharmacy')})
select table_name, name as "column", coalesce(semantic, 'none') as semantic, mapped, case when mapped then pattern end as matched_by from d""")
def _(spark, sf):
    return SE.detect_semantics(_table_columns(spark, sf), "pharmacy")


_SCORES = " union all ".join(
    f"select '{n}' as industry, {i} as ord, table_name, count(*) as score from ({_detect_sql(n)}) where mapped and semantic in ("
    + ", ".join(f"'{s}'" for s in signals) + ") group by 3" for i, (n, signals) in enumerate(SE.INDUSTRY_SIGNALS.items()))
_WORD_CASE = "case " + " ".join(f"when regexp_matches(words, '{p}') then '{n}'" for n, p in SE.INDUSTRY_WORDS) + " else 'generic' end"


@query("e3_industry_suggestion", f"""with {_COLS_SQL}, scores as ({_SCORES}),
best as (select * from (select *, row_number() over (partition by table_name order by score desc, ord) as r from scores where score >= 2) where r = 1),
names as (select table_name, lower(string_agg(name, ' ')) as words from cols group by 1)
select n.table_name, coalesce(industry, 'generic') as industry, coalesce(score, 0) as signals, {_WORD_CASE} as by_words
from names n left join best b on n.table_name = b.table_name""")
def _(spark, sf):
    return SE.suggest_industry(_table_columns(spark, sf))
