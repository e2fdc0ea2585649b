"""Number, date, text and calendar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.context import Calendar
from tallyloom.functions import calendar as C, dates as D, money as M, numbers as N, strings as S
from tallyloom.operators import formats as FM
from tallyloom.plans import oracle as O
from tallyloom.plans.registry import query
from tallyloom.plans.views import CELLS_SQL, MESSY_SQL, MESSY_TEXT, SALES_SQL, load, messy, sales

# --- numbers ------------------------------------------------------------------------------


@query("b1_parse_number", f"""with {MESSY_SQL}
select order_key, {O.parse_number('amount_text')} as amount, {O.parse_number('euro_text', ',')} as euro,
  {O.parse_number('space_text')} as spaced, {O.parse_number('dmy_text')} as not_a_number from messy""")
def _(spark, sf):
    return messy(spark, sf).select(
        "order_key",
        N.parse_number(F.col("amount_text")).alias("amount"),
        N.parse_number(F.col("euro_text"), ",").alias("euro"),
        N.parse_number(F.col("space_text")).alias("spaced"),
        N.parse_number(F.col("dmy_text")).alias("not_a_number"),
    )


@query("b2_number_or_zero", f"""with {MESSY_SQL}
select segment_text as label, {O.r2("sum(coalesce(" + O.parse_number('amount_text') + ", 0))")} as total,
  count(*) as n from messy group by 1""")
def _(spark, sf):
    return messy(spark, sf).groupBy(F.col("segment_text").alias("label")).agg(
        N.round2(F.sum(N.number_or_zero(F.col("amount_text")))).alias("total"), F.count("*").alias("n"))


_LENIENT_TEXT = """case order_key % 4 when 0 then 'about ' || amount_text when 1
  then coalesce(amount_text, '') || 'e1' when 2 then 'USD -' || space_text else amount_text end"""
_KEPT = r"regexp_replace(t, '[^0-9eE+\-.()]', '', 'g')"
_FOUND = O.to_double(rf"regexp_extract({_KEPT}, '([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)', 1)")


@query("b3_lenient_number", f"""with {MESSY_SQL}, texts as (select order_key, trim({_LENIENT_TEXT}) as t from messy)
select order_key, coalesce({O.to_double('t')}, case when regexp_matches(t, '\\(.*[0-9].*\\)')
  then -abs({_FOUND}) else {_FOUND} end) as number from texts""")
def _(spark, sf):
    texts = messy(spark, sf).selectExpr("order_key", f"{_LENIENT_TEXT} as t")
    return texts.select("order_key", N.lenient_number(F.col("t")).alias("number"))


_ASSOC = O.to_double(r"regexp_replace(amount_text, '[$€£₹,()%\s]', '', 'g')")


@query("b4_association_number", f"""with {MESSY_SQL}
select order_key, case when regexp_matches(amount_text, '^\\s*[$€£₹]?\\s*\\(.*\\)\\s*%?\\s*$')
  then -({_ASSOC}) else {_ASSOC} end as number from messy""")
def _(spark, sf):
    return messy(spark, sf).select("order_key", N.association_number(F.col("amount_text")).alias("number"))


# Evidence one value gives, in SQL.
_B = "trim(regexp_replace(v, '[$€£₹¥₽₩﷼()]', '', 'g'))"
_NUM_EV = f"""case when not regexp_matches({_B}, '[0-9]') then null
  when {_B} like '%,%' and {_B} like '%.%'
    then case when strpos(reverse({_B}), ',') < strpos(reverse({_B}), '.') then 'comma' else 'dot' end
  when {_B} like '%,%,%' then 'dot'
  when {_B} like '%.%.%' then 'comma'
  when regexp_matches({_B}, ',[0-9]+$') and not regexp_matches({_B}, ',[0-9]{{3}}$') then 'comma'
  when regexp_matches({_B}, '\\.[0-9]+$') and not regexp_matches({_B}, '\\.[0-9]{{3}}$') then 'dot'
  when regexp_matches({_B}, '^[0-9]{{1,3}}({O.SPACES}[0-9]{{3}})+$') then 'space' end"""
_ISO = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})([T ].*)?$"
_PARTS = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})([T ].*)?$"
_CLOCK = r"[0-9][T ][0-9]{1,2}:[0-9]{2}"
_P1, _P2 = (f"try_cast(regexp_extract(trim(v), '{_PARTS}', {i}) as integer)" for i in (1, 2))
_DATE_EV = f"""case when regexp_matches(trim(v), '{_ISO}') then 'iso'
  when {_P1} > 12 and {_P2} <= 12 then 'dmy' when {_P2} > 12 and {_P1} <= 12 then 'mdy'
  when {_P1} is not null then 'undecided' end"""
EVIDENCE_SQL = f"""{CELLS_SQL}, seen as (select col, v, {_NUM_EV} as ne, {_DATE_EV} as de,
    regexp_matches(trim(v), '{_ISO}') or regexp_matches(trim(v), '{_PARTS}') or regexp_matches(trim(v), '{_CLOCK}') as dateish,
    {O.parse_number('v')} is not null or {O.parse_number('v', ',')} is not null as numeric_,
    regexp_matches(trim(v), '{_CLOCK}') as instant
  from cells where v is not null and trim(v) <> ''),
ev as (select col, count(*) n, count(*) filter (dateish) n_dateish, count(*) filter (numeric_) n_numeric,
    count(*) filter (instant) n_instants,
    count(*) filter (ne='comma') n_comma, count(*) filter (ne='dot') n_dot, count(*) filter (ne='space') n_space,
    count(*) filter (de='iso') n_iso, count(*) filter (de='dmy') n_dmy, count(*) filter (de='mdy') n_mdy,
    count(*) filter (de='undecided') n_undecided from seen group by 1),
nf as (select *, n_comma + n_dot + n_space as tot from ev),
nf2 as (select *, case when tot = 0 then '.' when n_space >= n_comma and n_space >= n_dot then '.'
      when n_comma > n_dot then ',' else '.' end as "decimal",
    case when tot = 0 then ',' when n_space >= n_comma and n_space >= n_dot then ' '
      when n_comma > n_dot then '.' else ',' end as "grouping",
    case when tot = 0 then 0.3 when n_space >= n_comma and n_space >= n_dot then n_space / tot
      when n_comma > n_dot then n_comma / tot else n_dot / tot end as nconf,
    case when n_dmy > 0 and n_mdy > 0 then 'unknown' when n_dmy > 0 then 'dmy' when n_mdy > 0 then 'mdy'
      when n_undecided > 0 then 'unknown' when n_iso > 0 then 'ymd' else 'unknown' end as date_order,
    (n_dmy > 0 and n_mdy > 0) or (n_dmy = 0 and n_mdy = 0 and n_undecided > 0) as ambiguous,
    case when n_dmy > 0 and n_mdy > 0 then 0.0 when n_dmy > 0 or n_mdy > 0
      then least(1.0, 0.8 + greatest(n_dmy, n_mdy) / 100.0)
      when n_undecided > 0 then 0.0 when n_iso > 0 then 1.0 else 0.0 end as dconf from nf)"""


@query("b5_number_format", f"""with {EVIDENCE_SQL}
select col as "column", n_comma, n_dot, n_space, "decimal", "grouping", {O.half_up('nconf', 4)} as confidence,
  case when tot = 0 then 'no separator evidence in the column; assumed 1,234.56'
    when n_space >= n_comma and n_space >= n_dot then n_space || ' of ' || tot || ' values group thousands with a space'
    when n_comma > n_dot then n_comma || ' of ' || tot || ' values use a comma as the decimal point'
    else n_dot || ' of ' || tot || ' values use a dot as the decimal point' end as reason from nf2""")
def _(spark, sf):
    return FM.number_formats(FM.format_evidence(messy(spark, sf), MESSY_TEXT))


@query("b6_date_order", f"""with {EVIDENCE_SQL}
select col as "column", n_iso, n_dmy, n_mdy, n_undecided, date_order, ambiguous,
  {O.half_up('dconf', 4)} as confidence from nf2""")
def _(spark, sf):
    return FM.date_orders(FM.format_evidence(messy(spark, sf), MESSY_TEXT))


def _iso_sql(v, order, zone="UTC"):
    def part(shape, i):
        return f"nullif(regexp_extract(trim({v}), '{shape}', {i}), '')"

    y = part(_PARTS, 3)
    year = f"(case when length({y}) = 2 then case when cast({y} as integer) < 70 then '20' || {y} else '19' || {y} end else {y} end)"
    a, b = part(_PARTS, 1), part(_PARTS, 2)
    d, m = (f"case when {order} = 'dmy' then {x} else {z} end" for x, z in ((a, b), (b, a)))

    def day(yy, mm, dd):
        return f"cast(try_cast(lpad({yy}, 4, '0') || '-' || lpad({mm}, 2, '0') || '-' || lpad({dd}, 2, '0') as date) as varchar)"

    clock = (f"case when regexp_matches(trim({v}), '{_CLOCK}') then "
             f"cast(cast(timezone('{zone}', try_cast(trim({v}) as timestamptz)) as date) as varchar) end")
    iso = day(*(part(_ISO, i) for i in (1, 2, 3)))
    return (f"coalesce({clock}, case when regexp_matches(trim({v}), '{_ISO}') then {iso} "
            f"else {day(year, '(' + m + ')', '(' + d + ')')} end)")


@query("b7_to_iso_date", f"""with {MESSY_SQL}
select order_key, {_iso_sql('dmy_text', "'dmy'")} as day_first, {_iso_sql('mdy_text', "'mdy'")} as month_first,
  {_iso_sql('iso_text', "'mdy'")} as iso, {_iso_sql('instant_text', "'mdy'", 'Asia/Kolkata')} as kolkata,
  {_iso_sql('amount_text', "'mdy'")} as not_a_date from messy""")
def _(spark, sf):
    return messy(spark, sf).select(
        "order_key",
        D.to_iso_date(F.col("dmy_text"), "dmy").alias("day_first"),
        D.to_iso_date(F.col("mdy_text"), "mdy").alias("month_first"),
        D.to_iso_date(F.col("iso_text")).alias("iso"),
        D.to_iso_date(F.col("instant_text"), "mdy", "Asia/Kolkata").alias("kolkata"),
        D.to_iso_date(F.col("amount_text")).alias("not_a_date"),
    )


_KIND_SQL = f"""{EVIDENCE_SQL},
fm as (select col, n_dateish / n >= 0.8 as is_date, n_dateish / n < 0.8 and n_numeric / n >= 0.8 as is_number,
    date_order, ambiguous, "decimal", "grouping", nconf, dconf, n_instants from nf2),
fmt as (select *, case when is_date and date_order = 'dmy' then 'dmy' when is_date and n_instants > 0 then 'mdy'
    when is_number then "decimal" end as rewrite from fm where is_date or is_number)"""


def _plain_text_sql(e):
    return f"regexp_replace(regexp_replace(cast(cast({e} as decimal(38,6)) as varchar), '0+$', ''), '\\.$', '')"


def _normalised_sql(v, rewrite, zone):
    iso = f"case when {rewrite} = 'dmy' then {_iso_sql(v, chr(39) + 'dmy' + chr(39), zone)} else {_iso_sql(v, chr(39) + 'mdy' + chr(39), zone)} end"
    num = f"case when {rewrite} = ',' then {O.parse_number(v, ',')} else {O.parse_number(v)} end"
    legacy = f"(case when trim(regexp_replace({v}, '[$€£₹,()]', '', 'g')) = '' then 0.0 else {O.plain_number(v)} end)"
    return (f"case when {v} is null or trim({v}) = '' then {v} "
            f"when {rewrite} in ('dmy', 'mdy') and ({iso}) is not null then case when ({iso}) <> trim({v}) then {iso} else {v} end "
            f"when {rewrite} in (',', '.') and ({num}) is not null and ({num}) is distinct from {legacy} then {_plain_text_sql(num)} "
            f"else {v} end")


@query("b8_format_notes", f"""with {_KIND_SQL},
done as (select fmt.col, count(*) filter ({_normalised_sql('v', 'rewrite', 'UTC')} is distinct from v) as rewritten
  from cells join fmt on cells.col = fmt.col and rewrite is not null group by 1)
select fmt.col as "column", case when is_date then 'date' else 'number' end as kind,
  case when is_date then case when date_order <> 'unknown' then date_order when ambiguous then 'ambiguous' else 'not a date column' end
    when "decimal" = ',' then '1.234,56' when "grouping" = ' ' then '1 234.56' else '1,234.56' end as decision,
  case when is_date then {O.half_up('dconf', 4)} else {O.half_up('nconf', 4)} end as confidence,
  coalesce(rewritten, 0) as rewritten from fmt left join done on fmt.col = done.col""")
def _(spark, sf):
    return FM.format_notes(messy(spark, sf), MESSY_TEXT)


_B8_COLUMNS = ["euro_text", "space_text", "dmy_text", "instant_text"]


@query("b8_normalised_rows", f"""with {_KIND_SQL}, m as (select map(list(col order by col), list(rewrite order by col)) as rw
    from fmt where rewrite is not null)
select order_key, """ + ", ".join(
    f"{_normalised_sql(c, chr(40) + f'rw[{chr(39)}{c}{chr(39)}]' + chr(41), 'Asia/Kolkata')} as {c}" for c in _B8_COLUMNS)
    + " from messy, m")
def _(spark, sf):
    table = messy(spark, sf).select("order_key", *_B8_COLUMNS)
    formats = FM.detect_formats(table, _B8_COLUMNS)
    return FM.normalise_columns(table, _B8_COLUMNS, formats, "Asia/Kolkata")


_NUMERIC_DATE = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{2,4}"


@query("b9_day_first", f"""with {CELLS_SQL}, f as (select col,
  try_cast(regexp_extract(trim(v), '{_NUMERIC_DATE}', 1) as integer) a,
  try_cast(regexp_extract(trim(v), '{_NUMERIC_DATE}', 2) as integer) b from cells)
select col as "column", coalesce(bool_or(a > 12), false) and not coalesce(bool_or(b > 12), false) as day_first
from f group by 1""")
def _(spark, sf):
    return FM.day_first(messy(spark, sf), MESSY_TEXT)


@query("b10_zoned_day", """select event_id, cast(cast(ts as timestamp) at time zone 'UTC' at time zone 'Asia/Tokyo' as date)::varchar as tokyo_day,
  cast(cast(ts as timestamp) at time zone 'UTC' at time zone 'America/New_York' as date)::varchar as new_york_day,
  cast(ts as date)::varchar as unknown_zone_day from events""")
def _(spark, sf):
    ts = F.col("ts")
    return load(spark, sf, "events").select(
        "event_id",
        D.zoned_day(ts, "Asia/Tokyo").cast("string").alias("tokyo_day"),
        D.zoned_day(ts, "America/New_York").cast("string").alias("new_york_day"),
        D.zoned_day(ts, D.known_zone("Nowhere/Land")).cast("string").alias("unknown_zone_day"),
    )


@query("b11_tidy_key", f"""with {MESSY_SQL}
select order_key, nullif(trim(segment_text), '') as key, lower(nullif(trim(segment_text), '')) as join_key,
  nullif(trim(empty_text), '') as blank_key from messy""")
def _(spark, sf):
    return messy(spark, sf).select(
        "order_key",
        S.tidy_key(F.col("segment_text")).alias("key"),
        S.join_key(F.col("segment_text")).alias("join_key"),
        S.tidy_key(F.col("empty_text")).alias("blank_key"),
    )


# DuckDB has no initcap: words are rebuilt from the split text.
TITLE_SQL = """regexp_replace(list_reduce(list_transform(string_split(lower({v}), ' '),
  lambda w: case when w like 'mc_%' and regexp_matches(w, '^mc[a-z]') then 'Mc' || upper(substr(w, 3, 1)) || substr(w, 4)
    else upper(substr(w, 1, 1)) || substr(w, 2) end), lambda x, y: x || ' ' || y), '^$', '')"""


@query("b12_title_case", f"""with {MESSY_SQL}
select order_key, {TITLE_SQL.format(v='person_text')} as person, {TITLE_SQL.format(v='segment_text')} as segment from messy""")
def _(spark, sf):
    return messy(spark, sf).select(
        "order_key", S.title_case(F.col("person_text")).alias("person"),
        S.title_case(F.col("segment_text")).alias("segment"))


# --- money ----------------------------------------------------------------------------------

_CODES = "['USD','inr','EUR','GBP','AED','SGD','AUD','CAD','JPY','CHF','CNY','ZAR','BRL','MXN','NZD','SEK','XXX']"
_CODE_EXPR = "(o_orderkey % 17)"
_CURRENCY_VALUES = ", ".join(
    f"('{c}', '{s}', '{M.GROUP_MARK[loc]}', {'true' if loc == 'en-IN' else 'false'})" for c, s, _, loc in M.CURRENCIES)
_MONEY_CTE = f"""cur(code, symbol, mark, lakh) as (values {_CURRENCY_VALUES}),
amounts as (select o_orderkey, {_CODES}[cast({_CODE_EXPR} as integer) + 1] as asked,
  case when o_orderkey % 7 = 0 then -o_totalprice else o_totalprice * 10 end as amount from orders),
priced as (select o_orderkey, asked, code, symbol, mark, lakh, cast(floor(amount + 0.5) as bigint) as w
  from amounts left join cur on code = coalesce((select c2.code from cur c2 where c2.code = upper(asked)), 'USD'))"""
_WEST = "replace(format('{:,}', abs(w)), ',', mark)"
_INDIA = """(case when length(abs(w)::varchar) > 3 then reverse(regexp_replace(regexp_replace(reverse(left(abs(w)::varchar, length(abs(w)::varchar) - 3)),
  '([0-9]{2})', '\\1,', 'g'), ',$', '')) || ',' || right(abs(w)::varchar, 3) else abs(w)::varchar end)"""


def _amounts(spark, sf):
    codes = F.expr("array" + _CODES.replace("[", "(").replace("]", ")"))
    orders = load(spark, sf, "orders")
    asked = F.element_at(codes, (F.col("o_orderkey") % 17 + 1).cast("int"))
    amount = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 10)
    return M.with_currency(orders.select("o_orderkey", asked.alias("asked"), amount.alias("amount")), "asked")


@query("b14_money_format", f"""with {_MONEY_CTE}
select o_orderkey, asked, (case when w < 0 then '-' else '' end) || symbol || case when lakh then {_INDIA} else {_WEST} end as printed
from priced""")
def _(spark, sf):
    printed = M.money(F.col("amount"), F.col("symbol"), F.col("group_mark"), F.col("lakh"))
    return _amounts(spark, sf).select("o_orderkey", "asked", printed.alias("printed"))


@query("b15_currency_lookup", f"""with {_MONEY_CTE}
select asked, code, symbol, count(*) as n from priced group by 1, 2, 3""")
def _(spark, sf):
    return _amounts(spark, sf).groupBy("asked", "code", "symbol").agg(F.count("*").alias("n"))


@query("b16_short_number", """with x as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then l_extendedprice else l_discount * 100 + l_linenumber end as v
  from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when abs(v) >= 1000 then format('{:,}', cast(floor(v + 0.5) as bigint))
  else regexp_replace(cast(floor(v * 100 + 0.5) / 100 as varchar), '\\.0$', '') end as printed from x""")
def _(spark, sf):
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(
        F.col("l_discount") * 100 + F.col("l_linenumber"))
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", M.short_number(v).alias("printed"))


# --- labels -----------------------------------------------------------------------------------

_PLACE = """case n_nationkey % 5 when 0 then 'U.S.A.' when 1 then 'Côte d''Ivoire' when 2 then 'Republic of Korea'
  when 3 then ' northern ÅLAND ' else n_name end"""


_NORM_SQL = "regexp_replace(translate(lower({v}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '', 'g')"
ALIAS_VALUES = ", ".join("('{}', '{}')".format(a, n.replace("'", "''")) for a, n in sorted(S.REGION_ALIASES.items()))


@query("b17_region_name", f"""with alias(alias, map_name) as (values {ALIAS_VALUES}),
places as (select c_custkey, {_PLACE} as place from customer left join nation on c_nationkey = n_nationkey)
select c_custkey, {_NORM_SQL.format(v='place')} as normal, map_name from places
left join alias on alias = {_NORM_SQL.format(v='place')}""")
def _(spark, sf):
    customers = load(spark, sf, "customer").join(
        load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    named = customers.select("c_custkey", S.normalise_region(F.expr(_PLACE)).alias("normal"))
    return named.join(F.broadcast(S.region_aliases(spark)), F.col("normal") == F.col("alias"), "left").select(
        "c_custkey", "normal", "map_name")


@query("b18_row_identity", """select o_custkey || '|' || cast(cast(o_orderdate as date) as varchar) as identity, count(*) as n
from orders group by 1""")
def _(spark, sf):
    key = S.row_identity(F.col("o_custkey"), F.to_date("o_orderdate"))
    return load(spark, sf, "orders").groupBy(key.alias("identity")).agg(F.count("*").alias("n"))


@query("b19_window_phrase", """with d as (select l_shipdate::date - o_orderdate::date as days from lineitem join orders on l_orderkey = o_orderkey)
select days, case when days <= 0 then 'the previous period' when days <= 10 then 'the previous week'
  when days <= 45 then 'the previous month' when days <= 135 then 'the previous quarter'
  when days <= 400 then 'the previous year' else 'the previous period' end as phrase, count(*) as n from d group by 1, 2""")
def _(spark, sf):
    joined = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return joined.groupBy(days.alias("days")).agg(F.count("*").alias("n")).select(
        "days", S.window_phrase(F.col("days")).alias("phrase"), "n")


_QUESTION = """case o_orderkey % 12 when 0 then 'Predict next month revenue' when 1 then 'Why did profit fall?'
  when 2 then 'Which products are declining' when 3 then 'fastest growing regions' when 4 then 'Highest sales month'
  when 5 then 'worst month for units' when 6 then 'monthly trend of orders' when 7 then 'top ' || (o_orderkey % 80) || ' customers'
  when 8 then '5 regions by net income' when 9 then 'best category' when 10 then 'revenue by department'
  else 'client list ' || o_orderpriority end"""
_QUESTIONS_SQL = f"""select o_orderkey as id, 'orders' as source, {_QUESTION} as text from orders
  union all select conv_id * 1000 + turn, 'conversations', text from conversations"""


def _words(pairs):
    return "case " + " ".join(f"when regexp_matches(q, '\\b{w}\\b') then '{d}'" for w, d in pairs) + " end"


_DIM_SQL = _words(S.DIMENSION_WORDS.items())
_METRIC_SQL = _words(sorted(((w, m) for m, ws in S.METRIC_WORDS.items() for w in ws), key=lambda p: -len(p[0])))
_TOP = r"top\s+([0-9]+)|([0-9]+)\s+(customers|products|regions|items)"


@query("b20_question_intent", f"""with questions as ({_QUESTIONS_SQL}), qs as (select *, lower(text) as q from questions),
tagged as (select *, {_DIM_SQL} as dim, coalesce({_METRIC_SQL}, 'revenue') as metric,
  try_cast(coalesce(nullif(regexp_extract(q, '{_TOP}', 1), ''), nullif(regexp_extract(q, '{_TOP}', 2), '')) as integer) as asked from qs),
done as (select *, case when regexp_matches(q, 'predict|forecast|next month|next quarter|projection|will be') then 'forecast'
  when regexp_matches(q, 'why|reason|cause') then 'explain_change'
  when regexp_matches(q, 'declin|falling|dropping|grow|rising|fastest|climbing') then
    case when regexp_matches(q, 'grow|rising|fastest|climbing') then 'growing_groups' else 'declining_groups' end
  when regexp_matches(q, 'highest|lowest|best|worst') then case when regexp_matches(q, 'lowest|worst') then 'min_period' else 'max_period' end
  when dim = 'date' then 'trend' else 'top_n' end as intent from tagged)
select id, source, intent, metric,
  case when intent in ('forecast','explain_change','max_period','min_period','trend') then 'date'
    when intent in ('growing_groups','declining_groups') then coalesce(dim, 'product_name') else coalesce(dim, '') end as dimension,
  least(50, greatest(1, case when asked = 0 then 10 else coalesce(asked, 10) end)) as row_limit,
  case when intent in ('forecast','trend') then 'line' else 'bar' end as chart from done""")
def _(spark, sf):
    asked = load(spark, sf, "orders").selectExpr("o_orderkey as id", "'orders' as source", f"{_QUESTION} as text")
    said = load(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn as id", "'conversations' as source", "text")
    return S.tag_questions(asked.unionByName(said), "text", most=50).drop("text")


# --- calendar -----------------------------------------------------------------------------------

APRIL = Calendar(fiscal_year_start_month=4)
RETAIL = Calendar(fiscal_year_start_month=2, scheme="445", week_start_day=0)


def fiscal_year_sql(d, cal):
    if cal.is_retail:
        opened = f"{d} >= {retail_start_sql(f'year({d})', cal)}"
    else:
        opened = f"month({d}) >= {cal.fiscal_year_start_month}"
    return f"(case when {opened} then year({d}) else year({d}) - 1 end)"


def retail_start_sql(year, cal):
    anchor = f"make_date({year}, {cal.fiscal_year_start_month}, 1)"
    return f"({anchor} + cast(({cal.week_start_day} - dayofweek({anchor}) + 7) % 7 as integer))"


def retail_period_sql(d, cal):
    week = f"cast(floor(({d} - {retail_start_sql(fiscal_year_sql(d, cal), cal)}) / 7) as integer)"
    total, parts = 0, []
    for n, weeks in enumerate(cal.weeks, start=1):
        total += weeks
        parts.append(f"when {week} < {total} then {n}")
    return "(case " + " ".join(parts) + " else 12 end)"


def grain_key_sql(d, cal, grain="period"):
    year = f"{fiscal_year_sql(d, cal)}::varchar"
    if not cal.is_retail:
        if grain == "period":
            return f"strftime({d}, '%Y-%m')"
        if grain == "year":
            return year
        elapsed = f"((year({d}) - {fiscal_year_sql(d, cal)}) * 12 + month({d}) - {cal.fiscal_year_start_month})"
        return f"({year} || '-Q' || cast(floor({elapsed} / 3) + 1 as integer))"
    p = retail_period_sql(d, cal)
    if grain == "year":
        return f"('FY' || {year})"
    if grain == "quarter":
        return f"('FY' || {year} || '-Q' || cast(ceil({p} / 3) as integer))"
    return f"('FY' || {year} || '-P' || lpad({p}::varchar, 2, '0'))"


ORDER_DAYS = "(select cast(o_orderdate as date) as d, count(*) as n from orders group by 1)"


def order_days(spark, sf):
    return load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query("i1_fiscal_year", f"""select {fiscal_year_sql('d', APRIL)} as april_year, {fiscal_year_sql('d', RETAIL)} as retail_year,
  cast(sum(n) as bigint) as n from {ORDER_DAYS} group by 1, 2""")
def _(spark, sf):
    d = F.col("d")
    return order_days(spark, sf).groupBy(
        C.fiscal_year(d, APRIL).alias("april_year"), C.fiscal_year(d, RETAIL).alias("retail_year")
    ).agg(F.sum("n").alias("n"))


@query("i2_retail_year_start", f"""select distinct year(d) as year, cast({retail_start_sql('year(d)', RETAIL)} as varchar) as opens
from {ORDER_DAYS}""")
def _(spark, sf):
    years = order_days(spark, sf).select(F.year("d").alias("year")).distinct()
    return years.select("year", C.retail_year_start(F.col("year"), RETAIL).cast("string").alias("opens"))


_SCHEMES = {s: Calendar(2, s, 0) for s in ("calendar", "445", "454", "544")}


@query("i3_period_key", "select cast(d as varchar) as day, " + ", ".join(
    f"{grain_key_sql('d', c)} as key_{s}" for s, c in _SCHEMES.items()) + f", n from {ORDER_DAYS}")
def _(spark, sf):
    return order_days(spark, sf).select(
        F.col("d").cast("string").alias("day"),
        *[C.period_key(F.col("d"), c).alias(f"key_{s}") for s, c in _SCHEMES.items()], "n")


_GRAIN_COLUMNS = [(g, n, c) for n, c in (("april", APRIL), ("retail", RETAIL)) for g in C.GRAINS]


@query("i4_grain_key", "select " + ", ".join(
    f"{grain_key_sql('d', c, g)} as {n}_{g}" for g, n, c in _GRAIN_COLUMNS)
    + f", cast(sum(n) as bigint) as n from {ORDER_DAYS} group by all")
def _(spark, sf):
    keys = [C.grain_key(F.col("d"), c, g).alias(f"{n}_{g}") for g, n, c in _GRAIN_COLUMNS]
    return order_days(spark, sf).groupBy(*keys).agg(F.sum("n").alias("n"))


# Every key the two calendars write over the order days, plus two that neither does.
_KEYS_SQL = "keys as (" + " union ".join(
    f"select {grain_key_sql('d', c, g)} as key from {ORDER_DAYS}" for g, _, c in _GRAIN_COLUMNS
) + " union select 'odd-' || year(d) from " + ORDER_DAYS + " union select year(d) || '-13' from " + ORDER_DAYS + ")"


def _keys(spark, sf):
    days = order_days(spark, sf)
    listed = F.array(
        *[C.grain_key(F.col("d"), c, g) for g, _, c in _GRAIN_COLUMNS],
        F.concat(F.lit("odd-"), F.year("d").cast("string")), F.concat(F.year("d").cast("string"), F.lit("-13")))
    return days.select(F.explode(listed).alias("key")).distinct()


@query("i5_grain_of_key", f"""with {_KEYS_SQL}
select key, case when regexp_matches(key, '^(FY)?[0-9]{{4}}$') then 'year'
  when regexp_matches(key, '^(FY)?[0-9]{{4}}-Q[1-4]$') then 'quarter'
  when regexp_matches(key, '^([0-9]{{4}}-|FY[0-9]{{4}}-P)(0[1-9]|1[0-2])$') then 'period' end as grain from keys""")
def _(spark, sf):
    return _keys(spark, sf).select("key", C.grain_of(F.col("key")).alias("grain"))


_I6_DAYS = """span as (select min(cast(o_orderdate as date)) - 800 lo, max(cast(o_orderdate as date)) + 800 hi from orders),
days as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from span)"""


@query("i6_period_range", f"""with {_KEYS_SQL}, {_I6_DAYS}, bounds as (
""" + " union ".join(f"select {grain_key_sql('d', c, g)} as key, min(d) as f, max(d) as t from days group by 1"
                     for g, _, c in _GRAIN_COLUMNS) + """)
select keys.key, cast(f as varchar) as period_from, cast(t as varchar) as period_to from keys left join bounds on keys.key = bounds.key
where not regexp_matches(keys.key, '^[0-9]{4}$') and not regexp_matches(keys.key, '^[0-9]{4}-Q')
  or keys.key in (select distinct """ + grain_key_sql('d', APRIL, 'year') + " from days) or keys.key like '%-Q%'")
def _(spark, sf):
    keys = _keys(spark, sf)
    retail = C.with_period_range(keys.where(F.col("key").startswith("FY")), "key", RETAIL)
    april = C.with_period_range(keys.where(~F.col("key").startswith("FY")), "key", APRIL)
    return retail.unionByName(april).select(
        "key", F.col("period_from").cast("string").alias("period_from"), F.col("period_to").cast("string").alias("period_to"))


_YR, _IX = "cast(regexp_extract(key, '([0-9]{4})', 1) as integer)", "try_cast(regexp_extract(key, '^(FY[0-9]{4}-P|[0-9]{4}-)([0-9]{2})$', 2) as integer)"


@query("i7_next_period", f"""with {_KEYS_SQL}
select key, case when {_IX} is null then null when key like 'FY%'
  then case when {_IX} >= 12 then 'FY' || ({_YR} + 1) || '-P01' else 'FY' || {_YR} || '-P' || lpad(({_IX} + 1)::varchar, 2, '0') end
  else case when {_IX} >= 12 then ({_YR} + 1) || '-01' else {_YR} || '-' || lpad(({_IX} + 1)::varchar, 2, '0') end end as next_key
from keys""")
def _(spark, sf):
    return _keys(spark, sf).select("key", C.next_period(F.col("key")).alias("next_key"))


@query("i8_period_index", f"with {_KEYS_SQL} select key, {_IX} as period_index from keys")
def _(spark, sf):
    return _keys(spark, sf).select("key", C.period_index(F.col("key")).alias("period_index"))


@query("i9_period_label", f"""with {_KEYS_SQL}
select key, case when key like 'FY%-%' then left(key, 6) || ' ' || substr(key, 8, 1) || cast(substr(key, 9) as integer)
  when key like 'FY%' then key when regexp_matches(key, '^[0-9]{{4}}-Q') then 'FY' || left(key, 4) || ' ' || substr(key, 6)
  when regexp_matches(key, '^[0-9]{{4}}-(0[1-9]|1[0-2])$') then strftime(cast(key || '-01' as date), '%b %Y')
  when regexp_matches(key, '^[0-9]{{4}}$') then 'FY' || key else key end as label from keys
where key not like '%-13'""")
def _(spark, sf):
    return _keys(spark, sf).where(~F.col("key").endswith("-13")).select(
        "key", C.period_label(F.col("key"), APRIL).alias("label"))


@query("i11_calendar_dimension", f"""with span as (select min(cast(o_orderdate as date)) lo, max(cast(o_orderdate as date)) hi from orders),
days as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from span),
wide as (select cast(unnest(generate_series(lo - 800, hi + 800, interval 1 day)) as date) as d from span),
b as (select {grain_key_sql('d', RETAIL)} as period, min(d) f, max(d) t from wide group by 1)
select cast(d as varchar) as day, {fiscal_year_sql('d', RETAIL)} as fiscal_year, {grain_key_sql('d', RETAIL, 'year')} as year_key,
  {grain_key_sql('d', RETAIL, 'quarter')} as quarter_key, b.period, {retail_period_sql('d', RETAIL)} as period_index,
  left(b.period, 6) || ' P' || {retail_period_sql('d', RETAIL)} as period_label,
  cast(f as varchar) as period_from, cast(t as varchar) as period_to
from days join b on b.period = {grain_key_sql('d', RETAIL)}""")
def _(spark, sf):
    dimension = C.calendar_dimension(order_days(spark, sf), "d", RETAIL)
    return dimension.select(
        F.col("day").cast("string").alias("day"), "fiscal_year", "year_key", "quarter_key", "period", "period_index",
        "period_label", F.col("period_from").cast("string").alias("period_from"),
        F.col("period_to").cast("string").alias("period_to"))
