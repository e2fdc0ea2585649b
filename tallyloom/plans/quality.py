"""Profiles, quality issues and cleaning recipes over messy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numbers import round_half_up
from tallyloom.operators import clean as CL, formats as FM, profile as PR
from tallyloom.plans import oracle as O
from tallyloom.plans.registry import query
from tallyloom.plans.scalars import TITLE_SQL, _iso_sql
from tallyloom.plans.views import CELLS_SQL, MESSY_SQL, MESSY_TEXT, ident, load, messy

_LOOKS = r"""(regexp_matches(t, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') or regexp_matches(t, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}')
  or regexp_matches(t, '^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})([T ].*)?$'))"""


def judged_sql(cells_sql: str) -> str:
    return f"""{cells_sql}, trimmed as (select col, v, trim(v) as t, v is null or trim(v) = '' as blank from cells),
judged as (select *, {O.plain_number('t')} as x, regexp_matches(t, '^\\s*[-(]?\\s*[$€£₹]\\s?[0-9,]+(\\.[0-9]+)?\\s*\\)?\\s*$') as currency,
    lower(t) in ('true','false','yes','no') as flag, {_LOOKS} as dateish,
    regexp_matches(regexp_replace(t, '[A-Za-z%]', '', 'g'), '^\\s*-?[0-9,]*\\.?[0-9]+\\s*$') as textnum from trimmed where not blank),
stats as (select c.col, c.n_rows, c.n_rows - coalesce(f.filled, 0) as missing, coalesce(f.filled, 0) as filled, f.* exclude (col, filled)
  from (select col, count(*) as n_rows from cells group by 1) c left join (select col, count(*) as filled, count(distinct t) as uniq,
    count(*) filter (v <> t) as spaced, count(x) as n_number, count(*) filter (x is null and textnum) as with_text,
    count(*) filter (currency) as n_currency, count(*) filter (flag) as n_flag, count(*) filter (dateish) as n_date,
    min(x) as lo, max(x) as hi, avg(x) as mean, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3,
    stddev_pop(x) as sd, bool_and(x = floor(x)) as whole, bool_and(regexp_matches(t, '^[0-9]{{3,}}$')) as all_digits,
    min(length(t)) as shortest, max(length(t)) as longest from judged group by 1) f on c.col = f.col),
typed as (select *, case when filled = 0 then 'empty' when n_date / filled > 0.7 then 'date' when n_currency / filled > 0.5 then 'currency'
    when (n_number + with_text) / filled > 0.8 then 'number' when n_flag / filled > 0.8 then 'boolean'
    when uniq <= greatest(20, filled * 0.1) then 'category' else 'text' end as type from stats),
outl as (select j.col, count(*) as outliers from judged j join typed s on j.col = s.col
  where n_number >= 8 and (x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) group by 1),
folded as (select distinct col from (select col, lower(t), count(distinct t) as k from judged group by 1, 2) where k > 1),
smp as (select col, string_agg(t, '|' order by t) as samples from (select col, t, row_number() over (partition by col order by t) as r
  from (select distinct col, t from judged)) where r <= 5 group by 1),
prof as (select s.col as "column", type, n_rows, missing, cast(floor(missing / n_rows * 100 + 0.5) as bigint) as missing_pct, coalesce(uniq, 0) as unique_values,
    case when type in ('number','currency') then lo end as min, case when type in ('number','currency') then hi end as max,
    case when type in ('number','currency') then {O.half_up('mean', 4)} end as mean, coalesce(samples, '') as samples,
    coalesce(spaced, 0) as whitespace, coalesce(with_text, 0) as numeric_with_text,
    case when type in ('number','currency') then coalesce(outliers, 0) else 0 end as outliers,
    type = 'category' and f.col is not null as inconsistent_case
  from typed s left join outl o on s.col = o.col left join folded f on s.col = f.col left join smp p on s.col = p.col)"""


JUDGED_SQL = judged_sql(CELLS_SQL)
_ALL_MESSY = ", ".join(f'"{c}"' for c in MESSY_TEXT)


def issues_sql(profile_sql: str, table: str, columns: str) -> str:
    return f"""{profile_sql},
dup as (select sum(k) as n_rows, sum(k - 1) as d from (select count(*) as k from {table} group by {columns})),
issues as (select 'empty_column' as type, "column", n_rows as affected_rows, 'MEDIUM' as severity, true as auto_fixable, n_rows from prof where type = 'empty'
  union all select 'missing_values', "column", missing, case when missing_pct > 40 then 'HIGH' when missing_pct > 10 then 'MEDIUM' else 'LOW' end, true, n_rows
    from prof where type <> 'empty' and missing > 0
  union all select 'numeric_with_text', "column", numeric_with_text, 'MEDIUM', true, n_rows from prof where type in ('number','currency') and numeric_with_text > 0
  union all select 'whitespace', "column", whitespace, 'LOW', true, n_rows from prof where whitespace > 0
  union all select 'inconsistent_case', "column", 0, 'LOW', true, n_rows from prof where inconsistent_case
  union all select 'outliers', "column", outliers, 'LOW', false, n_rows from prof where outliers > 0
  union all select 'suspicious_column_name', "column", 0, 'LOW', false, n_rows from prof where regexp_matches("column", '[^A-Za-z0-9 _]')
  union all select 'duplicate_rows', null, d, case when d > n_rows * 0.05 then 'HIGH' else 'MEDIUM' end, true, n_rows from dup where d > 0),
score as (select cast(greatest(0, least(100, floor(100 - coalesce(sum(case severity when 'HIGH' then 8 when 'MEDIUM' then 4 else 1.5 end
    * (0.4 + 0.6 * least(1, case when affected_rows = 0 then 0.2 else affected_rows / n_rows end))), 0) + 0.5))) as bigint) as score, count(*) as issues from issues)"""


ISSUES_SQL = issues_sql(JUDGED_SQL, "messy", _ALL_MESSY)


@query("c1_column_profile", f"with {JUDGED_SQL} select * from prof")
def _(spark, sf):
    return PR.profile(messy(spark, sf), MESSY_TEXT)


@query("c1_merged_states", f"""with {JUDGED_SQL} select col as "column", n_rows, missing, coalesce(spaced, 0) as spaced, coalesce(n_number, 0) as n_number,
  coalesce(with_text, 0) as with_text, coalesce(n_currency, 0) as n_currency, coalesce(n_flag, 0) as n_flag, coalesce(n_date, 0) as n_date, lo, hi, shortest, longest from stats""")
def _(spark, sf):
    """The profile of a table from the states of its parts, as after appends."""
    rows = messy(spark, sf)
    part = F.pmod(F.xxhash64("order_key"), F.lit(3))
    states = None
    for k in range(3):
        one = PR.column_states(rows.where(part == k), MESSY_TEXT, sketches=True)
        states = one if states is None else states.unionByName(one)
    return PR.merge_states(states).select("column", "n_rows", "missing", "spaced", "n_number", "with_text", "n_currency", "n_flag", "n_date", "lo", "hi", "shortest", "longest")


@query("c2_type_inference", f"""with {JUDGED_SQL} select col as "column", type from typed""")
def _(spark, sf):
    return PR.column_types(messy(spark, sf), MESSY_TEXT)


_NUMERIC_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_skewed"]
_LINES = "select l_quantity, l_extendedprice, l_discount, l_extendedprice * l_quantity * l_quantity as l_skewed from lineitem"


@query("c3_iqr_outlier_count", f"""with wide as ({_LINES}), cells as (
""" + " union all ".join(f"select '{c}' as col, {c} as x from wide" for c in _NUMERIC_LINES) + """),
q as (select col, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from cells group by 1)
select c.col as "column", count(*) filter (x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outliers from cells c join q on c.col = q.col group by 1""")
def _(spark, sf):
    wide = load(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * l_quantity * l_quantity as l_skewed")
    long = wide.unpivot([], _NUMERIC_LINES, "column", "number")
    return PR.outlier_counts(long)


@query("c4_zscore_outliers", """with x as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_quantity as x from lineitem),
s as (select avg(x) m, stddev_pop(x) sd from x)
select l_orderkey, l_linenumber, l_partkey, floor((x - m) / sd * 10000 + 0.5) / 10000 as z from x, s where abs((x - m) / sd) >= 2.5""")
def _(spark, sf):
    lines = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice * l_quantity as x")
    return PR.zscore_outliers(lines, "x", 2.5).select(
        "l_orderkey", "l_linenumber", "l_partkey", round_half_up(F.col("z"), 4).alias("z"))


@query("c5_iqr_outlier_rows", """with q as (select quantile_cont(l_extendedprice * l_quantity, 0.25) q1, quantile_cont(l_extendedprice * l_quantity, 0.75) q3 from lineitem)
select l_orderkey, l_linenumber, l_partkey from lineitem, q
where l_extendedprice * l_quantity < q1 - 1.5 * (q3 - q1) or l_extendedprice * l_quantity > q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    lines = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice * l_quantity as x")
    return PR.iqr_outliers(lines, "x").drop("x")


def _profile_columns(spark, sf, *columns):
    return PR.profile(messy(spark, sf), MESSY_TEXT).select("column", *columns)


@query("c6_whitespace_count", f"""with {JUDGED_SQL} select col as "column", coalesce(spaced, 0) as whitespace from stats""")
def _(spark, sf):
    return PR.cell_counts(messy(spark, sf), MESSY_TEXT).select("column", "whitespace")


@query("c7_numeric_with_text", f"""with {JUDGED_SQL} select col as "column", coalesce(with_text, 0) as numeric_with_text from stats""")
def _(spark, sf):
    return PR.cell_counts(messy(spark, sf), MESSY_TEXT).select("column", "numeric_with_text")


@query("c8_inconsistent_case", f"""with {JUDGED_SQL}
select col as "column", count(*) as folded_values from (select col, lower(t), count(distinct t) as k from judged group by 1, 2) where k > 1 group by 1""")
def _(spark, sf):
    return PR.inconsistent_case(PR.value_counts(messy(spark, sf), MESSY_TEXT))


@query("c9_duplicate_rows", f"""with {MESSY_SQL} select cast(sum(k) as bigint) as n_rows, cast(sum(k - 1) as bigint) as duplicates from (
  select count(*) as k from messy group by all order_key, {_ALL_MESSY})""".replace("group by all ", "group by "))
def _(spark, sf):
    return PR.duplicate_rows(messy(spark, sf))


@query("c10_empty_column", f"""with {JUDGED_SQL} select col as "column", n_rows from stats where filled = 0""")
def _(spark, sf):
    return PR.cell_counts(messy(spark, sf), MESSY_TEXT).where("missing = n_rows").select("column", "n_rows")


@query("c12_quality_issues", f"""with {ISSUES_SQL} select type, "column", cast(affected_rows as bigint) as affected_rows, severity, auto_fixable from issues""")
def _(spark, sf):
    return PR.quality_issues(messy(spark, sf), MESSY_TEXT).drop("n_rows")


@query("c13_quality_score", f"with {ISSUES_SQL} select * from score")
def _(spark, sf):
    return PR.quality_score(PR.quality_issues(messy(spark, sf), MESSY_TEXT))


# --- cleaning -----------------------------------------------------------------------------------

RECIPE_COLUMNS = ["amount_text", "segment_text", "flag_text", "person_text", "empty_text"]
RECIPE = [
    CL.Step("empty_column", "empty_text"),
    CL.Step("whitespace", "amount_text"),
    CL.Step("whitespace", "segment_text"),
    CL.Step("inconsistent_case", "segment_text"),
    CL.Step("inconsistent_case", "person_text"),
    CL.Step("numeric_with_text", "amount_text"),
    CL.Step("missing_values", "flag_text", "Unknown"),
    CL.Step("missing_values", "amount_text", 0),
    CL.Step("duplicate_rows"),
]


def _numeric_text(v):
    kept = f"regexp_replace({v}, '[^0-9.\\-]', '', 'g')"
    number = O.to_double(kept)
    text = f"regexp_replace(regexp_replace(cast(cast({number} as decimal(38,6)) as varchar), '0+$', ''), '\\.$', '')"
    return f"case when {number} is not null then {text} else {v} end", f"{number} is not null"


_NT, _NT_HIT = _numeric_text("a1")
_SEG2 = TITLE_SQL.format(v="s1")
_PER2 = TITLE_SQL.format(v="person_text")
CLEAN_SQL = f"""{MESSY_SQL}, s1 as (select order_key, amount_text, trim(amount_text) as a1, segment_text, trim(segment_text) as s1, flag_text, person_text from messy),
s2 as (select *, {_SEG2} as s2, {_PER2} as p1, {_NT} as a2, coalesce({_NT_HIT}, false) as a2_hit from s1),
s3 as (select *, case when flag_text is null or flag_text = '' then 'Unknown' else flag_text end as f1,
  case when a2 is null or a2 = '' then '0' else a2 end as a3 from s2),
cleaned as (select distinct order_key, a3 as amount_text, s2 as segment_text, f1 as flag_text, p1 as person_text from s3)"""


def _recipe_input(spark, sf):
    return messy(spark, sf).select("order_key", *RECIPE_COLUMNS)


@query("d2_apply_recipe", f"with {CLEAN_SQL} select * from cleaned")
def _(spark, sf):
    return CL.apply_recipe(_recipe_input(spark, sf), RECIPE)


def _step_query(name, steps, sql, columns):
    @query(name, sql)
    def _(spark, sf):
        return CL.apply_recipe(messy(spark, sf).select(*[ident(c) for c in columns]), steps)


_step_query("d3_drop_empty_column", [CL.Step("empty_column", "empty_text")],
            f"with {MESSY_SQL} select order_key, flag_text from messy", ["order_key", "flag_text", "empty_text"])
_step_query("d4_trim_whitespace", [CL.Step("whitespace", "segment_text"), CL.Step("whitespace", "iso_text")],
            f"with {MESSY_SQL} select order_key, trim(segment_text) as segment_text, trim(iso_text) as iso_text from messy",
            ["order_key", "segment_text", "iso_text"])
_step_query("d5_normalise_case", [CL.Step("inconsistent_case", "person_text")],
            f"with {MESSY_SQL} select order_key, {_PER2} as person_text from messy", ["order_key", "person_text"])
_step_query("d6_coerce_numeric", [CL.Step("numeric_with_text", "amount_text")],
            f"with {MESSY_SQL} select order_key, {_numeric_text('amount_text')[0]} as amount_text from messy", ["order_key", "amount_text"])
_step_query("d7_fill_missing", [CL.Step("missing_values", "flag_text", "Unknown"), CL.Step("missing_values", "iso_text", "none")],
            f"""with {MESSY_SQL} select order_key, case when flag_text is null or flag_text = '' then 'Unknown' else flag_text end as flag_text,
  case when iso_text is null or iso_text = '' then 'none' else iso_text end as iso_text from messy""", ["order_key", "flag_text", "iso_text"])
_step_query("d8_remove_duplicates", [CL.Step("duplicate_rows")],
            f"with {MESSY_SQL} select distinct segment_text, flag_text, person_text from messy", ["segment_text", "flag_text", "person_text"])


@query("d9_applied_log", f"""with {CLEAN_SQL}, log as (
select 0 as position, 'empty_column' as type, 'empty_text' as "column", count(*) as affected_rows from s3
union all select 1, 'whitespace', 'amount_text', count(*) filter (a1 is distinct from amount_text) from s3
union all select 2, 'whitespace', 'segment_text', count(*) filter (s1 is distinct from segment_text) from s3
union all select 3, 'inconsistent_case', 'segment_text', count(*) filter (s2 is distinct from s1) from s3
union all select 4, 'inconsistent_case', 'person_text', count(*) filter (p1 is distinct from person_text) from s3
union all select 5, 'numeric_with_text', 'amount_text', count(*) filter (a2_hit) from s3
union all select 6, 'missing_values', 'flag_text', count(*) filter (flag_text is null or flag_text = '') from s3
union all select 7, 'missing_values', 'amount_text', count(*) filter (a2 is null or a2 = '') from s3
union all select 8, 'duplicate_rows', null, (select count(*) from s3) - (select count(*) from cleaned))
select * from log where affected_rows > 0""")
def _(spark, sf):
    return CL.applied_log(_recipe_input(spark, sf), RECIPE)


_D11 = ["amount_text", "segment_text", "flag_text", "person_text"]
_D11_BEFORE = "cells as (" + " union all ".join(f"select '{c}' as col, {c} as v from messy" for c in _D11) + ")"
_D11_AFTER = "cells as (" + " union all ".join(f"select '{c}' as col, {c} as v from cleaned" for c in _D11) + ")"


@query("d11_quality_change", f"""with {CLEAN_SQL},
b as (with {issues_sql(judged_sql(_D11_BEFORE), '(select amount_text, segment_text, flag_text, person_text from messy)', ', '.join(_D11))} select type, "column", affected_rows, score from issues, score),
a as (with {issues_sql(judged_sql(_D11_AFTER), '(select amount_text, segment_text, flag_text, person_text from cleaned)', ', '.join(_D11))} select type, "column", affected_rows, score from issues, score)
select coalesce(b.type, a.type) as type, coalesce(b."column", a."column", '') as "column",
  cast(coalesce(b.affected_rows, 0) as bigint) as before_rows, cast(coalesce(a.affected_rows, 0) as bigint) as after_rows,
  b.type is not null as before, a.type is not null as after,
  (select max(score) from b) as before_score, (select max(score) from a) as after_score
from b full join a on b.type = a.type and b."column" is not distinct from a."column" """)
def _(spark, sf):
    table = _recipe_input(spark, sf)
    return CL.quality_change(table, CL.apply_recipe(table, RECIPE), _D11)
