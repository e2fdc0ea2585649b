"""The whole bake-off in DuckDB SQL: every method at every origin, scores, selection and bands."""

from __future__ import annotations

from itertools import product

from tallyloom.operators import forecast as FC
from tallyloom.plans import oracle as O
from tallyloom.plans.analysis import _MAD_SQL

_AT = {m: i for i, (m, _) in enumerate(FC.METHODS)}
_UP = "(floor(({}) * {} + 0.5) / {})"
_UP_OF_MEAN = "(floor(coalesce(cast(try_cast({0} as decimal(38,8)) as double), {0}) * {1} + 0.5) / {2})"


def _grid(name: str, methods: list[str]) -> str:
    """Points of the grids of some methods; axes a method lacks stand at their idle value."""
    rows = []
    for m in methods:
        axes = FC._GRIDS[m]
        for i, values in enumerate(product(*axes.values())):
            point = {"alpha": 0.0, "beta": 0.0, "gamma": 0.0, "phi": 1.0} | dict(zip(axes, values))
            text = ", ".join(f"{k}={v:g}" for k, v in zip(axes, values))
            rows.append(f"({_AT[m]}, {i}, {dict(FC.METHODS)[m]}, '{text}', " + ", ".join(f"{point[k]}::double" for k in ("alpha", "beta", "gamma", "phi")) + ")")
    return f"{name}(m, i, least, params, alpha, beta, gamma, phi) as (values {', '.join(rows)})"


def _winters(name: str, times: bool) -> str:
    m = _AT["holt_winters_multiplicative" if times else "holt_winters_additive"]
    along, usual = "(l + b)", "z[slot + 1]"
    fitted, bare = (f"({along} * {usual})", f"(y / {usual})") if times else (f"({along} + {usual})", f"(y - {usual})")
    after = f"(alpha * {bare} + (1 - alpha) * {along})"
    left = f"(y / {after})" if times else f"(y - {after})"
    first = f"max_by({'y / base' if times else 'y - base'}, t) filter (c.slot = slots.slot)"
    return f"""{name}1 as (select k, slots.slot, coalesce({first}, {1 if times else 0}) as z from c join years using (k), (select unnest(range(0, 12)) as slot) slots
  where t < 12 and {'base > 0 and pos' if times else 'true'} group by all),
{name}0 as (select k, list(z order by slot) as z from {name}1 group by 1),
{name} as (select y1.k, grid_w.i, -1::bigint as t, base as l, rise as b, z, 0.0::double as e, 0.0::double as q from years y1 join {name}0 using (k), grid_w where grid_w.m = {m}
  union all select w.k, w.i, c.t, {after}, beta * ({after} - l) + (1 - beta) * b, z[1:slot] || [gamma * {left} + (1 - gamma) * {usual}] || z[slot + 2:],
    e + case when c.t = 0 then 0 else (y - {fitted}) ** 2 end, q + (raw - {fitted}) ** 2 from {name} w join c on c.k = w.k and c.t = w.t + 1 join grid_w on grid_w.i = w.i and grid_w.m = {m})"""


def bake_off_sql(series: str, horizon: int) -> str:
    """CTEs from `series`, which ends in s (k, period, value), to `board` and `points`; they need `with recursive`."""
    names = ", ".join(f"({i}, '{m}', {least}, {str(m in FC.POSITIVE_ONLY).lower()})" for i, (m, least) in enumerate(FC.METHODS))
    fixed = lambda m, q, value, more="": f"""select k, o, cut, {_AT[m]} as m, null as params, {q} as q, step, {value} as pred from {more}"""
    line, usual = "(start + slope * t)", "(start + slope * (cut - 1 + step))"
    rank = lambda p: f"quantile_cont(off, {p})"
    return f"""{series}, {_MAD_SQL.format(k='k')},
clamped as (select k, period, case when abs(z) >= 3.5 then least({O.r2('med + 3.5 * sc')}, greatest({O.r2('med - 3.5 * sc')}, value)) else value end as y from m4),
c as (select s.k, s.period, cast(s.value as double) as raw, cast(coalesce(clamped.y, s.value) as double) as y, cast(right(s.period, 2) as integer) - 1 as slot,
  row_number() over (partition by s.k order by s.period) - 1 as t, count(*) over (partition by s.k) as n, max(s.period) over (partition by s.k) as lp from s left join clamped using (k, period)),
hist as (select k, any_value(n) as n, any_value(lp) as lp, bool_and(raw > 0) as pos, max_by(slot, t) as last_slot, max_by(raw, t) as last_raw,
  greatest(1, least({min(horizon, FC.MAX_SCORED_HORIZON)}, any_value(n) - 2)) as held, case when any_value(n) < 12 then 1 when any_value(n) < 24 then 3 when any_value(n) < 48 then 5 else 8 end as origins_
  from c group by k having any_value(n) >= 2),
cuts as (select * from (select hist.*, o, case when o = 0 then n else n - held - o + 1 end as cut from hist, (select unnest(range(0, 9)) as o) where o <= origins_) where cut >= 2),
ahead_ as (select k, o, cut, n, last_slot, unnest(range(1, case when o = 0 then {horizon} else held end + 1)) as step from cuts),
stp as (select a.k, a.o, a.cut, a.step, coalesce(c.slot, (last_slot + step) % 12) as slot from ahead_ a left join c on c.k = a.k and c.t = a.cut + a.step - 1),
p as (select cuts.k, o, cut, c.t, c.y, c.raw, c.slot, lag(c.y) over w as y1, lag(c.y, 12) over w as y12, lag(c.raw) over w as r1, lag(c.raw, 12) over w as r12
  from cuts join c on c.k = cuts.k and c.t < cut window w as (partition by cuts.k, o order by c.t)),
lines as (select k, o, cut, sum((t - (cut - 1) / 2.0) * y) / sum((t - (cut - 1) / 2.0) ** 2) as slope, avg(y) as mean from p group by all),
per as (select p.*, slope, mean - slope * (cut - 1) / 2.0 as start from p join lines using (k, o, cut)),
scale as (select k, o, case when o = 0 then 0 when any_value(cut) > 12 then sum(abs(raw - r12)) / (any_value(cut) - 12) else sum(abs(raw - r1)) / (any_value(cut) - 1) end as scale from p group by k, o),
flat_q as (select k, o, cut, sum((raw - coalesce(y1, y)) ** 2) as q_naive, sum((raw - coalesce(y12, y)) ** 2) as q_seasonal, sum((raw - {line}) ** 2) as q_line,
  any_value(slope) as slope, any_value(start) as start, max_by(y, t) as last_y from per group by k, o, cut),
means as (select k, o, cut, slot, avg(y - {line}) as plus, avg(y / nullif({line}, 0)) as times, min(start) as start, min(start + slope * (cut - 1)) as finish from per where cut >= 24 group by all),
usual as (select k, o, slot, plus - avg(plus) over w as plus, case when start > 0 and finish > 0 then times / avg(times) over w end as times, count(*) over w as covered from means window w as (partition by k, o)),
by_slot as (select per.k, o, sum((raw - ({line} + plus)) ** 2) as q_plus, sum((raw - {line} * times) ** 2) as q_times from per join usual using (k, o, slot) where covered = 12 group by all),
{_grid('grid', ['simple_exponential_smoothing', 'holt', 'damped_holt'])}, {_grid('grid_w', ['holt_winters_additive', 'holt_winters_multiplicative'])},
sm as (select c.k, grid.m, grid.i, c.t, c.y as l, case when grid.m = {_AT['simple_exponential_smoothing']} then 0 else d.y - c.y end as b, 0.0::double as e, (c.raw - c.y) ** 2 as q
    from c join c d on c.k = d.k and c.t = 0 and d.t = 1, grid
  union all select sm.k, sm.m, sm.i, c.t, alpha * y + (1 - alpha) * (l + phi * b), beta * (alpha * y + (1 - alpha) * (l + phi * b) - l) + (1 - beta) * phi * b, e + (y - (l + phi * b)) ** 2, q + (raw - (l + phi * b)) ** 2
    from sm join c on c.k = sm.k and c.t = sm.t + 1 join grid on grid.i = sm.i and grid.m = sm.m),
years as (select c.k, pos, sum(y) filter (t < 12) / 12 as base, (sum(y) filter (t between 12 and 23) - sum(y) filter (t < 12)) / 12 / 12 as rise from c join hist using (k) where c.n >= 24 group by 1, 2),
{_winters('wa', False)},
{_winters('wm', True)},
best_sm as (select sm.k, o, cut, sm.m, grid.params, q, l, b, phi from sm join cuts on cuts.k = sm.k and sm.t = cut - 1 join grid on grid.m = sm.m and grid.i = sm.i where cut >= least
  qualify row_number() over (partition by sm.k, o, sm.m order by e, sm.i) = 1),
best_w as (select w.*, params from (select wa.*, {_AT['holt_winters_additive']} as m from wa union all select wm.*, {_AT['holt_winters_multiplicative']} from wm) w join grid_w using (m, i)),
best_hw as (select w.k, o, cut, m, params, q, l, b, z from best_w w join cuts on cuts.k = w.k and w.t = cut - 1 where cut >= 24 qualify row_number() over (partition by w.k, o, m order by e, i) = 1),
wins as (select k, o, cut, w, i, t, y, raw, (select avg(x.y) from c x where x.k = p.k and x.t < p.t and x.t >= p.t - w) as f from p, (values {', '.join(f'({i}, {w})' for i, w in enumerate(FC.WINDOWS))}) v(i, w) where w <= cut // 2),
sum_ma as (select k, o, cut, w, 'window=' || w as params, sum((raw - coalesce(f, y)) ** 2) as q, sum((y - f) ** 2) as e from wins where cut >= 4 group by all),
best_ma as (select * from sum_ma qualify row_number() over (partition by k, o order by e, w) = 1),
fits as (
  {fixed('naive', 'q_naive', 'last_y', 'flat_q join stp using (k, o, cut)')}
  union all {fixed('seasonal_naive', 'q_seasonal', 'c.y', 'flat_q join stp using (k, o, cut) join c using (k) where cut >= 13 and c.t = greatest(0, cut - 12 + (step - 1) % 12)')}
  union all {fixed('linear_regression', 'q_line', usual, 'flat_q join stp using (k, o, cut)')}
  union all {fixed('seasonal_additive', 'q_plus', usual + ' + plus', 'flat_q join stp using (k, o, cut) join by_slot using (k, o) join usual using (k, o, slot)')}
  union all {fixed('seasonal_multiplicative', 'q_times', usual + ' * times', 'flat_q join stp using (k, o, cut) join by_slot using (k, o) join usual using (k, o, slot) join hist using (k) where pos and times is not null')}
  union all select b.k, o, cut, {_AT['moving_average']}, params, q, step, (select avg(y) from c where c.k = b.k and t < cut and t >= cut - w) from best_ma b join stp using (k, o, cut)
  union all select k, o, cut, m, params, q, step, l + b * list_sum(list_transform(range(1, step + 1), lambda j: pow(phi, j))) from best_sm join stp using (k, o, cut)
  union all select k, o, cut, m, params, q, step, case when m = {_AT['holt_winters_additive']} then l + b * step + z[slot + 1] else (l + b * step) * z[slot + 1] end from best_hw join stp using (k, o, cut)),
full_fit as (select k, m, any_value(params) as params, any_value(q) as q, list(pred order by step) as pred from fits where o = 0 group by k, m),
errors as (select f.k, f.m, f.o, f.step, c.raw - f.pred as off, scale, c.raw from fits f join full_fit using (k, m) join scale on scale.k = f.k and scale.o = f.o join c on c.k = f.k and c.t = f.cut + f.step - 1 where f.o > 0),
scored as (select k, m, count(distinct o) as origins, case when bool_and(scale > 0) then {_UP_OF_MEAN.format('avg(abs(off) / scale)', 10000, 10000)} end as mase,
  case when bool_and(raw <> 0) then {_UP_OF_MEAN.format('avg(abs(off) / abs(raw)) * 100', 10000, 10000)} end as mape, {_UP_OF_MEAN.format('avg(abs(off))', 10000, 10000)} as mae from errors group by k, m),
listed(m, method, least, positive_only) as (values {names}),
judged as (select hist.k, n, lp, held, last_raw, listed.*, coalesce(origins, 0)::int as origins, mase, mape, mae, full_fit.m is not null as eligible, full_fit.params, q, pred,
  case when n < least then 'needs ' || least || ' periods of history, has ' || n when positive_only and not pos then 'needs every period above zero'
    when full_fit.m is null then 'could not be fitted to this history' when origins is null then 'needs ' || (held + least) || ' periods to hold any out, has ' || n end as reason
  from hist cross join listed left join full_fit on full_fit.k = hist.k and full_fit.m = listed.m left join scored on scored.k = hist.k and scored.m = listed.m),
ranked as (select *, case when bool_or(mase is not null) over (partition by k) then mase else mae end as score from judged),
near as (select *, coalesce(score <= min(score) over (partition by k) * {FC.TOLERANCE}, false) as near from ranked),
board as (select *, m = coalesce(min(m) filter (near) over (partition by k), min(m) filter (eligible) over (partition by k)) as winner from near),
spread as (select k, m, step, avg(off) as mu, stddev_pop(off) as dev, {rank(0.025)} as lo, {rank(0.975)} as hi from errors group by all),
raised as (select *, unnest(range(1, {horizon + 1})) as step, case when origins >= 8 then 'empirical' when origins >= 3 then 'normal' else 'residual' end as basis, sqrt(q / n) as sd from board where winner),
banded as (select r.*, greatest(0, case when isfinite(pred[r.step]) then pred[r.step] else last_raw end) as v, sd / sqrt(n * (n * n - 1) / 12.0) as fan, case when r.step > held then sqrt(r.step / held) else 1 end as stretch, mu, dev, lo, hi
  from raised r left join spread on spread.k = r.k and spread.m = r.m and spread.step = least(r.step, held)),
edges as (select *, case basis when 'residual' then -{FC.Z95} * sd * sqrt(1 + step / n) when 'empirical' then lo * stretch else (mu - {FC.Z95} * dev) * stretch end as low,
  case basis when 'residual' then {FC.Z95} * sd * sqrt(1 + step / n) when 'empirical' then hi * stretch else (mu + {FC.Z95} * dev) * stretch end as high from banded),
points as (
  select k, lp, step::int as step, method, basis, {', '.join(f"{_UP.format(e, 100, 100)} as {a}" for e, a in (('v', 'value'), ('greatest(0, least(v, v + low))', 'lower'), ('greatest(v, v + high)', 'upper'), ('v + fan * step', 'best'), ('greatest(0, v - fan * step)', 'worst')))} from edges
  union all select k, period, unnest(range(1, {horizon + 1}))::int, 'flat', 'residual', raw, raw * 0.8, raw * 1.2, raw, raw from c where n = 1),
dated as (select *, strftime(cast(lp || '-01' as date) + to_months(step), '%Y-%m') as period from points)"""
