"""The bake-off of one series in numpy, to hold the distributed one against."""

from itertools import product

import numpy as np

SEASON = 12
WINDOWS = [2, 3, 4, 6, 12]
GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
DAMPING = [0.8, 0.85, 0.9, 0.95, 0.98]
TOLERANCE = 1.05
MAX_SCORED_HORIZON = 6
Z95 = 1.96

# Method, shortest history. Fewest fitted parameters first, which is the tie-break.
METHODS = [
    ("naive", 2), ("seasonal_naive", 13), ("moving_average", 4), ("simple_exponential_smoothing", 3),
    ("linear_regression", 2), ("holt", 4), ("damped_holt", 5), ("seasonal_additive", 24),
    ("seasonal_multiplicative", 24), ("holt_winters_additive", 24), ("holt_winters_multiplicative", 24),
]
POSITIVE_ONLY = {"seasonal_multiplicative", "holt_winters_multiplicative"}


def _line(y):
    x = np.arange(len(y)) - (len(y) - 1) / 2
    spread = (x * x).sum()
    slope = (x * (y - y.mean())).sum() / spread if spread else 0.0
    return y.mean() - slope * (len(y) - 1) / 2, slope


def _best(y, fitted, names, grid):
    """The grid row with the least one-step error; the first of equals."""
    with np.errstate(all="ignore"):
        sse = ((fitted[:, 1:] - y[1:]) ** 2).sum(axis=1)
    sse = np.where(np.isfinite(sse), sse, np.inf)
    if not len(sse) or not np.isfinite(sse.min()):
        return None, None
    i = int(sse.argmin())
    return i, dict(zip(names, grid[i]))


def _smooth(y, grid, names, damped):
    """Exponential smoothing of all grid rows at once; a row is (alpha[, beta[, phi]])."""
    a, b = grid[:, 0], grid[:, 1] if grid.shape[1] > 1 else np.zeros(len(grid))
    phi = grid[:, 2] if damped else np.ones(len(grid))
    trended = grid.shape[1] > 1
    level = np.full(len(grid), y[0])
    slope = np.full(len(grid), y[1] - y[0] if trended else 0.0)
    fitted = np.empty((len(grid), len(y)))
    fitted[:, 0] = y[0]
    for t in range(1, len(y)):
        expected = level + phi * slope
        fitted[:, t] = expected
        after = a * y[t] + (1 - a) * expected
        slope = b * (after - level) + (1 - b) * phi * slope if trended else slope
        level = after
    i, params = _best(y, fitted, names, grid)
    if i is None:
        return None
    reach = lambda h: np.cumsum(phi[i] ** np.arange(1, h.max() + 1))[h - 1]
    return fitted[i], (lambda h, slot: level[i] + slope[i] * reach(h)), params


def _winters(y, slots, multiplicative):
    """Holt-Winters over the whole grid at once, seasons kept by slot of the year."""
    if len(y) < 2 * SEASON or slots is None:
        return None
    grid = np.array(list(product(GRID, GRID, GRID)))
    a, b, g = grid.T
    base = y[:SEASON].mean()
    if multiplicative and base <= 0:
        return None
    level = np.full(len(grid), base)
    slope = np.full(len(grid), (y[SEASON:2 * SEASON].mean() - base) / SEASON)
    season = np.ones((len(grid), SEASON)) if multiplicative else np.zeros((len(grid), SEASON))
    for t in range(SEASON):
        season[:, slots[t]] = y[t] / base if multiplicative else y[t] - base
    fitted = np.empty((len(grid), len(y)))
    with np.errstate(all="ignore"):
        for t, m in enumerate(slots):
            along, usual = level + slope, season[:, m].copy()
            if multiplicative:
                fitted[:, t] = along * usual
                after = a * (y[t] / usual) + (1 - a) * along
                season[:, m] = g * (y[t] / after) + (1 - g) * usual
            else:
                fitted[:, t] = along + usual
                after = a * (y[t] - usual) + (1 - a) * along
                season[:, m] = g * (y[t] - after) + (1 - g) * usual
            slope = b * (after - level) + (1 - b) * slope
            level = after
    i, params = _best(y, fitted, ("alpha", "beta", "gamma"), grid)
    if i is None or not np.isfinite(level[i] + slope[i]):
        return None

    def ahead(h, slot):
        line = level[i] + slope[i] * h
        return line * season[i, slot] if multiplicative else line + season[i, slot]

    return fitted[i], ahead, params


def _by_slot(y, slots, multiplicative):
    if slots is None:
        return None
    start, slope = _line(y)
    line = start + slope * np.arange(len(y))
    if multiplicative and (line <= 0).any():
        return None
    against = y / line if multiplicative else y - line
    counts = np.bincount(slots, minlength=SEASON)
    if (counts == 0).any():
        return None
    usual = np.bincount(slots, weights=against, minlength=SEASON) / counts
    usual = usual / usual.mean() if multiplicative else usual - usual.mean()
    fitted = line * usual[slots] if multiplicative else line + usual[slots]

    def ahead(h, slot):
        on = start + slope * (len(y) - 1 + h)
        return on * usual[slot] if multiplicative else on + usual[slot]

    return fitted, ahead, None


def _fit(method, y, slots):
    """(one-step fit, function of steps ahead and slots, parameters), or None."""
    n = len(y)
    if method == "naive":
        return np.r_[y[0], y[:-1]], lambda h, slot: np.full(len(h), y[-1]), None
    if method == "seasonal_naive":
        fitted = np.where(np.arange(n) >= SEASON, np.r_[np.zeros(SEASON), y[:-SEASON]], y)
        return fitted, lambda h, slot: y[np.maximum(0, n - SEASON + (h - 1) % SEASON)], None
    if method == "moving_average":
        windows = [w for w in WINDOWS if w <= n // 2]
        if not windows:
            return None
        sums = np.r_[0.0, np.cumsum(y)]
        at = np.arange(1, n)
        fitted = np.array([np.r_[y[0], (sums[at] - sums[np.maximum(0, at - w)]) / np.minimum(w, at)] for w in windows])
        i, params = _best(y, fitted, ("window",), np.array(windows, dtype=float)[:, None])
        if i is None:
            return None
        return fitted[i], (lambda h, slot: np.full(len(h), y[-windows[i]:].mean())), params
    if method == "simple_exponential_smoothing":
        return _smooth(y, np.array(GRID)[:, None], ("alpha",), False)
    if method == "linear_regression":
        start, slope = _line(y)
        return start + slope * np.arange(n), lambda h, slot: start + slope * (n - 1 + h), None
    if method == "holt":
        return _smooth(y, np.array(list(product(GRID, GRID))), ("alpha", "beta"), False)
    if method == "damped_holt":
        return _smooth(y, np.array(list(product(GRID, GRID, DAMPING))), ("alpha", "beta", "phi"), True)
    if method.startswith("seasonal"):
        return _by_slot(y, slots, method.endswith("multiplicative"))
    return _winters(y, slots, method.endswith("multiplicative"))


def _half_up(x, places):
    f = 10.0**places
    return float(np.floor(x * f + 0.5) / f)


def _clamp_unusual(y):
    if len(y) < 4:
        return y
    middle = np.median(y)
    mad = np.median(np.abs(y - middle))
    scale = mad / 0.6745 if mad > 0 else y.std()
    if scale <= 0:
        return y
    low, high = _half_up(middle - 3.5 * scale, 2), _half_up(middle + 3.5 * scale, 2)
    return np.where(np.abs(y - middle) / scale >= 3.5, np.clip(y, low, high), y)


def _hold_out(method, least, raw, fit_on, slots, H, K):
    """Errors by step ahead over K rolling origins; fitted on clamped, scored on raw values."""
    steps, errors, scaled, shares, scale_ok = np.arange(1, H + 1), [], [], [], True
    for k in range(K):
        cut = len(raw) - H - k
        model = _fit(method, fit_on[:cut], None if slots is None else slots[:cut]) if cut >= least else None
        if model is None:
            continue
        lag = SEASON if cut > SEASON else 1
        scale = np.abs(raw[lag:cut] - raw[:cut - lag]).mean() if cut > lag else 0.0
        off = raw[cut:cut + H] - model[1](steps, None if slots is None else slots[cut:cut + H])
        errors.append(off)
        scale_ok = scale_ok and scale > 0
        scaled.append(np.abs(off) / scale if scale > 0 else np.zeros(H))
        actual = np.abs(raw[cut:cut + H])
        shares.append(np.where(actual > 0, np.abs(off) / np.where(actual > 0, actual, 1), np.nan))
    if not errors:
        return None
    e = np.array(errors)
    kept = np.isfinite(e)
    mape = None if np.isnan(np.array(shares)[kept]).any() else _half_up(np.array(shares)[kept].mean() * 100, 4)
    return e, (_half_up(np.array(scaled)[kept].mean(), 4) if scale_ok else None), mape, _half_up(np.abs(e[kept]).mean(), 4)


def _bake_off(raw, slots, horizon):
    """Scoreboard rows and forecast rows of one series."""
    n = len(raw)
    if n < 2:
        return [], [dict(step=h, value=raw[0], lower=raw[0] * 0.8, upper=raw[0] * 1.2, best=raw[0], worst=raw[0],
                         method="flat", basis="residual") for h in range(1, horizon + 1)]
    fit_on, positive = _clamp_unusual(raw), bool((raw > 0).all())
    can_run = [least for m, least in METHODS if n >= least and (m not in POSITIVE_ONLY or positive)]
    H = min(horizon, MAX_SCORED_HORIZON)
    while H > 1 and not any(n - H - least + 1 >= 1 for least in can_run):
        H -= 1
    origins = 1 if n < 12 else 3 if n < 24 else 5 if n < 48 else 8

    board, models, held = [], {}, {}
    for method, least in METHODS:
        row = dict(method=method, mase=None, mape=None, mae=None, origins=0, eligible=False, reason=None, winner=False, params=None)
        board.append(row)
        if n < least:
            row["reason"] = f"needs {least} periods of history, has {n}"
        elif method in POSITIVE_ONLY and not positive:
            row["reason"] = "needs every period above zero"
        else:
            model = _fit(method, fit_on, slots)
            if model is None:
                row["reason"] = "could not be fitted to this history"
                continue
            models[method], K = model, min(origins, n - H - least + 1)
            scored = _hold_out(method, least, raw, fit_on, slots, H, K) if K >= 1 else None
            row.update(eligible=True, params=None if not model[2] else ", ".join(f"{k}={v:g}" for k, v in model[2].items()))
            if scored is None:
                row["reason"] = f"needs {H + least} periods to hold any out, has {n}"
            else:
                held[method] = scored[0]
                row.update(mase=scored[1], mape=scored[2], mae=scored[3], origins=len(scored[0]))
    key = "mase" if any(r["mase"] is not None for r in board) else "mae"
    pool = [r for r in board if r[key] is not None]
    if pool:
        limit = min(r[key] for r in pool) * TOLERANCE
        winner = next(r for r in pool if r[key] <= limit)
    else:
        winner = next((r for r in board if r["eligible"]), None)
    winner["winner"] = True
    fitted, ahead, _ = models[winner["method"]]
    errors = held.get(winner["method"])
    count = 0 if errors is None else len(errors)
    basis = "empirical" if count >= 8 else "normal" if count >= 3 else "residual"
    sd = float(np.sqrt(((raw - fitted) ** 2).mean()))
    x = np.arange(n)
    slope_error = sd / np.sqrt(((x - x.mean()) ** 2).sum())
    steps = np.arange(1, horizon + 1)
    central = ahead(steps, None if slots is None else (slots[-1] + steps) % SEASON)
    points = []
    for h, projected in zip(steps, central):
        value = max(0.0, projected if np.isfinite(projected) else raw[-1])
        if basis == "residual":
            high = Z95 * sd * np.sqrt(1 + h / n)
            low = -high
        else:
            of_step = errors[:, min(h, H) - 1]
            stretch = np.sqrt(h / H) if h > H else 1.0
            if basis == "empirical":
                low, high = np.percentile(of_step, [2.5, 97.5]) * stretch
            else:
                low, high = ((of_step.mean() + s * Z95 * of_step.std()) * stretch for s in (-1, 1))
        fan = slope_error * h
        points.append(dict(step=int(h), value=_half_up(value, 2), lower=_half_up(max(0.0, min(value, value + low)), 2),
                           upper=_half_up(max(value, value + high), 2), best=_half_up(value + fan, 2),
                           worst=_half_up(max(0.0, value - fan), 2), method=winner["method"], basis=basis))
    return board, points
