"""Pieces of DuckDB SQL the oracle texts share."""

from __future__ import annotations


def r2(e: str) -> str:
    """Amounts are decimals of six places; two of them stay, halves up."""
    return f"(floor(cast(cast({e} as decimal(38,6)) as double)*100+0.5)/100)"


def half_up(e: str, places: int) -> str:
    f = 10**places
    return f"(floor(({e})*{f}.0+0.5)/{f}.0)"


def pct(cur: str, prev: str) -> str:
    return f"(case when ({prev}) <> 0 then floor((({cur})-({prev}))/abs({prev})*1000+0.5)/10 end)"


SPACES = "[\\s\u00a0\u202f\u2009]"
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(e: str) -> str:
    return f"(case when regexp_matches({e}, '{PLAIN}') then try_cast({e} as double) end)"


def parse_number(e: str, decimal: str = ".") -> str:
    t = f"regexp_replace(regexp_replace({e}, '{SPACES}', '', 'g'), '[$€£₹¥₽₩﷼]', '', 'g')"
    shape = r"^([-+(]*)([0-9.,]+)%?([-)]*)$"
    b, d, a = (f"regexp_extract({t}, '{shape}', {i})" for i in (1, 2, 3))
    if decimal == ".":
        bad, plain = r"\.[0-9]*,[0-9,]*$", f"replace({d}, ',', '')"
    else:
        bad, plain = r",[0-9]*\.[0-9.]*$", f"replace(replace({d}, '.', ''), ',', '.')"
    opened = f"(length({b}) - length(replace({b}, '(', '')))"
    closed = f"(length({a}) - length(replace({a}, ')', '')))"
    minus = f"(length({b}) - length(replace({b}, '-', '')) + length({a}) - length(replace({a}, '-', '')))"
    return (f"(case when {opened} = {closed} and not regexp_matches({d}, '{bad}') then "
            f"(case when ({opened} + {minus}) % 2 = 1 then -1.0 else 1.0 end) * {to_double(plain)} + 0.0 end)")


def plain_number(e: str) -> str:
    return to_double(f"trim(regexp_replace({e}, '[$€£₹,()]', '', 'g'))")


def tidy(e: str) -> str:
    return f"nullif(trim(cast({e} as varchar)), '')"


def group_label(e: str) -> str:
    return f"coalesce({tidy(e)}, 'Unknown')"
