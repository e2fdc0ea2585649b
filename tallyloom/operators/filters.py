"""Row filters, drill-down and table search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tallyloom.context import FILTER_SLOTS, Calendar, DEFAULT_CALENDAR, Filters, SchemaMap, as_values
from tallyloom.functions import calendar as C
from tallyloom.functions.dates import day_of
from tallyloom.functions.numbers import all_of, any_of, number_or_zero, plain_number
from tallyloom.functions.strings import trimmed
from tallyloom.operators.formats import quoted


def one_of(column: str, values) -> Column:
    """Trimmed, case-insensitive equality with any of the values."""
    wanted = [v.lower() for v in as_values(values)]
    return F.lower(trimmed(F.col(quoted(column)))).isin(wanted) if wanted else F.lit(True)


def date_condition(schema: SchemaMap, filters: Filters) -> Column:
    """The inclusive date window; a row whose date cannot be read is kept."""
    if not schema.get("date") or not (filters.date_from or filters.date_to):
        return F.lit(True)
    day = day_of(F.col(quoted(schema["date"])))
    inside = F.lit(True)
    if filters.date_from:
        inside = inside & (day >= F.lit(filters.date_from).cast("date"))
    if filters.date_to:
        inside = inside & (day <= F.lit(filters.date_to).cast("date"))
    return day.isNull() | inside


def slot_condition(schema: SchemaMap, slot: str, values) -> Column:
    """A filter on a slot the table has no column for lets nothing through."""
    if not as_values(values):
        return F.lit(True)
    column = schema.get(FILTER_SLOTS[slot])
    return one_of(column, values) if column else F.lit(False)


def filter_condition(schema: SchemaMap, filters: Filters) -> Column:
    slots = [slot_condition(schema, slot, values) for slot, values in filters.slots.items()]
    columns = [one_of(column, values) for column, values in filters.columns.items()]
    return all_of([date_condition(schema, filters), *slots, *columns])


def apply_filters(df: DataFrame, schema: SchemaMap, filters: Filters) -> DataFrame:
    return df.where(filter_condition(schema, filters))


def row_condition(df: DataFrame, column: str | None, operator: str, value) -> Column:
    """One metric's row filter: numbers compare as numbers, text only for eq and ne.

    A column the table does not have lets nothing through.
    """
    if column not in df.columns:
        return F.lit(False)
    cell = F.col(quoted(column))
    text = str(value).strip()
    try:
        number = F.lit(float(text))
    except ValueError:
        number = None

    def compare(left, right):
        return {"eq": left == right, "ne": left != right, "gt": left > right,
                "gte": left >= right, "lt": left < right, "lte": left <= right}[operator]

    if number is not None and isinstance(df.schema[column].dataType, NumericType):
        # A missing cell is the empty text, which differs from every number.
        return F.coalesce(compare(cell.cast("double"), number), F.lit(operator == "ne"))
    raw = trimmed(cell)
    as_text = compare(F.lower(raw), F.lit(text.lower())) if operator in ("eq", "ne") else F.lit(False)
    if number is None:
        return as_text
    return F.when(plain_number(raw).isNotNull(), compare(number_or_zero(cell), number)).otherwise(as_text)


# The order in which each filter's effect is counted (fixed values).
CASCADE = ["date", "region", "state", "city", "category", "department", "product", "customer"]


def cascade_exclusions(df: DataFrame, schema: SchemaMap, filters: Filters) -> DataFrame:
    """How many rows each filter drops after the ones before it, in one pass."""
    steps = []
    if filters.date_from or filters.date_to:
        steps.append(("date", date_condition(schema, filters)))
    steps += [(s, slot_condition(schema, s, filters.slots[s])) for s in CASCADE if s in filters.slots]
    if not steps:
        return df.sparkSession.createDataFrame([], "reason string, excluded bigint")
    counts, kept = [], F.lit(True)
    for name, passes in steps:
        counts.append(F.count_if(kept & ~passes).alias(f"filter:{name}"))
        kept = kept & passes
    one = df.agg(*counts)
    return one.unpivot([], [F.col(quoted(c)) for c in one.columns], "reason", "excluded").where("excluded > 0")


# --- hierarchies --------------------------------------------------------------------------


@dataclass(frozen=True)
class Hierarchy:
    """Filter slots from coarse to fine."""

    name: str
    levels: tuple[str, ...]

    def available(self, schema: SchemaMap) -> "Hierarchy | None":
        kept = tuple(s for s in self.levels if schema.get(FILTER_SLOTS[s]))
        return Hierarchy(self.name, kept) if len(kept) >= 2 else None

    def depth(self, filters: Filters) -> int:
        """How many levels down the deepest set one is; 0 when none is set."""
        set_at = [i for i, s in enumerate(self.levels, 1) if as_values(filters.slots.get(s))]
        return max(set_at, default=0)

    def next_level(self, filters: Filters) -> str | None:
        depth = self.depth(filters)
        return self.levels[depth] if depth < len(self.levels) else None

    def drill_to(self, filters: Filters, level: str, value) -> Filters:
        """Set one level and clear the ones below it."""
        return self.drill_up(filters, level).with_slot(level, [value])

    def drill_up(self, filters: Filters, level: str | None) -> Filters:
        """Keep `level` and what is above it; None goes back to the top."""
        start = 0 if level is None else self.levels.index(level) + 1
        for below in self.levels[start:]:
            filters = filters.with_slot(below, None)
        return filters


GEOGRAPHY = Hierarchy("geography", ("region", "state", "city"))
PRODUCT = Hierarchy("product", ("category", "product"))


def date_drill(df: DataFrame, schema: SchemaMap, key: str, cal: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """The rows of one bucket, with the key of the grain one step finer as `bucket`."""
    day = day_of(F.col(quoted(schema["date"])))
    first, last = C.period_bounds(F.lit(key), cal)
    grain = "quarter" if len(key.removeprefix("FY")) == 4 else "period"
    return df.where((day >= first) & (day <= last)).withColumn("bucket", C.grain_key(day, cal, grain))


def date_path(keys: DataFrame, key: str, cal: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """For every key its trail from all dates down to the key itself, coarse to fine."""
    leaves = C.with_period_range(keys.select(F.col(quoted(key)).alias("leaf")), "leaf", cal)
    # Coarser keys are shorter, so the trail stops at the leaf's own length. An unknown key
    # has no range, no steps and so no trail.
    steps = leaves.select("leaf", F.posexplode(F.array(
        F.when(F.col("period_from").isNotNull(), "all"), *[C.grain_key(F.col("period_from"), cal, g) for g in C.GRAINS])).alias("depth", "step"))
    trail = C.with_period_range(steps.where(F.length("step") <= F.length("leaf")), "step", cal)
    return trail.select(
        "leaf", "depth", F.when(F.col("depth") > 0, F.col("step")).alias("key"),
        F.when(F.col("depth") == 0, "All dates").otherwise(C.period_label(F.col("step"), cal)).alias("label"),
        F.col("period_from").cast("string").alias("date_from"), F.col("period_to").cast("string").alias("date_to"))


# --- tables -------------------------------------------------------------------------------


def text_search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any column contains the text, whatever its case."""
    wanted = text.strip().lower()
    hits = [F.lower(F.col(quoted(c)).cast("string")).contains(wanted) for c in columns or df.columns]
    return df.where(any_of([F.coalesce(h, F.lit(False)) for h in hits])) if wanted else df


def sort_rows(df: DataFrame, column: str, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Sorted by one column with missing values last."""
    key = F.col(quoted(column))
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(first, *[F.col(quoted(t)) for t in ties or []])


def range_filter(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    number = F.col(quoted(column))
    bounds = ([number >= low] if low is not None else []) + ([number <= high] if high is not None else [])
    return df.where(all_of(bounds))
