"""The small driver-side values every operator is described with.

Nothing here holds data: a schema map names columns, filters hold a handful of
values, a calendar holds three settings.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Business meaning -> column name.
SchemaMap = dict[str, str]

# Filter slot -> business meaning (fixed values; the two names differ for two slots).
FILTER_SLOTS = {
    "region": "region",
    "state": "state",
    "city": "city",
    "category": "category",
    "department": "department",
    "product": "product_name",
    "customer": "customer_name",
}


def as_values(value) -> list[str]:
    """One filter entry as its non-blank values."""
    if value is None:
        return []
    raw = list(value) if isinstance(value, (list, tuple, set)) else [value]
    return [str(v).strip() for v in raw if v is not None and str(v).strip() != ""]


@dataclass(frozen=True)
class Filters:
    """Dimension values (OR inside a slot, AND across slots) and an inclusive date window."""

    date_from: str | None = None
    date_to: str | None = None
    slots: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)

    def without_dates(self) -> "Filters":
        return replace(self, date_from=None, date_to=None)

    def with_slot(self, slot: str, values) -> "Filters":
        slots = {k: v for k, v in self.slots.items() if k != slot}
        if values is not None:
            slots[slot] = values
        return replace(self, slots=slots)


@dataclass(frozen=True)
class Calendar:
    """A business calendar. `week_start_day` counts from 0 = Sunday."""

    fiscal_year_start_month: int = 1
    scheme: str = "calendar"
    week_start_day: int = 1

    def __post_init__(self):
        # An unusable stored setting falls back to the default instead of failing a query.
        if self.fiscal_year_start_month not in range(1, 13):
            object.__setattr__(self, "fiscal_year_start_month", 1)
        if self.scheme not in ("calendar", "445", "454", "544"):
            object.__setattr__(self, "scheme", "calendar")
        if self.week_start_day not in range(0, 7):
            object.__setattr__(self, "week_start_day", 1)

    @property
    def is_retail(self) -> bool:
        return self.scheme != "calendar"

    @property
    def weeks(self) -> list[int]:
        """Weeks in each of the 12 periods of a retail year."""
        return [int(c) for c in self.scheme] * 4

    def describe(self) -> str:
        months = ("January February March April May June July August September "
                  "October November December").split()
        days = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
        opens = months[self.fiscal_year_start_month - 1]
        if not self.is_retail:
            return f"Gregorian calendar months; fiscal year starts in {opens}."
        pattern = "-".join(self.scheme)
        return (f"Retail {pattern} periods. The fiscal year opens on the first "
                f"{days[self.week_start_day]} on or after 1 {opens}; week 53 belongs to period 12.")


DEFAULT_CALENDAR = Calendar()
