"""Query parameters: the analysis period, the optional filters and settings."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Period:
    """Closed date range ``[start, end]``; the start may not lie after the end."""

    start: dt.date
    end: dt.date

    def __post_init__(self):
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        if self.start > self.end:
            raise ValueError(f"period start {self.start} is after its end {self.end}")

    @classmethod
    def last_days(cls, end, days: int = 7) -> "Period":
        end = _as_date(end)
        return cls(end - dt.timedelta(days=days - 1), end)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def previous(self) -> "Period":
        """The equally long period that ends the day before ``start``."""
        prev_end = self.start - dt.timedelta(days=1)
        return Period(prev_end - dt.timedelta(days=self.days - 1), prev_end)

    def covers(self, col) -> Column:
        """``DATE(col) BETWEEN start AND end``; Catalyst turns it into a range on the scan."""
        c = F.col(col) if isinstance(col, str) else col
        return F.to_date(c).between(F.lit(self.start), F.lit(self.end))

    def covers_date(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return c.between(F.lit(self.start), F.lit(self.end))


@dataclass(frozen=True)
class Filters:
    """Optional filters. ``author`` is an exact email match, ``section`` an exact
    section match and ``country`` a case-insensitive match on the author country."""

    author: str | None = None
    section: str | None = None
    country: str | None = None

    def __post_init__(self):
        for name in ("author", "section", "country"):
            if getattr(self, name) == "":
                object.__setattr__(self, name, None)

    def without_author(self) -> "Filters":
        return Filters(None, self.section, self.country)


# Fixed values the results depend on: action names of the event log.
CREATE = "CREATE"
SAVE = "SAVE"
FIRST_PUBLISH = "FIRST_PUBLISH"

# Traffic measures a daily series may sum (allow-list, never pasted into SQL).
DAILY_MEASURES = ("visits", "pageviews", "scrolls")


@dataclass(frozen=True)
class Settings:
    """Names and patterns that are data, not code."""

    agency_editor: str = "agency"
    agency_label: str = "Agency (wires)"
    agency_class: str = "Agencies"
    tool1_pattern: str = "editor-one"
    tool1_label: str = "Tool 1"
    tool2_pattern: str = "editor-two"
    tool2_label: str = "Tool 2"
    other_class: str = "Other"
    unknown_country: str = "Unknown"
    missing_text: str = "-"
    exclude_title_patterns: tuple[str, ...] = ()
    exclude_url_patterns: tuple[str, ...] = ("/homepage",)
    top_k: int = 10
    article_limit: int = 100
    dimension_limit: int = 100
    productivity_limit: int = 100
    min_notes: int = 3
    per_dimension_top: int = 15
