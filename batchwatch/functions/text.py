"""Number and status formatting for explanations and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Display tone, icon and label of every status.
BADGES = {
    "NONE": ("good", "✓", "No drift"),
    "MODERATE": ("warning", "▲", "Moderate"),
    "HIGH": ("critical", "✕", "High"),
    "INSUFFICIENT_DATA": ("muted", "–", "Not enough data"),
    "HEALTHY": ("good", "✓", "Healthy"),
    "WARNING": ("warning", "▲", "Warning"),
    "CRITICAL": ("critical", "✕", "Critical"),
    "INFO": ("muted", "i", "Info"),
    "ADVISED": ("warning", "▲", "Advised"),
    "URGENT": ("critical", "✕", "Urgent"),
    "NEW": ("critical", "●", "New"),
    "ACKNOWLEDGED": ("warning", "◐", "Acknowledged"),
    "RESOLVED": ("good", "✓", "Resolved"),
}
# Fixed texts: part of the results.
STATUS_PHRASES = {"HIGH": "High drift", "MODERATE": "Moderate drift", "NONE": "No drift",
                  "INSUFFICIENT_DATA": "Not enough data"}


def fixed(value: Column, places: int) -> Column:
    """Plain decimal with a fixed number of places, half-even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def signed(value: Column, places: int = 1) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value, places))


def number(value: Column, places: int = 2) -> Column:
    """Thousands-separated; n/a when unknown."""
    return F.coalesce(F.format_number(value, places), F.lit("n/a"))


def percent(value: Column, places: int = 1, unknown: str = "n/a") -> Column:
    return F.coalesce(F.concat(fixed(value, places), F.lit("%")), F.lit(unknown))


def ratio_percent(value: Column, places: int = 1) -> Column:
    """A 0-1 ratio shown in percent."""
    return percent(value * 100.0, places, "—")


def p_value(p: Column) -> Column:
    return (F.when(p.isNull(), "n/a").when(p < 0.001, "p < 0.001")
            .otherwise(F.concat(F.lit("p = "), fixed(p, 3))))


def bare_p_value(p: Column) -> Column:
    return F.when(p.isNull(), "—").when(p < 0.001, "< 0.001").otherwise(fixed(p, 3))


def test_label(test: Column) -> Column:
    return (F.when(test == S.KS, "K-S").when(test == S.CHI2, "Chi²")
            .otherwise(F.coalesce(test, F.lit("—"))))


def plain_number(c: Column) -> Column:
    """The value as text, whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def words(key: Column) -> Column:
    """snake_case to words, first letter upper, the rest lower."""
    spaced = F.lower(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.concat(F.upper(F.substring(spaced, 1, 1)), F.expr("''"),
                               F.substr(spaced, F.lit(2))), F.lit(""))


def badge(status: Column) -> Column:
    """(tone, icon, label) of a status; unknown ones are muted with their own name."""
    out = F.struct(F.lit("muted").alias("tone"), F.lit("–").alias("icon"),
                   F.initcap(status).alias("label"))
    for name, (tone, icon, label) in BADGES.items():
        out = F.when(status == name, F.struct(
            F.lit(tone).alias("tone"), F.lit(icon).alias("icon"), F.lit(label).alias("label"))
        ).otherwise(out)
    return out


def status_phrase(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, phrase in STATUS_PHRASES.items():
        out = F.when(status == name, phrase).otherwise(out)
    return out


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM HH:mm")


def bin_labels(edges: Column) -> Column:
    """``lo–hi`` per bin, one decimal, thousands-separated."""
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.concat(
        F.format_number(F.element_at(edges, i), 1), F.lit("–"),
        F.format_number(F.element_at(edges, i + 1), 1)))
