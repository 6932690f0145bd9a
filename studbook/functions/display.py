"""Text shown to readers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null

# The four status labels, in display order.
STATUS_LABELS = {
    "neutered": "Neutered",
    "approved_for_breeding": "Stud Animal",
    "frozen_semen": "Frozen Semen",
    "artificial_insemination": "AI Available",
}


def status_tags(flags: dict[str, Column]) -> Column:
    labels = [F.when(flags[name], F.lit(label)) for name, label in STATUS_LABELS.items() if name in flags]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def title_text(long_name: Column, short_name: Column, is_prefix: Column, has_year: Column, year: Column) -> Column:
    null_text = F.lit("null")
    shown_year = F.when(has_year & (year != 0), F.concat(F.lit(" ("), year.cast("string"), F.lit(")")))
    kind = F.when(is_prefix, " [Prefix]").otherwise(" [Suffix]")
    return F.concat(
        F.coalesce(long_name, null_text), F.lit(" — "), F.coalesce(short_name, null_text),
        F.coalesce(shown_year, F.lit("")), kind,
    )


def color_text(color: Column, marking: Column) -> Column:
    base, extra = blank_to_null(color), blank_to_null(marking)
    return F.coalesce(F.concat(base, F.lit(" ("), extra, F.lit(")")), base, F.lit("—"))


def health_value(result: Column, notes: Column | None = None) -> Column:
    """General tests show the result; genetic tests prefer the notes."""
    shown = [blank_to_null(notes)] if notes is not None else []
    return F.coalesce(*shown, blank_to_null(result), F.lit("N/A"))
