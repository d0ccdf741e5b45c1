"""Strict ISO timestamp parsing and the text form of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchlake.functions.binding import let

# date [any one separator HH[:MM[:SS[.fff|.ffffff]]] [+-HH:MM[:SS[.ffffff]]]], nothing around it.
_ISO = (
    r"(?s)\A[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(.[0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.([0-9]{3}|[0-9]{6}))?)?)?"
    r"([+-][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{6})?)?)?)?\z"
)
# The usual form of it, which a cast alone reads as the whole way does.
_USUAL = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.([0-9]{3}|[0-9]{6}))?Z\z"
)
_MIDNIGHT = "00:00:00.000000"


def _number(text: Column, start: int) -> Column:
    """Two digits of a text; 0 where the text ends before."""
    return F.coalesce(F.nullif(F.substring(text, start, 2), F.lit("")).try_cast("int"), F.lit(0))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to an instant; NULL when the text is not in the strict grammar.

    try_to_timestamp alone would also take `2025`, `10:00`, unpadded parts and outer blanks.
    Text without an offset is UTC. The offset is subtracted as an interval because zone
    offsets beyond 18 hours are legal here. The parts have fixed widths, so after the one
    match they are cut out by position.
    """

    def instant(iso: Column) -> Column:
        behind = F.substring(iso, F.lit(12), F.length(iso))
        clock = F.substring_index(F.substring_index(behind, "+", 1), "-", 1)
        return let(clock, lambda c: shifted(iso, c))

    def shifted(iso: Column, clock: Column) -> Column:
        # What the clock time leaves out is filled from midnight.
        rest = F.substring(F.lit(_MIDNIGHT), F.length(clock) + 1, F.lit(len(_MIDNIGHT)))
        local = F.concat(F.substring(iso, 1, 10), F.lit("T"), clock, rest, F.lit("Z"))
        offset = F.substring(iso, F.length(clock) + 12, F.length(iso))
        return let(
            offset,
            lambda o: F.when(
                (o == "") | (o == "+00:00"), local.try_cast("timestamp")
            ).otherwise(local.try_cast("timestamp") - _interval(o)),
        )

    any_form = let(
        F.replace(text, F.lit("Z"), F.lit("+00:00")),
        lambda iso: F.when(iso.rlike(_ISO) & ~iso.startswith("0000"), instant(iso)),
    )
    usual = text.rlike(_USUAL) & ~text.startswith("0000")
    return F.when(usual, text.try_cast("timestamp")).otherwise(any_form)


def _interval(offset: Column) -> Column:
    """`+HH:MM[:SS[.ffffff]]` as an interval; NULL for a day or more."""
    fraction = F.coalesce(F.substring(offset, 10, 7).try_cast("decimal(18,6)"), F.lit(0))
    seconds = _number(offset, 2) * 3600 + _number(offset, 5) * 60 + _number(offset, 8)
    seconds = seconds + fraction
    return let(
        seconds,
        lambda s: F.when(
            s < 86400,
            F.make_dt_interval(
                F.lit(0),
                F.lit(0),
                F.lit(0),
                F.when(offset.startswith("-"), -s).otherwise(s).cast("decimal(18,6)"),
            ),
        ),
    )


def timestamp_text(ts: Column) -> Column:
    """`2025-12-27 10:26:59.596000+00:00`; the fraction is left out when it is zero."""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(
            F.date_format(ts, ".SSSSSS")
        ),
        F.lit("+00:00"),
    )


def result_timestamp_text(ts: Column) -> Column:
    """Timestamp as a query result prints it: milliseconds, no zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
