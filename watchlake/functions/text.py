"""String expressions: field extraction, trimming, keys, fingerprints, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.functions.binding import let

# Unicode white space plus the four ASCII separators U+001C..U+001F.
_SPACE = r"[\s\x{1C}-\x{1F}]"


def unicode_trim(text: Column) -> Column:
    """Strip Unicode white space on both sides (SQL trim strips blanks only)."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(unicode_trim(text) == "", F.lit(True))


def video_title(title: Column) -> Column:
    """Title without the watched suffix; a title without the suffix is left as it is.

    (?d) makes only LF a line break, so CR or U+2028 may occur inside a title.
    """
    pattern = rf"(?dU)(.+?){_SPACE}*{fixed.WATCHED_SUFFIX}"

    def shortened(text: Column) -> Column:
        return let(
            F.regexp_extract(text, pattern, 1),
            lambda found: F.when(found == "", text).otherwise(unicode_trim(found)),
        )

    # The plain search first: the pattern backtracks on long titles without the suffix.
    return F.when(title.isNull(), "").otherwise(
        let(
            title,
            lambda text: F.when(text.contains(fixed.WATCHED_SUFFIX), shortened(text)).otherwise(
                text
            ),
        )
    )


def video_id(url: Column) -> Column:
    """The 11-character video id; the query-string form wins over the short form."""
    # NULL and "" have neither form; the first test finds what the pattern finds
    short = F.regexp_extract(url, fixed.VIDEO_ID_SHORT, 1)
    long = F.when(url.rlike(fixed.VIDEO_ID_LONG), F.regexp_extract(url, fixed.VIDEO_ID_LONG, 1))
    return F.coalesce(long, short, F.lit(""))


def channel_id(url: Column) -> Column:
    """The id of a /channel/ URL; handles and custom URLs give an empty string."""
    return F.coalesce(F.regexp_extract(url, fixed.CHANNEL_ID, 1), F.lit(""))


def embedding_text(title: Column, channel_name: Column) -> Column:
    """Text to embed for one view; a NULL part reads None."""
    return F.concat(
        F.coalesce(title, F.lit("None")), F.lit(" - "), F.coalesce(channel_name, F.lit("None"))
    )


def truncate_text(text: Column, max_chars: int = fixed.MAX_TEXT_CHARS) -> Column:
    """First `max_chars` characters (code points)."""
    return F.substring(text, 1, max_chars)


def query_fingerprint(query: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as hex."""
    return F.sha2(query, 256)


def raw_key(user_id: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), user_id, file_name)


def processed_key(user_id: Column) -> Column:
    return F.concat_ws("/", F.lit("processed"), user_id, F.lit("data.parquet"))


def vectors_key(user_id: Column) -> Column:
    return F.concat_ws("/", F.lit("vectors"), user_id, F.lit("embeddings.json"))


def fill_template(template: str, **values: Column) -> Column:
    """Concatenate a text template whose {name} slots are columns."""
    parts = re.split(r"\{(\w+)\}", template)
    columns = [
        F.lit(part) if position % 2 == 0 else values[part].cast("string")
        for position, part in enumerate(parts)
        if position % 2 or part
    ]
    return F.concat(*columns)
