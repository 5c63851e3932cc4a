"""Scalar text functions (JVM-side expressions only).

The content key must equal the one the reference stores, so the character
classes below reproduce Python's ``str.strip``, ``re \\w`` and ``re \\s``
exactly rather than Java's ASCII defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts, written as a
# regex character-class body that both Java regex and RE2 read the same way:
# tab, LF, VT, FF, CR, U+001C..U+001F, space, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
            r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# Word characters as Python's re module sees them: letters, numbers, underscore.
WORD_CLASS = r"\p{L}\p{N}_"

EDGE_WS = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
NON_WORD = f"[^{WORD_CLASS}{WS_CLASS}]"
RUN_WS = f"[{WS_CLASS}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace at both edges.

    Spark's ``trim`` only strips U+0020, so it is not used.
    """
    return F.regexp_replace(_c(c), EDGE_WS, "")


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), RUN_WS, " ")


def norm_text(c) -> Column:
    """lower -> strip -> delete non-word -> collapse whitespace; null -> ''."""
    s = F.lower(F.coalesce(_c(c).cast("string"), F.lit("")))
    s = py_strip(s)
    s = F.regexp_replace(s, NON_WORD, "")
    return collapse_ws(s)


def content_key(artist, title) -> Column:
    """Deterministic SHA-256 content key of (artist, title) as lowercase hex."""
    return F.sha2(F.concat(norm_text(artist), F.lit("::"), norm_text(title)), 256)


def nullif_empty(c) -> Column:
    c = _c(c)
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def truthy_str(c) -> Column:
    """Python truthiness of an optional string: non-null and non-empty."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def py_isoformat(ts) -> Column:
    """Python ``datetime.isoformat()`` of a naive timestamp: microseconds are
    written only when non-zero."""
    ts = _c(ts).cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
