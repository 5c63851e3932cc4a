"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs and their spelled forms, plus signs, schemes and identifier cues.  Small
deterministic parsers expand each anchor to its borders and validate it; digit chains (addresses, cards) are cut from
maximal runs.  Every parser is linear in the text, whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rankflow.llm.arrowtext import plus

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url")

# What announces an identifier, in the languages of the corpus.
CUES = ["iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "passport",
        "passeport", "pasaporte", "reisepass", "password", "passwort", "api_key", "api key", "apikey", "secret", "token"]
SCHEMES = ["http://", "https://", "ftp://", "mailto:", "tel:"]
SPELLED_AT = ["[at]", "(at)", "{at}"]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE_VALUE = re.compile(r"(?:[ \t]*+[:=#][ \t]*+|[ \t]++(?:no\.?|nr\.?|number|is)?[ \t]*+)[\"']?+([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*+)")
_QUOTED = re.compile(r"[ \t]*+[:=][ \t]*+([\"'])([^\s\"']{6,})\1")
_USERINFO = re.compile(r"[^\s/?#@<>\"']++@[^\s/?#@<>\"']+")
_TEL = re.compile(r"\+?[0-9](?:[ ().-]?[0-9])+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, texts in (("at", ["@"]), ("spelled", SPELLED_AT), ("plus", ["+"]), ("scheme", SCHEMES), ("cue", CUES)):
        for x in texts:
            out.add_word(x, (kind, len(x)))
    out.make_automaton()
    return out


_UPPER = {c: c + 32 for c in range(65, 91)}


def _emails(text: str, ats: list[int]) -> Iterator[Span]:
    """Leftmost non-overlapping addresses around at-signs: the local part reaches back to the first character that
    can't belong to it, or to the address before."""
    done = 0
    for at in ats:
        if at < done or not (m := _DOMAIN.match(text, at + 1)):
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield "email", start, done


def _ips(text: str) -> Iterator[Span]:
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i: i + 4]):
                yield "ip", starts[i], starts[i + 4] - 1


def _cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str, pluses: list[int]) -> Iterator[Span]:
    done = 0
    for at in pluses:
        if at >= done and (m := _PHONE.match(text, at)):
            done = m.end()
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", at, done


def _account(text: str, end: int) -> Span | None:
    """An identifier after a cue: a valid IBAN, a quoted secret, or six digits and more."""
    if end < len(text) and text[end].isalnum():
        return None  # the cue is part of a longer word
    if m := _QUOTED.match(text, end):
        return "account", m.start(2), m.end(2)
    if not (m := _CUE_VALUE.match(text, end)):
        return None
    value, start = m.group(1), m.start(1)
    # the longest beginning, cut at a gap, that is an IBAN; else the first word if it has six digits
    gaps = [i for i, c in enumerate(value[:48]) if c in " -"] + ([len(value)] if len(value) <= 48 else [])
    for cut in reversed(gaps):
        if iban_valid(value[:cut].replace(" ", "").replace("-", "")):
            return "account", start, start + cut
    word = re.match(r"[0-9](?:[ -]?[0-9])*+|[A-Za-z0-9]++", value).group()
    if sum(c.isdigit() for c in word) >= 6:
        return "account", start, start + len(word)
    return None


def _added(text: str, anchors: list[tuple[str, int, int]]) -> Iterator[Span]:
    for kind, start, end in anchors:
        if kind == "cue":
            if (start == 0 or not text[start - 1].isalnum()) and (span := _account(text, end)):
                yield span
        elif kind == "scheme" and text[start:end].lower() == "tel:":
            if (m := _TEL.match(text, end)) and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()
        elif kind == "scheme" and text[start:end].lower() != "mailto:":
            if m := _USERINFO.match(text, end):
                yield "url", start, m.end()
        elif kind == "spelled":
            left, right = start, end
            if left and text[left - 1] == " ":
                left -= 1
            if right < len(text) and text[right] == " ":
                right += 1
            first = left
            while first and text[first - 1] in LOCAL:
                first -= 1
            if first < left and (m := _DOMAIN.match(text, right)):
                yield "email", first, m.end()


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one whole text, by kind as in ``KINDS`` and then by start; ends are exclusive and
    positions count code points.  An added span that overlaps an earlier one of its kind is left out."""
    if not text:
        return [], []
    low = text if text.islower() else text.lower()
    if len(low) != len(text):
        low = text.translate(_UPPER)
    anchors = [(kind, end + 1 - size, end + 1) for end, (kind, size) in _anchors().iter(low)]
    base = [*_emails(text, [s for k, s, _ in anchors if k == "at"]), *_ips(text), *_cards(text),
            *_phones(text, [s for k, s, _ in anchors if k == "plus"])]
    added = sorted(set(_added(text, anchors)) - set(base), key=lambda s: (s[1], -s[2])) if len(anchors) else []
    found = {k: [s for s in base if s[0] == k] for k in KINDS}
    starts = {k: [s[1] for s in own] for k, own in found.items()}
    done = dict.fromkeys(KINDS, 0)
    for kind, start, end in added:
        i, own = bisect_left(starts[kind], start), found[kind]
        n = len(starts[kind])
        if start >= done[kind] and (i == 0 or own[i - 1][2] <= start) and (i == n or own[i][1] >= end):
            own.append((kind, start, end))
            done[kind] = end
    return base, [s for k in KINDS for s in sorted(found[k], key=lambda s: s[1])]


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType())])
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def pii_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", out: str = "spans") -> DataFrame:
    """``docs`` plus two arrays of (kind, start, end): the base spans of each whole text and all spans.

    Row by row, no shuffle.  A null or empty text has none; other columns pass as they are (ones named like the two
    are replaced)."""
    docs, _ = plus(docs, base, ArrayType(SPAN))
    docs, _ = plus(docs, out, ArrayType(SPAN))
    schema = StructType([*docs.schema.fields, StructField(base, ArrayType(SPAN)), StructField(out, ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(x.as_py()) for x in batch.column(text)]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found],
                             pa.list_(_ARROW)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, base, out])

    return docs.mapInArrow(run, schema)


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets (overlapping spans by the kind of
    the first).  A null text stays null; other columns pass as they are."""

    def masked(value: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end in sorted(find_spans(value)[1], key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [value[at:start], f"<{kind}>"]
            at = max(at, end)
        return value if not out else "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([masked(x.as_py()) for x in col], pa.string()) if name == text else col
                    for name, col in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
