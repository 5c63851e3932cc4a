"""Row extraction from raw pages (O13-O21), as a distributed job over a table
of pages.  Markup is read by expressions inside the JVM: a row ends at its own
balanced close, and an element of the title fallback where its own end tag, or
that of an element around it, stands.  Each page is processed independently (no
shuffle until O21 groups rows back into one snapshot per page).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.text import py_strip

# Named character references decoded in link and element text.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

# Words the title fallback ignores.
FALLBACK_STOP_WORDS = ["track", "title", "artist", "label", "genre", "bpm", "key"]

# href in double quotes, single quotes or none; the text may span lines and hold tags
LINK_RE = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
# Elements without content, and those whose content is no text.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
NO_TEXT_RE = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
#: a tag (slash, name, closing slash), or text; quoted attributes may hold any character
TAG_RE = r"""<(/?)([a-zA-Z][^\s/>]*)(?>"[^"]*"|'[^']*'|[^'">])*+>|<[!?][^>]*>|[^<]+|<"""
BLOCKS = ["span", "div", "p"]

@dataclass(frozen=True)
class ExtractRules:
    #: a pattern whose first group is a row, or None: rows are div elements that start with ``row_open``
    row_pattern: str | None = None
    row_open: str = r"""(?i)<div\b[^>]*data-testid\s*=\s*["']?tracks-table-row\b[^>]*>"""
    title_href: str = "/track/"
    id_pattern: str = r"/track/[^/]+/(\d+)"
    host: str = "https://www.beatport.com"
    artist_href: str = "/artist/"
    label_href: str = "/label/"
    genre_href: str = "/genre/"
    number_pattern: str = r"(?i)(\d{2,3})\s*BPM"
    number_min: int = 80
    number_max: int = 200
    key_pattern: str = r"(?i)([A-G](?:#|b)?\s+(?:Major|Minor))"
    title_min_len: int = 3
    fallback_min_len: int = 5


def _numeric_references(t: Column) -> Column:
    """``&#233;`` and ``&#xE9;`` as their character; anything else stays."""
    def one(part: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(part, r"^[xX]([0-9a-fA-F]{1,6});?", 1), F.lit("")), 16, 10),
                          F.nullif(F.regexp_extract(part, r"^([0-9]{1,7});?", 1), F.lit(""))).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, r"^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", "")
        return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.concat(char, rest)) \
                .otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(t, "&#")
    found = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return F.when(t.contains("&#"), found).otherwise(t)


def html_text(c: Column) -> Column:
    """Text of a markup fragment: tags removed, references decoded."""
    t = _numeric_references(F.regexp_replace(c, r"<[^>]*>", ""))
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def _until_close(fragment: Column) -> Column:
    """What follows an opening ``div`` tag, up to its own balanced close (or the end of the fragment)."""
    pieces = F.split(F.concat(F.lit(" "), fragment), r"(?i)(?=</?div\b)")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("cut"))

    def step(acc, piece):
        depth = acc["depth"] + F.when(piece.rlike(r"(?i)^</div"), -1).when(piece.rlike(r"(?i)^<div"), 1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["i"] + 1).alias("i"),
                        F.when((acc["cut"] == 0) & (depth < 0), acc["i"]).otherwise(acc["cut"]).alias("cut"))

    # the first piece lies before any div tag, so a cut is at least one piece
    cut = F.aggregate(pieces, start, step)["cut"]
    return F.substr(F.array_join(F.slice(pieces, F.lit(1), F.when(cut > 0, cut).otherwise(F.size(pieces))), ""), F.lit(2))


def split_rows(pages: DataFrame, html_col: str, row_pattern: str | None = None,
               row_open: str = ExtractRules.row_open) -> DataFrame:
    """Row fragments with a 1-based position; ``row_count`` 0 marks a
    page without rows (an error result in the reference).  With a
    ``row_pattern`` its first group is a row; else a row is what an element
    that opens with ``row_open`` holds, wherever it stands."""
    if row_pattern:
        rows = F.regexp_extract_all(F.col(html_col), F.lit(row_pattern), 1)
    else:
        parts = F.split(F.coalesce(F.col(html_col), F.lit("")), row_open)
        rows = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _until_close)
    keep = [c for c in pages.columns if c != html_col]
    return pages.select(*keep, F.size(rows).alias("row_count"),
                        F.posexplode_outer(rows).alias("position", "row_html")) \
                .withColumn("position", F.col("position") + 1)


def _links(row: Column) -> Column:
    double, single, bare, texts = (F.regexp_extract_all(row, F.lit(LINK_RE), i) for i in (1, 2, 3, 4))
    return F.transform(F.arrays_zip(double.alias("d"), single.alias("s"), bare.alias("b"), texts.alias("t")),
                       lambda z: F.struct(html_text(F.concat(z["d"], z["s"], z["b"])).alias("href"),
                                          py_strip(html_text(z["t"])).alias("text")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def block_texts(row: Column) -> Column:
    """Text, children included, of each span, div and p in document order.

    One fold over the tags with the stack of open elements: an end tag closes the nearest open element of its name
    and all in it, an end tag without one does nothing, and the end of the fragment closes the rest.  An element is a
    stretch of the fragment's text, so the fold carries numbers, no pieces of markup."""
    blocks, void = F.array(*map(F.lit, BLOCKS)), F.array(*map(F.lit, VOID_ELEMENTS))

    def tokens(clean):
        whole, slash, name = (F.regexp_extract_all(clean, F.lit(TAG_RE), i) for i in range(3))
        # what: text, start tag, end tag or neither
        return F.transform(F.arrays_zip(whole.alias("w"), slash.alias("s"), name.alias("n")), lambda z: F.struct(
            F.when((z["n"] == "") & ~z["w"].rlike("^<[!?]"), "text").when(z["s"] == "/", "end")
             .when((z["n"] == "") | z["w"].endswith("/>") | F.array_contains(void, F.lower(z["n"])), "").otherwise("start").alias("what"),
            F.lower(z["n"]).alias("n"), F.length(z["w"]).alias("size"), z["w"].alias("w")))

    closed = "array<struct<i:int,at:int,end:int>>"
    start = F.struct(F.array().cast("array<struct<n:string,i:int,at:int>>").alias("stack"), F.lit(0).alias("i"),
                     F.lit(0).alias("at"), F.array().cast(closed).alias("done"))

    def ended(elements, at):
        return F.transform(F.filter(elements, lambda e: F.array_contains(blocks, e["n"])),
                           lambda e: F.struct(e["i"].alias("i"), e["at"].alias("at"), at.alias("end")))

    def step(acc, t):
        stack, at = acc["stack"], acc["at"]
        # the stack has its top first
        nearest = F.when(t["what"] == "end", F.array_position(F.transform(stack, lambda e: e["n"]), t["n"]).cast("int")).otherwise(F.lit(0))
        return _let(nearest, lambda k: F.struct(
            F.when(k > 0, F.slice(stack, k + 1, F.size(stack)))
             .when(t["what"] == "start", F.concat(F.array(F.struct(t["n"].alias("n"), acc["i"].alias("i"), at.alias("at"))), stack))
             .otherwise(stack).alias("stack"),
            (acc["i"] + 1).alias("i"), (at + F.when(t["what"] == "text", t["size"]).otherwise(F.lit(0))).alias("at"),
            F.when(k > 0, F.concat(acc["done"], ended(F.slice(stack, F.lit(1), k), at))).otherwise(acc["done"]).alias("done")))

    def texts(found):
        spoken = F.array_join(F.transform(F.filter(found, lambda t: t["what"] == "text"), lambda t: t["w"]), "")
        elements = F.array_sort(F.aggregate(found, start, step, lambda acc: F.concat(acc["done"], ended(acc["stack"], acc["at"]))))
        return _let(F.struct(spoken.alias("spoken"), elements.alias("elements")), lambda x: F.transform(
            x["elements"], lambda e: py_strip(html_text(F.substr(x["spoken"], e["at"] + 1, e["end"] - e["at"])))))

    return _let(F.regexp_replace(row, NO_TEXT_RE, ""), lambda clean: _let(tokens(clean), texts))


def extract_fields(rows: DataFrame, rules: ExtractRules, row_col: str = "row_html") -> DataFrame:
    """O14-O19 on each row fragment."""
    row = F.col(row_col)
    links = _links(row)
    title_link = F.get(F.filter(links, lambda l: l["href"].contains(rules.title_href)
                                & (F.length(l["text"]) > rules.title_min_len)), 0)
    href = title_link["href"]
    bid = F.nullif(F.regexp_extract(href, rules.id_pattern, 1), F.lit(""))
    url = F.when(bid.isNotNull(), F.when(href.startswith("/"), F.concat(F.lit(rules.host), href)).otherwise(href))
    # O15 fallback: text of span/div/p elements in document order
    stop = F.array(*[F.lit(w) for w in FALLBACK_STOP_WORDS])
    fallback = F.get(F.filter(block_texts(row), lambda t: (F.length(t) > rules.fallback_min_len)
                              & ~F.array_contains(stop, F.lower(t))
                              & ~t.rlike(r"^\p{Nd}+$") & ~t.rlike(r"^\d+[A-G]?$")), 0)
    artists = F.filter(links, lambda l: l["href"].contains(rules.artist_href) & (F.length(l["text"]) > 1))
    artist = F.nullif(F.array_join(F.transform(artists, lambda l: l["text"]), ", "), F.lit(""))

    def first_text(sub: str) -> Column:
        first = F.get(F.filter(links, lambda l: l["href"].contains(sub)), 0)
        return F.nullif(first["text"], F.lit(""))

    text = html_text(row)
    num = F.nullif(F.regexp_extract(text, rules.number_pattern, 1), F.lit("")).cast("int")
    return rows.select(
        "*",
        F.coalesce(title_link["text"], fallback).alias("title"),
        F.when(title_link.isNotNull(), bid).alias("beatport_id"),
        F.when(title_link.isNotNull(), url).alias("url"),
        artist.alias("artist"),
        first_text(rules.label_href).alias("label"),
        first_text(rules.genre_href).alias("genre"),
        F.when(num.between(rules.number_min, rules.number_max), num).alias("bpm"),
        F.nullif(F.regexp_extract(text, rules.key_pattern, 1), F.lit("")).alias("key"),
    )


def extract_rows(pages_df: DataFrame, html_col: str, rules: ExtractRules | None = None) -> DataFrame:
    """O13-O19 in one call: one row per row fragment with its fields; a page
    without rows keeps one row with ``row_count`` 0 (the error result)."""
    rules = rules or ExtractRules()
    rows = split_rows(pages_df, html_col, rules.row_pattern, rules.row_open)
    with_rows = extract_fields(rows.where(F.col("row_count") > 0), rules)
    empty = rows.where(F.col("row_count") == 0)
    for c in with_rows.columns:
        if c not in empty.columns:
            empty = empty.withColumn(c, F.lit(None).cast(with_rows.schema[c].dataType))
    return with_rows.unionByName(empty.select(*with_rows.columns))


def number_with_unit(c, pattern: str = r"(?i)(\d{2,3})\s*BPM", lo: int = 80, hi: int = 200) -> Column:
    """First match only; out of range -> NULL (no second try)."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    return F.when(n.between(lo, hi), n)


def pattern_extract(c, pattern: str = r"(?i)([A-G](?:#|b)?\s+(?:Major|Minor))") -> Column:
    """First group of the first match, NULL when none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with title and artist; positions keep their gaps."""
    return rows.where(F.col("title").isNotNull() & (F.col("title") != "")
                      & F.col("artist").isNotNull() & (F.col("artist") != ""))


def assemble_snapshot(rows: DataFrame, group_col: str, as_of, prefix: str = "beatport-top100-",
                      fields: list[str] | None = None) -> DataFrame:
    """One snapshot document per page: tracks ordered by position,
    ``track_count`` and a dated id.  A page's rows are bounded by its size."""
    fields = fields or ["title", "artist", "label", "genre", "bpm", "key", "beatport_id", "url", "track_id"]
    ts = F.lit(as_of).cast("timestamp")
    tracks = F.array_sort(F.collect_list(F.struct(F.col("position"), *[F.col(f) for f in fields])))
    return (rows.groupBy(group_col)
                .agg(tracks.alias("tracks"), F.count(F.lit(1)).alias("track_count"))
                .withColumn("playlist_id", F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd-HHmmss")))
                .withColumn("created_at", ts))
