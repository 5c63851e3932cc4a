"""SQL text fragments for the DuckDB oracles (RE2 regex syntax)."""

from rankflow.functions.text import WS_CLASS

WS = WS_CLASS


def norm(x: str) -> str:
    s = f"lower(coalesce(CAST({x} AS VARCHAR), ''))"
    s = f"regexp_replace({s}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"
    return f"regexp_replace({s}, '[{WS}]+', ' ', 'g')"


def key(artist: str, title: str) -> str:
    return f"sha256({norm(artist)} || '::' || {norm(title)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def html_text(x: str) -> str:
    from rankflow.sources.pages import ENTITIES
    s = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in ENTITIES:
        s = f"replace({s}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return s
