"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from listforge import schemas as S

WS = S.PY_WHITESPACE_CLASS


def decode_entities(expr: str) -> str:
    # '&amp;' last so that '&amp;quot;' decodes once, like an HTML parser
    return (f"replace(replace(replace(replace({expr}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;', '&')")


def clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def tags_to_space(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"


def drop_element(expr: str, tag: str) -> str:
    return f"regexp_replace({expr}, '(?s)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"


def domain(expr: str) -> str:
    return f"regexp_extract({expr}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
