"""Bytes, HTML and table rows to scannable text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspan.functions.sqltext import let, quoted

# Python's cp1251 leaves exactly one byte undefined.
_UNDEFINED_BYTE = 0x98
_HIGH_BYTES = bytes(b for b in range(0x80, 0x100) if b != _UNDEFINED_BYTE)


def decode_text(content: str, newlines: bool = True) -> str:
    """Text of a binary expression: UTF-8, else cp1251, else Latin-1.

    cp1251 is not among the charsets Spark decodes, so its upper half is mapped
    from Latin-1.  Line ends become a single line feed unless ``newlines`` is
    off.
    """
    latin = f"decode({content}, 'ISO-8859-1')"
    cp1251 = (
        f"translate(l, '{_HIGH_BYTES.decode('latin1')}', '{_HIGH_BYTES.decode('cp1251')}')"
    )
    single_byte = let(
        "l", latin, f"case when contains(l, '{chr(_UNDEFINED_BYTE)}') then l else {cp1251} end"
    )
    utf8 = f"cast({content} as string)"
    text = f"case when is_valid_utf8({utf8}) then {utf8} else {single_byte} end"
    return f"regexp_replace({text}, '\\\\r\\\\n?', '\\n')" if newlines else text


def decode_utf8_lossy(content: str) -> str:
    """UTF-8 text without the byte sequences that do not decode."""
    utf8 = f"cast({content} as string)"
    return (
        f"case when is_valid_utf8({utf8}) then {utf8} "
        f"else replace(make_valid_utf8({utf8}), '�', '') end"
    )


# What stands between the name of a tag and its end.  A value in quotes may hold anything; a quote that
# does not follow an equals sign is a character like any other.
_INSIDE_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
# Runs of markup: comments, declarations, script and style with their content, tags.  A tag whose quotes never
# close ends at the next angle bracket.  Loops are possessive: nothing is tried twice, and long runs
# stay off the regex engine's call stack.
_MARKUP = (
    r"(?is)(?:<!--.*?-->"
    rf"|<script(?:[\s/]{_INSIDE_TAG})?>.*?(?:</script\s*+>|\z)"
    rf"|<style(?:[\s/]{_INSIDE_TAG})?>.*?(?:</style\s*+>|\z)"
    rf"|<[a-z][^\s/>]*+{_INSIDE_TAG}>"
    r"|<(?:[!?]?/?[a-z]|!(?!--)|\?|/(?=>))[^>]*+>)++"
)


def html_text(html: str) -> str:
    """Text nodes of an HTML expression, joined by line feeds.

    Every run of markup between two text nodes becomes one line feed; a run at
    either end joins nothing and leaves none.  Angle brackets inside quoted attributes end no tag.

    A comment that never ends and a tag that never ends stay text.  Their openings are hidden
    first, so that the pattern does not search the rest of the page from each of them.
    """
    inner = (
        f"case when startswith(t, '\\n') and not startswith({html}, '\\n') "
        "then substr(t, 2) else t end"
    )
    trimmed = let(
        "u",
        inner,
        f"case when endswith(u, '\\n') and not endswith({html}, '\\n') "
        "then left(u, char_length(u) - 1) else u end",
    )
    shown = f"translate(regexp_replace(m, {quoted(_MARKUP)}, '\\n'), '{_HIDDEN}', '<')"
    stripped = let("t", let("m", let("c", _hidden(html, "-->", "<!--", f"{_HIDDEN}!--"), _hidden("c", ">", "<", _HIDDEN)), shown), trimmed)
    return let("h", stripped, decode_entities("h"))


# A code point that no text holds: it is set aside for a program's own use.
_HIDDEN = "\ufdd0"


def _hidden(text: str, end: str, opening: str, instead: str) -> str:
    """The text with each ``opening`` after the last ``end`` replaced."""
    tail = f"substring_index({text}, '{end}', -1)"
    return let(
        "tail",
        tail,
        f"concat(left({text}, char_length({text}) - char_length(tail)), replace(tail, '{opening}', '{instead}'))",
    )


# --- fixed values: what HTML reads numbers of the Windows-1252 range as ----
_C1_NUMBERS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# Names that count without a semicolon; the longest is tried first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NAMED = {n.rstrip(";"): c for n, c in html5.items()}


def decode_entities(text: str) -> str:
    """Replace HTML 5 character references, named and numeric of any length.

    The text is cut at ampersands and each piece is looked up once, so an
    escaped ampersand cannot start a second reference.  As in browsers, numbers
    need no semicolon, nor do the names of HTML 4; numbers that stand for no
    character give U+FFFD or, for control characters, nothing.
    """
    names = sorted(_NAMED)
    codes = " ".join("-".join(f"{ord(c):x}" for c in _NAMED[n]) for n in names)
    lookup = f"map_from_arrays(split('{' '.join(names)}', ' '), split('{codes}', ' '))"
    c1 = " ".join(f"{ord(c):x}" for c in _C1_NUMBERS.values())
    # Digits without leading zeros; more than seven are beyond the last code point.
    value = (
        "case when digits = '' then 0 when char_length(digits) > 7 then 1114112 "
        "when hexadecimal then cast(conv(digits, 16, 10) as bigint) else cast(digits as bigint) end"
    )
    surrogate = "n = 0 or n > 1114111 or n between 55296 and 57343"
    control = (
        "n between 1 and 8 or n between 14 and 31 or n between 127 and 159 or n = 11 "
        "or n between 64976 and 65007 or n % 65536 >= 65534"
    )
    number = let(
        "n",
        value,
        f"case when {surrogate} then 'fffd' when n = 13 then 'd' "
        f"when n between 128 and 159 then element_at(split('{c1}', ' '), cast(n - 127 as int)) "
        f"when {control} then '' else lower(hex(n)) end",
    )
    digits = "regexp_extract(r, '^#[xX]?0*([0-9a-fA-F]*)', 1)"
    numeric = let("digits", digits, let("hexadecimal", "rlike(r, '^#[xX]')", number))
    code = f"case when startswith(r, '#') then {numeric} else try_element_at({lookup}, rtrim(';', r)) end"
    bytes_of = "transform(filter(split(c, '-'), x -> x <> ''), x -> decode(unhex(lpad(x, 8, '0')), 'UTF-32'))"
    char = f"case when c is null then null else array_join({bytes_of}, '') end"
    whole = f"regexp_extract(p, {quoted(_REFERENCE)}, 0)"
    known = f"startswith(w, '#') or try_element_at({lookup}, rtrim(';', w)) is not null"
    reference = let("w", whole, f"case when {known} then w else regexp_extract(p, '^(?:{'|'.join(_BARE)})', 0) end")
    piece = let(
        "r",
        f"case when i = 0 then '' else {reference} end",
        let(
            "e",
            let("c", f"case when r = '' then null else {code} end", char),
            "case when i = 0 then p when e is null then concat('&', p) "
            "else concat(e, substr(p, char_length(r) + 1)) end",
        ),
    )
    decoded = f"array_join(transform(split({text}, '&'), (p, i) -> {piece}), '')"
    return f"case when contains({text}, '&') then {decoded} else {text} end"


# A name that is not known with its semicolon may still begin with one that needs none.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"


def row_text(df: DataFrame, columns: list[str] | None = None) -> str:
    """One table row as text: cells in column order, blanks between, nulls skipped.

    Cells keep their written form; nothing is inferred as a number first.
    """
    chosen = columns or df.columns
    cells = []
    for field in (df.schema[c] for c in chosen):
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cells.append(f"to_json({name})")
        elif isinstance(field.dataType, T.BinaryType):
            cells.append(decode_text(name))
        else:
            cells.append(f"cast({name} as string)")
    return f"concat_ws(' ', {', '.join(cells)})"
