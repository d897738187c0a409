"""DuckDB statements that restate each registered query.

DuckDB's regex engine has no look-around and an ASCII word boundary, so the
patterns here are written in another way than the Spark ones.  Every run of
word characters is put between doubled private-use marks: an edge of a word is
then a character to match, doubled so that one match can end and the next start
at the same edge.  ``~`` in a pattern stands for "any marks".  Marks are taken
out of gaps and values before lengths are counted.
"""

from __future__ import annotations

from veilspan.plans.corpus import OVERLAY, OVERLAY_PERIOD

# --- fixed values, written out once more so that a slip in the engine's tables shows ---
CATEGORIES = (
    "fio", "phone", "email", "passport", "snils", "inn", "driver_license", "bank_card",
    "bank_account", "bik", "birth_date", "address", "biometric", "health", "special",
)
CONFIGURED_CATEGORIES = tuple(c for c in CATEGORIES if c != "bik")
SPECIAL = ("biometric", "health", "special")
PAYMENT = ("bank_card", "bank_account", "bik")
SENSITIVE = ("passport", "snils", "inn", "driver_license", "bank_card", "bank_account", "bik")
REGULAR = ("fio", "phone", "email", "address", "birth_date")
LEVEL_1, LEVEL_2, LEVEL_3, LEVEL_4, NO_LEVEL = "УЗ-1", "УЗ-2", "УЗ-3", "УЗ-4", "Нет ПДн"
RECOMMENDATIONS = (
    ("УЗ-1", "Highest protection: encrypt, restrict access strictly, audit every operation."),
    ("УЗ-2", "Strong protection: encrypt, control access, audit regularly."),
    ("УЗ-3", "Standard protection: control access and apply baseline safeguards."),
    ("УЗ-4", "Basic protection: limit access and apply baseline safeguards."),
    ("Нет ПДн", "No personal data was found."),
)
FAMILIES = (
    ("pdf", (".pdf",)),
    ("docx", (".docx", ".doc")),
    ("text", (".txt", ".md")),
    ("csv", (".csv",)),
    ("json", (".json",)),
    ("parquet", (".parquet",)),
    ("html", (".html", ".htm")),
    ("image", (".tif", ".tiff", ".jpg", ".jpeg", ".png", ".gif")),
    ("video", (".mp4", ".avi", ".mov")),
)
EXTRACTED = ("text", "csv", "json", "parquet", "html")
SUFFIX_GROUPS = (
    ("documents", (".pdf", ".doc", ".docx", ".rtf", ".xls", ".xlsx")),
    ("structured", (".csv", ".json", ".parquet")),
    ("images", (".tif", ".tiff", ".jpg", ".jpeg", ".png", ".gif")),
    ("web", (".html", ".htm")),
    ("video", (".mp4", ".avi", ".mov")),
)
DETAILED_HEADERS = [
    "путь",
    "имя_файла",
    "размер",
    "время_изменения",
    "категории_ПДн",
    "количество_находок",
    "УЗ",
    "формат_файла",
]
# Suffixes that the fixture gives to documents in turn, every which of them is blank, its two scans.
ROTATED_SUFFIXES = (".txt", ".MD", ".csv", ".json", ".parquet", ".html", ".pdf", ".docx", ".png", ".mp4", ".xlsx", "")
BLANK_PERIOD = 37
IDENTIFIER_SCAN = ("phone", "passport", "snils", "inn", "driver_license", "bank_card", "bank_account", "bik")
PERSONAL_SCAN = ("fio", "email", "birth_date", "address", "biometric", "health", "special")
# White space as Unicode has it, separators of files and records included.
SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

_OPEN, _CLOSE = r"\x{E000}", r"\x{E001}"
_TOKENS = {
    "~": f"[{_OPEN}{_CLOSE}]*",  # marks that may stand between two characters
    "<": f"{_OPEN}{{1,2}}",  # left edge of a word
    ">": _CLOSE,  # right edge of a word
    "!": f"[{_OPEN}{_CLOSE}]{{1,2}}",  # any edge, at the start of a match
    "&": f"[{_OPEN}{_CLOSE}]",  # any edge, at the end of a match
    "S": f"[{SPACE}]",
    "-": f"[{SPACE}\\-]?",
    "D": r"\p{Nd}",
    "W": r"[\p{L}\p{N}_]",
}


def _pattern(*parts: str) -> str:
    """Join parts; a part in the token table is replaced, others are literal."""
    return "".join(_TOKENS.get(p, p) for p in parts)


def _digits(n: int) -> str:
    return f"{_TOKENS['D']}{{{n}}}"


def _keyword(*stems: str) -> str:
    joined = "|".join(s.replace(" ", _pattern("~", "S", "+", "~")) for s in stems)
    return _pattern("<", f"(?i:{joined})", "W", "*", ">")


_NAME = "[А-ЯЁ][а-яё]+"
_PATTERNS = {
    "fio": _pattern(
        "<", _NAME, "~", "S", "+", "~", _NAME, "(?:", "~", "S", "+", "~", _NAME, ")?", ">"
    ),
    "phone": _pattern(
        "~", r"(?:\+", "~", "7|8|7)?", "~", "-", "~", r"\(?", "~", "[489]", _digits(2), "~",
        r"\)?", "~", "-", "~", _digits(3), "~", "-", "~", _digits(2), "~", "-", "~", _digits(2),
        ">",
    ),
    "email": _pattern(
        "!", r"(?:[A-Za-z0-9._%+\-]", "~", ")+@", "~", r"(?:[A-Za-z0-9.\-]", "~", r")+\.", "~",
        "[A-Z|a-z]", "~", "(?:[A-Z|a-z]", "~", ")*[A-Z|a-z]", "&",
    ),
    "passport": _pattern(
        "!", "(?i:паспорт|серия)?", "~", f"(?:[{SPACE}:]", "~", ")*", _digits(2), "~", "-", "~",
        _digits(2), "~", f"(?:[{SPACE}\\-№]", "~", ")+", _digits(6), ">",
    ),
    "snils": _pattern(
        "<", _digits(3), "~", "-", "~", _digits(3), "~", "-", "~", _digits(3), "~", "-", "~",
        _digits(2), ">",
    ),
    "inn": _pattern(
        "<", "(?:(?i:инн)", "~", f"(?:[{SPACE}:№]", "~", f")*)?(?:{_digits(10)}|{_digits(12)})", ">"
    ),
    "driver_license": _pattern(
        "<", _digits(2), "~", "S", "?", "~", _digits(2), "~", "S", "?", "~", _digits(6), ">"
    ),
    "bank_card": _pattern("<", f"(?:{_digits(4)}", "~", "-", "~", "){3}", _digits(4), ">"),
    "bank_account": _pattern("<", _digits(20), ">"),
    "bik": _pattern("<", "(?:(?i:бик)", "~", f"(?:[{SPACE}:№]", "~", f")*)?04{_digits(7)}", ">"),
    "birth_date": _pattern(
        "<", "(?:0?[1-9]|[12][0-9]|3[01])", "~", "[./-]", "~", "(?:0?[1-9]|1[012])", "~",
        "[./-]", "~", f"(?:19|20){_digits(2)}", ">",
    ),
    "address": _pattern(
        "~", "(?i:г", "~", r"\.|город|ул", "~", r"\.|улица|пр", "~", r"\.|проспект|д", "~",
        r"\.|дом)", "~", f"(?:[{SPACE}.]", "~", ")+(?i:[А-ЯЁа-яё0-9", SPACE, r"\-,.]", "~", ")+",
    ),
    "biometric": _keyword(
        "отпечат(?:ок|ки) пальц", "радужн(?:ая|ой) оболочк", "голосов(?:ой|ые) образ", "биометр",
        "сканирование лиц", "распознавание лиц",
    ),
    "health": _keyword(
        "диагноз", "заболевание", "болезнь", "лечение", "медицинск", "анализ", "обследование",
        "терапия", "операция", "инвалидность", "группа здоровья",
    ),
    "special": _keyword(
        "религ", "вероисповедание", "национальность", "раса",
        "политическ(?:ие|ая) (?:взгляд|убеждени)", "профсоюз", "интимн",
    ),
}

_MARKED = (
    r"regexp_replace(text, '([\p{L}\p{N}_]+)', "
    r"concat(chr(57344), chr(57344), '\1', chr(57345), chr(57345)), 'g')"
)


def _bare(value: str) -> str:
    return f"replace(replace({value}, chr(57344), ''), chr(57345), '')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(_text(v) for v in values)})"


# --- corpora --------------------------------------------------------------
def _overlaid(text: str = "text") -> str:
    arms = " ".join(f"when {k} then chr(10) || {_text(v)}" for k, v in enumerate(OVERLAY))
    return f"{text} || case doc_id % {OVERLAY_PERIOD} {arms} else '' end"


_MARKUP = (
    r"(?is)(?:<!--.*?-->|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)|<[!?]?/?[a-z][^>]*>)+"
)


def _html() -> str:
    """Visible text of pages as a subquery with page_id, html, text."""
    text = "text"
    for name, char in [
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"),
        ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'"),
    ]:
        text = f"replace({text}, '{name}', {char})"
    return (
        f"(select page_id, html, {text} as text from (select page_id, html, "
        "case when t like '%' || chr(10) and not html like '%' || chr(10) "
        "then left(t, length(t) - 1) "
        "else t end as text from (select page_id, html, "
        "case when t like chr(10) || '%' and not html like chr(10) || '%' "
        "then substr(t, 2) else t end as t "
        f"from (select page_id, html, regexp_replace(html, '{_MARKUP}', chr(10), 'g') as t "
        "from pages))))"
    )


def _mtime(key: str) -> str:
    return f"timestamp '2024-01-01 00:00:00' + to_minutes({key})"


def _documents() -> str:
    return (
        "select doc_id, 'documents/' || source || '/' || doc_id || '.txt' as path, "
        f"doc_id || '.txt' as name, '.txt' as format, {_mtime('doc_id')} as mtime, "
        f"{_overlaid()} as text from documents"
    )


def _corpus() -> str:
    """Rows to scan: rk (row key), path, text; and files: path, name, ..."""
    return f"""
docs as ({_documents()}),
rows_ as (
  select path as rk, path, text from docs
  union all select 'pages/' || page_id || '.html', 'pages/' || page_id || '.html', text
    from {_html()}
  union all select 'conversations/' || conv_id || '/' || turn,
    'conversations/' || conv_id || '.md', text from conversations),
files as (
  select path, name, format, strlen(text) as size, mtime from docs
  union all select 'pages/' || page_id || '.html', page_id || '.html', '.html',
    strlen(html), {_mtime('page_id')} from pages
  union all select 'conversations/' || conv_id || '.md', conv_id || '.md', '.md',
    cast(sum(strlen(text)) as bigint), {_mtime('conv_id')} from conversations group by conv_id)"""


# --- findings ---------------------------------------------------------------
def _luhn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    total = (
        f"list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 "
        f"then cast(substr({d}, i, 1) as int) "
        f"when cast(substr({d}, i, 1) as int) > 4 then cast(substr({d}, i, 1) as int) * 2 - 9 "
        f"else cast(substr({d}, i, 1) as int) * 2 end))"
    )
    return f"(case when length({d}) = 16 then {total} % 10 = 0 else false end)"


def _weighted(d: str, weights: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({weights}) + 1), "
        f"lambda i: cast(substr({d}, i, 1) as int) * {weights}[i]))"
    )


def _snils(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    s = _weighted(d, "[9,8,7,6,5,4,3,2,1]")
    return (
        f"(case when length({d}) = 11 then cast(substr({d}, 10, 2) as int) = "
        f"case when {s} < 100 then {s} when {s} in (100, 101) then 0 else {s} % 101 end "
        "else false end)"
    )


def _inn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"

    def control(weights: str, at: int) -> str:
        return f"{_weighted(d, weights)} % 11 % 10 = cast(substr({d}, {at}, 1) as int)"

    return (
        f"(case when length({d}) = 10 then {control('[2,4,10,3,5,9,4,6,8]', 10)} "
        f"when length({d}) = 12 then {control('[7,2,4,10,3,5,9,4,6,8]', 11)} "
        f"and {control('[3,7,2,4,10,3,5,9,4,6,8]', 12)} else false end)"
    )


def _value_ok() -> str:
    return (
        f"case category when 'bank_card' then {_luhn('value')} "
        f"when 'snils' then {_snils('value')} when 'inn' then {_inn('value')} else true end"
    )


def _first3_last3(value: str) -> str:
    return (
        f"case when length({value}) > 6 then left({value}, 3) || "
        f"repeat('*', length({value}) - 6) || right({value}, 3) "
        f"else repeat('*', length({value})) end"
    )


def _mask() -> str:
    words = f"list_filter(string_split_regex(value, '[{SPACE}]+'), lambda w: w <> '')"
    identifiers = _in("category", ["phone", "bank_card", "snils", "inn", "passport"])
    return (
        f"case when category = 'fio' then {words}[1] || ' ' || left({words}[2], 1) || '.' "
        f"when {identifiers} then {_first3_last3('value')} "
        "when category = 'email' then left(split_part(value, '@', 1), 2) || '***@' "
        "|| split_part(value, '@', 2) "
        "when length(value) > 10 then left(value, 10) || '...' else value end"
    )


def _candidates(source: str, key: str, carry: str, categories) -> str:
    """CTEs ending in ``candidates``: key columns, ordinal, category, value, position."""
    parts = []
    for category in categories:
        ordinal, pattern = CATEGORIES.index(category), _text(_PATTERNS[category])
        parts.append(
            f"select {key}, {carry}, {ordinal} as ordinal, '{category}' as category, "
            f"regexp_extract_all(m, {pattern}) as vs, string_split_regex(m, {pattern}) as gs "
            f"from marked where regexp_matches(m, {pattern})"
        )
    return f"""
marked as (select {key}, {carry}, {_MARKED} as m from {source}),
lists as ({' union all '.join(parts)}),
items as (
  select {key}, {carry}, ordinal, category, unnest(range(1, len(vs) + 1)) as i, vs, gs from lists),
bare as (
  select {key}, {carry}, ordinal, category, i, {_bare('vs[i]')} as value,
    length({_bare('gs[i]')}) as gap from items),
candidates as (
  select {carry}, ordinal, category, value, cast(
    sum(gap) over (partition by {key}, ordinal order by i)
    + sum(length(value)) over (partition by {key}, ordinal order by i)
    - length(value) as int) as position from bare)"""


def _found(categories=CATEGORIES) -> str:
    """``found`` over the whole corpus: path, ordinal, category, value, position."""
    return (
        f"{_corpus()}, {_candidates('rows_', 'rk', 'path', categories)}, "
        f"found as (select * from candidates where {_value_ok()})"
    )


def _doc_candidates(categories=CATEGORIES) -> str:
    return (
        f"with docs as ({_documents()}), "
        f"{_candidates('docs', 'path', 'doc_id', categories)}"
    )


# --- profiles ------------------------------------------------------------------
def _level() -> str:
    return (
        f"case when special > 0 then '{LEVEL_1}' "
        f"when payment > 0 or sensitive >= 100 then '{LEVEL_2}' "
        f"when sensitive >= 10 or regular >= 100 then '{LEVEL_3}' "
        f"when regular > 0 then '{LEVEL_4}' else '{NO_LEVEL}' end"
    )


def _profile(categories=CATEGORIES, name: str = "profile", prefix: str = "") -> str:
    """CTEs from found to ``profile``."""
    def group(values) -> str:
        return f"coalesce(sum(n) filter (where {_in('category', values)}), 0)"

    return f"""
{prefix}counted as (
  select path, ordinal, category, count(*) as n from found
  where {_in('category', categories)} group by all),
{prefix}summed as (
  select path, string_agg(category, ', ' order by ordinal) as categories,
    string_agg(category || ':' || n, ', ' order by ordinal) as counts,
    cast({group(SPECIAL)} as bigint) as special, cast({group(PAYMENT)} as bigint) as payment,
    cast({group(SENSITIVE)} as bigint) as sensitive, cast({group(REGULAR)} as bigint) as regular
  from {prefix}counted group by path),
{name} as (
  select f.path, f.name, f.size, f.mtime, f.format, s.categories, s.counts, s.sensitive,
    s.regular, {_level()} as protection_level from {prefix}summed s join files f using (path))"""


_MODIFIED = "strftime(mtime, '%Y-%m-%d %H:%M:%S')"
_PROFILE_COLUMNS = (
    f"path, name, size, {_MODIFIED} as modified, categories, counts, protection_level, format"
)
_DETAILED = ", ".join(
    f'{v} as "{h}"'
    for v, h in zip(
        ["path", "name", "size", _MODIFIED, "categories", "counts", "protection_level", "format"],
        DETAILED_HEADERS,
    )
)


def _over_profile(select: str) -> str:
    return f"with {_found()}, {_profile()} {select}"


def _share(column: str, alias: str) -> str:
    return (
        f'select {column} as "{alias}", count(*) as files, '
        "round(count(*) * 100.0::double / sum(count(*)) over (), 1) as percent "
        "from profile group by 1"
    )


def _reports() -> str:
    """Two reports: ``first_`` of the identifier scan, ``second_`` of the other."""
    return (
        f"with {_found()}, {_profile(IDENTIFIER_SCAN, 'first_', 'a_')}, "
        f"{_profile(PERSONAL_SCAN, 'second_', 'b_')}"
    )


def _identifiers() -> str:
    return (
        "(select c_custkey, c_name, "
        "lpad(cast(4000000000000000 + c_custkey * 7919 as varchar), 16, '0') as card, "
        "lpad(cast(c_custkey * 10000019 % 100000000000 as varchar), 11, '0') as snils, "
        "lpad(cast(7700000000 + c_custkey * 104729 as varchar), 10, '0') as inn10, "
        "lpad(cast(500000000000 + c_custkey * 15485863 as varchar), 12, '0') as inn12 "
        "from customer)"
    )


def _rotated() -> str:
    suffixes = "[" + ", ".join(_text(s) for s in ROTATED_SUFFIXES) + "]"
    arms = " ".join(
        f"when regexp_matches(lower(path), '({'|'.join(e[1:] for e in ends)})$') "
        f"and contains(path, '.') then '{name}'"
        for name, ends in FAMILIES
    )
    return (
        f"(select doc_id, path, text, case {arms} end as family from (select doc_id, "
        f"'documents/' || doc_id || {suffixes}[doc_id % {len(ROTATED_SUFFIXES)} + 1] as path, "
        f"case when doc_id % {BLANK_PERIOD} = 0 then ' ' || chr(10) || chr(160) || chr(8195) else {_overlaid()} end as text "
        "from documents))"
    )


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
_CELLS = "concat_ws(' ', cast(c_custkey as varchar), c_name, card, snils, inn10, inn12)"


def _sources() -> dict[str, str]:
    latin = r"regexp_replace(text, '[^\x00-\x7F\x{A1}-\x{FF}]', '?', 'g')"
    high = bytes(range(0xA1, 0x100))
    cp1251 = f"translate({latin}, '{high.decode('latin1')}', '{high.decode('cp1251')}')"
    decoded = (
        "case doc_id % 3 when 0 then text "
        f"when 1 then 'Привет, мир!' || chr(10) || {cp1251} "
        f"else chr(152) || 'Ïð' || chr(10) || {latin} end"
    )
    digest = "cast(length(text) as bigint) as n_chars, md5(text) as digest"
    extracted = _in("family", EXTRACTED)
    return {
        "file_metadata": f"with {_corpus()} select path, name, format, size, "
        f"{_MODIFIED} as modified from files",
        "format_router": f"select doc_id, path, family from {_rotated()}",
        "decode_text": f"select doc_id, {digest} from (select doc_id, "
        rf"regexp_replace({decoded}, '\r\n?', chr(10), 'g') as text from documents)",
        "scan_csv": f"select {_CELLS} || case c_custkey % 3 when 0 then ' a, \"' || c_name || '\"' "
        f"when 1 then ' ' || c_name || chr(10) || card else '' end as text from {_identifiers()}",
        # An object that holds records is a record without cells of its own.
        "scan_json": f"select {_CELLS} as text from {_identifiers()}",
        "scan_parquet": "select concat_ws(' ', cast(c_custkey as varchar), c_name, cast(c_nationkey as varchar), "
        "cast(c_acctbal as varchar), c_mktsegment) as text from customer",
        "src_listing": "select name || '.parquet' as name, '.parquet' as format from (values "
        + ", ".join(f"('{t}')" for t in TABLES)
        + ") as t(name)",
        "table_to_text": "select c_custkey, concat_ws(' ', cast(c_custkey as varchar), "
        "case when c_custkey % 5 <> 0 then card end, "
        "cast(to_json({'snils': snils, 'name': c_name}) as varchar), inn12) as text "
        f"from {_identifiers()}",
        "html_text": f"select page_id, {digest} from {_html()}",
        "extract_status": "select case when family is null then 'unsupported' "
        f"when not {extracted} then 'skipped_media' "
        f"when not regexp_matches(text, '[^{SPACE}]') then 'blank' else 'ok' end as status, "
        f"count(*) as files from {_rotated()} group by 1",
        "report_roundtrip": f"with {_corpus()}, {_candidates('docs', 'path', 'doc_id, path', CATEGORIES)}, "
        f"found as (select * from candidates where {_value_ok()}), {_profile()} "
        f"select {_DETAILED} from profile",
    }


def _detection() -> dict[str, str]:
    out = {}
    for category in CATEGORIES:
        out[f"detect_{category}"] = (
            f"{_doc_candidates([category])} select doc_id, position, value from candidates "
            f"where {_value_ok()}"
        )
    out["findings"] = (
        f"{_doc_candidates()} select doc_id, category, value, position, {_mask()} as masked_value "
        f"from candidates where {_value_ok()}"
    )
    out["match_positions"] = (
        f"{_doc_candidates()} select doc_id, category, position, "
        "cast(length(value) as int) as n_chars from candidates"
    )
    out["findings_subset"] = (
        f"{_doc_candidates(CONFIGURED_CATEGORIES)} select doc_id, category, value "
        f"from candidates where {_value_ok()}"
    )
    return out


def _values() -> dict[str, str]:
    def mask(categories) -> str:
        return (
            f"{_doc_candidates(categories)} select doc_id, category, value, "
            f"{_mask()} as masked_value from candidates where {_value_ok()}"
        )

    named = ["fio", "email", "phone", "bank_card", "snils", "inn", "passport"]
    columns = ["card", "snils", "inn10", "inn12"]
    return {
        "validate_luhn": f"select c_custkey, card, {_luhn('card')} as ok from {_identifiers()}",
        "validate_snils": f"select c_custkey, snils, {_snils('snils')} as ok from {_identifiers()}",
        "validate_inn": f"select c_custkey, inn10, {_inn('inn10')} as ok10, inn12, "
        f"{_inn('inn12')} as ok12 from {_identifiers()}",
        "validated_findings": f"{_doc_candidates()} select doc_id, category, value, "
        f"{_value_ok()} as ok from candidates",
        "mask_fio": mask(["fio"]),
        "mask_identifier": "select c_custkey, "
        + ", ".join(f"{_first3_last3(c)} as {c}" for c in columns)
        + f" from {_identifiers()}",
        "mask_email": mask(["email"]),
        "mask_other": mask([c for c in CATEGORIES if c not in named]),
    }


def _profiles() -> dict[str, str]:
    advice = ", ".join(f"({_text(level)}, {_text(text)})" for level, text in RECOMMENDATIONS)
    groups = " ".join(
        f"when {_in('lower(format)', ends)} then '{name}'" for name, ends in SUFFIX_GROUPS
    )
    return {
        "category_counts": f"with {_found()} select path, category, count(*) as n "
        "from found group by path, category",
        "file_profile": f"with {_found()}, {_profile()} select {_PROFILE_COLUMNS} from profile "
        "where path like 'documents/%'",
        "corpus_scan": _over_profile(f"select {_PROFILE_COLUMNS} from profile"),
        "sensitivity_sums": _over_profile(
            "select path, sensitive as sensitive_count, regular as regular_count from profile"
        ),
        "protection_level": _over_profile("select path, protection_level from profile"),
        "recommendations": _over_profile(
            "select path, protection_level, coalesce(advice, '') as recommendation from profile "
            f"left join (values {advice}) a(level, advice) on level = protection_level"
        ),
        "summary_report": _over_profile(
            "select size, lower(strftime(mtime, '%b %d %H:%M')) as time, name from profile"
        ),
        "detailed_report": _over_profile(f"select {_DETAILED} from profile"),
        "level_counts": _over_profile(
            "select protection_level, count(*) as files, "
            "cast(sum(count(*)) over () as bigint) as total from profile group by 1"
        ),
        "size_stats": _over_profile(
            "select count(*) as files, cast(sum(size) as bigint) as total_bytes, "
            "avg(size) as mean_bytes, min(size) as min_bytes, max(size) as max_bytes, "
            "sum(size)::double / 1024 / 1024 as total_mb, avg(size) / 1024 as mean_kb from profile"
        ),
        "top_files": _over_profile(
            "select cast(row_number() over (order by size desc, name) as int) as rank, name, size, "
            "size::double / 1024 / 1024 as size_mb from profile order by rank limit 10"
        ),
        "level_share": _over_profile(_share("protection_level", "УЗ")),
        "format_share": _over_profile(_share("format", "формат_файла")),
        "top_categories": f"with {_found()}, {_profile()} select category, count(*) as files "
        "from counted group by category order by files desc, category limit 10",
        "family_share": _over_profile(_share(f"case {groups} else 'other' end", "family")),
    }


def _comparison() -> dict[str, str]:
    left, right = "select name from first_", "select name from second_"
    return {
        "report_latest": f"{_reports()} select name, seq, size, protection_level from ("
        "select *, row_number() over (partition by name order by seq desc) as k from ("
        "select 1 as seq, name, size, protection_level from first_ union all "
        "select 2, name, size, protection_level from second_)) where k = 1",
        "report_common": f"{_reports()} {left} intersect {right}",
        "report_only_left": f"{_reports()} {left} except {right}",
        "report_only_right": f"{_reports()} {right} except {left}",
        "report_diff_counts": f"{_reports()} select (select count(distinct name) from first_) "
        "as left_files, (select count(distinct name) from second_) as right_files, "
        f"(select count(*) from ({left} intersect {right})) as common_files, "
        f"(select count(*) from ({left} except {right})) as only_left, "
        f"(select count(*) from ({right} except {left})) as only_right",
        "report_diff_sample": f"{_reports()} "
        f"(select 'left' as side, name from ({left} except {right}) order by name limit 10) "
        "union all "
        f"(select 'right' as side, name from ({right} except {left}) order by name limit 10)",
    }


def statements() -> dict[str, str]:
    """One statement per query that SQL can state."""
    return {**_sources(), **_detection(), **_values(), **_profiles(), **_comparison()}
