"""Run the rules over a text column.

Each pattern is evaluated at most once per row, and only when its gates hold.
Gates and match lists are computed in projections of their own, which Catalyst
keeps apart where a result is used more than once.  Scan results sit behind
``explode_outer`` before any filter on them: Catalyst pushes a filter on a
computed column below the projection and would evaluate every pattern a second
time, but it does not push one through an outer generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import checks, masks
from veilspan.functions.patterns import (
    CATEGORIES,
    CYRILLIC,
    EMAIL_GATE,
    KEYWORD_PATTERN,
    NUMBER_RUN,
    Rule,
    select_rules,
)
from veilspan.functions.sqltext import let, quoted, running_sums

_NOTHING = "cast(array() as array<string>)"
# Noncharacters: the first is set around every match.
_MARK, _OTHER = "\ufdd0", "\ufdd1"


def _extract_all(pattern: str) -> str:
    return f"regexp_extract_all(_text, {quoted(pattern)}, 0)"


# Cheap necessary condition for each group of rules.  For numbers it is not a
# flag but the few pieces of text that can hold one.
_GATES = {
    "cyrillic": "octet_length(_text) > char_length(_text) and "
    f"rlike(_text, {quoted(CYRILLIC)})",
    "at_sign": f"contains(_text, '@') and rlike(_text, {quoted(EMAIL_GATE)})",
    "number": f"array_join({_extract_all(NUMBER_RUN)}, '|')",
}


def _extract(gate: str, pattern: str, core: str | None = None) -> str:
    possible = f"rlike(_{gate}, {quoted(core)})" if core else f"_{gate}"
    return f"coalesce(case when {possible} then {_extract_all(pattern)} end, {_NOTHING})"


def _candidates(rule: Rule) -> str:
    """All leftmost non-overlapping matches, before the checksum test."""
    if rule.stems:
        return f"filter(_keywords, k -> rlike(k, {quoted(_own_stems(rule))}))"
    if rule.skip:
        return f"filter({_pieces(rule)}, v -> contains(v, '{rule.mark}'))"
    return _pieces(rule)


def _own_stems(rule: Rule) -> str:
    return f"^(?iu:{'|'.join(rule.stems)})"


def _pieces(rule: Rule) -> str:
    """The matches, and between them what was passed over."""
    return _extract(rule.gate, rule.scanned, rule.core)


def _gated(df: DataFrame, keep: list[str], text: str, rules: tuple[Rule, ...], keywords: bool = True) -> DataFrame:
    """The kept columns, the text, the gates and, if asked, the shared keyword matches."""
    gates = sorted({r.gate for r in rules})
    # Both code points are outside every pattern, so one may stand for the other.
    clean = f"if(contains(_text, '{_MARK}'), translate(_text, '{_MARK}', '{_OTHER}'), _text) as _text"
    out = df.select(*keep, F.col(text).alias("_text")).selectExpr(*keep, clean).selectExpr(
        *keep, "_text", *[f"{_GATES[g]} as _{g}" for g in gates]
    )
    if keywords and any(r.stems for r in rules):
        out = out.selectExpr("*", f"{_extract('cyrillic', KEYWORD_PATTERN)} as _keywords")
    return out


def findings(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    categories=None,
    with_offsets: bool = True,
    validate: bool = True,
) -> DataFrame:
    """One row per match: the kept columns plus category, value, position, mask.

    No shuffle; rows without a match disappear.  ``validate=False`` also returns
    candidates that fail their checksum test.

    A match start is the total length of everything before it.  One pass of the pattern sets marks
    around its matches, and cutting at the marks gives the gaps and the values in turn.
    Searching for the value would be wrong: it may occur earlier without being a match.
    """
    rules = select_rules(categories)
    flat = _with_positions(df, keep, text, rules) if with_offsets else _without_positions(df, keep, text, rules)
    if validate:
        flat = flat.where(checks.value_ok("category", "value"))
    return flat.selectExpr("*", f"{masks.masked('category', 'value')} as masked_value")


def _category(ordinal: str) -> str:
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    return f"get(array({names}), {ordinal}) as category"


def _marked_pieces(gate: str, pattern: str, core: str | None) -> str:
    """Gap, match, gap and so on to the last gap; null without a match."""
    possible = f"rlike(_{gate}, {quoted(core)})" if core else (f"_{gate}" if gate == "cyrillic" or gate == "at_sign" else f"_{gate} <> ''")
    marked = f"regexp_replace(_text, {quoted(pattern)}, '{_MARK}$0{_MARK}')"
    cut = f"case when octet_length(marked) > octet_length(_text) then split(marked, '{_MARK}', -1) end"
    return f"case when {possible} then {let('marked', marked, cut)} end"


def _with_positions(df: DataFrame, keep: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    stems = [r for r in rules if r.stems]
    passes = [(r.ordinal, _marked_pieces(r.gate, r.scanned, r.core)) for r in rules if not r.stems]
    if stems:  # one pass for all keyword rules
        passes.append((-1, _marked_pieces("cyrillic", KEYWORD_PATTERN, None)))
    lists = _gated(df, keep, text, rules, keywords=False).selectExpr(*keep, *[f"{pieces} as _p{k}" for k, (_, pieces) in enumerate(passes)])
    hits = ", ".join(f"struct({ordinal} as ordinal, _p{k} as pieces)" for k, (ordinal, _) in enumerate(passes))
    per_pass = lists.selectExpr(*keep, f"explode_outer(filter(array({hits}), h -> h.pieces is not null)) as hit").where("hit is not null")
    sums = running_sums("transform(hit.pieces, p -> char_length(p))")
    value = "named_struct('value', get(hit.pieces, 2 * k + 1), 'position', get(sums, 2 * k))"
    items = let("sums", sums, f"transform(sequence(0, size(hit.pieces) div 2 - 1), k -> {value})")
    # The list has a column of its own, so its rows do not carry the pieces along.
    listed = per_pass.selectExpr(*keep, "hit.ordinal as ordinal", f"{items} as items")
    per_match = listed.selectExpr(*keep, "ordinal", "explode_outer(items) as item").where("item.value is not null")
    for rule in (r for r in rules if r.skip):
        per_match = per_match.where(f"ordinal <> {rule.ordinal} or contains(item.value, '{rule.mark}')")
    if stems:
        arms = " ".join(f"when rlike(item.value, {quoted(_own_stems(r))}) then {r.ordinal}" for r in stems)
        named = f"case when ordinal >= 0 then ordinal {arms} end as ordinal"
        per_match = per_match.selectExpr(*keep, named, "item").where("ordinal is not null")
    return per_match.selectExpr(*keep, "ordinal", _category("ordinal"), "item.value as value", "item.position as position")


def _without_positions(df: DataFrame, keep: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    lists = _gated(df, keep, text, rules).selectExpr(*keep, *[f"{_candidates(r)} as _v{r.ordinal}" for r in rules])
    hits = ", ".join(f"struct({r.ordinal} as ordinal, _v{r.ordinal} as values)" for r in rules)
    per_rule = lists.selectExpr(*keep, f"explode_outer(filter(array({hits}), h -> size(h.values) > 0)) as hit").where("hit is not null")
    listed = per_rule.selectExpr(*keep, "hit.ordinal as ordinal", "hit.values as values")
    per_match = listed.selectExpr(*keep, "ordinal", "explode_outer(values) as value").where("value is not null")
    return per_match.selectExpr(*keep, "ordinal", _category("ordinal"), "value")


def count_matches(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    categories=None,
    drop_empty: bool = True,
) -> DataFrame:
    """The kept columns plus ``counts``: struct of valid matches per category.

    No shuffle.  Rows without any match are dropped unless asked otherwise.
    """
    rules = select_rules(categories)

    def size(rule: Rule) -> str:
        values, test = _candidates(rule), checks.check_for(rule.category)
        # A name match has two words of two letters by construction.
        if test is not None and rule.category != "fio":
            values = f"filter({values}, v -> {test('v')})"
        return f"cast(size({values}) as bigint) as {rule.category}"

    counts = f"struct({', '.join(map(size, rules))})"
    counted = _gated(df, keep, text, rules).selectExpr(
        *keep, f"explode_outer(array({counts})) as counts"
    )
    if not drop_empty:
        return counted
    any_match = " + ".join(f"counts.{r.category}" for r in rules)
    return counted.where(f"{any_match} > 0")
