"""Detection rules as regular expressions for Spark's regex functions.

Three points of dialect matter:

* The ASCII/Unicode mode of a word boundary differs between regex engines and
  JDK releases, so boundaries are spelled out with look-around over ``WORD``.
* ``(?iu:...)`` is needed for Cyrillic; ``i`` alone folds ASCII only.
* A rule tests its first character before anything else, so most positions are
  rejected before a look-behind runs.  ``x(?<!W.)`` is ``(?<!W)x`` in that order.

``(?=x)`` prefixes and possessive ``++`` are pure speed-ups: they never change
which text matches.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: character classes -------------------------------------
# White space as a class body: every character str.isspace() accepts.
SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# Every Cyrillic letter a rule can match, with the code points that fold to one.
FOLDED = r"\x{1C80}-\x{1C8F}"
CYRILLIC = rf"[\x{{400}}-\x{{4FF}}{FOLDED}]"

LEFT = f"(?<!{WORD})"
RIGHT = f"(?!{WORD})"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
S = f"[{SPACE}]"
DASH = f"[{SPACE}\\-]?"
# First character of a word, taken before the look-behind so that other positions
# fail on one cheap test.
AFTER_FIRST = f"(?<!{WORD}.)"


@dataclass(frozen=True)
class Rule:
    """One category: its place in the report order, pattern and row gate.

    ``gate`` names a cheap test shared by several rules.  The core of a numeric
    rule is the part of it that lies within one NUMBER_RUN and is looked for in
    those runs only.  ``skip`` matches where the pattern failed and would fail
    again at each of the next characters, so that a long run of them is not
    searched from every one; every match holds ``mark`` and no skipped piece does.  Gate and core hold for every text the rule can match, so rows
    failing one of them skip the rule.  Rules with ``stems`` share one pass:
    see KEYWORD_PATTERN.
    """

    ordinal: int
    category: str
    pattern: str
    gate: str
    core: str | None = None
    stems: tuple[str, ...] = ()
    skip: str | None = None
    mark: str | None = None

    @property
    def scanned(self) -> str:
        """The pattern, or else what may be passed over whole, because no match starts inside it."""
        return f"(?:{self.pattern})|{self.skip}" if self.skip else self.pattern


# Shape of a domain: without one, long runs of address characters are not tried.
EMAIL_GATE = r"@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2}"

# Maximal run of what may stand inside a numeric match, from its first digit on.
# The shortest numeric match has eight characters.
NUMBER_RUN = rf"{DIGIT}[{DIGIT}{SPACE}\-)./№]{{7,}}"


def _rules() -> tuple[Rule, ...]:
    fio_word = "[А-ЯЁ][а-яё]+"
    day = "(?:0?[1-9]|[12][0-9]|3[01])"
    month = "(?:0?[1-9]|1[012])"
    phone_core = (
        rf"[489]{DIGIT}{{2}}\)?{DASH}{DIGIT}{{3}}{DASH}{DIGIT}{{2}}{DASH}{DIGIT}{{2}}"
    )
    local_start = rf"(?:(?=[A-Za-z0-9_]){LEFT}|(?=[.%+\-])(?<={WORD}))"
    address_marks = [r"г\.", "город", r"ул\.", "улица", r"пр\.", "проспект", r"д\.", "дом"]
    # --- fixed values: category order, keyword stems, number layouts ------
    table = [
        (
            "fio",
            f"[А-ЯЁ]{AFTER_FIRST}[а-яё]+{S}+{fio_word}(?:{S}+{fio_word})?{RIGHT}",
            "cyrillic",
        ),
        (
            "phone",
            rf"(?=\P{{L}})(?=[78+]|[{SPACE}\-]?\(?[489])(?:\+7|8|7)?{DASH}\(?{phone_core}{RIGHT}",
            "number",
            phone_core,
        ),
        (
            "email",
            rf"{local_start}[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Z|a-z]{{2,}}{EDGE}",
            "at_sign",
            None,
            (),
            # What follows a run decides, wherever in it a match would start.
            rf"{local_start}[A-Za-z0-9._%+\-]{{64,}}+",
            "@",
        ),
        (
            "passport",
            f"(?:(?=[{DIGIT}псПС{FOLDED}]){LEFT}|(?=\\P{{L}})(?=[{SPACE}:])(?<={WORD}))"
            f"(?iu:паспорт|серия)?[{SPACE}:]*+"
            f"{DIGIT}{{2}}{DASH}{DIGIT}{{2}}[{SPACE}\\-№]+{DIGIT}{{6}}{RIGHT}",
            "number",
            f"{DIGIT}{{2}}{DASH}{DIGIT}{{2}}[{SPACE}\\-№]+{DIGIT}{{6}}",
        ),
        (
            "snils",
            f"{DIGIT}{AFTER_FIRST}{DIGIT}{{2}}{DASH}{DIGIT}{{3}}{DASH}{DIGIT}{{3}}{DASH}"
            f"{DIGIT}{{2}}{RIGHT}",
            "number",
            f"(?:{DIGIT}{{3}}{DASH}){{3}}{DIGIT}{{2}}",
        ),
        (
            "inn",
            f"(?=[{DIGIT}иИ]){LEFT}(?:(?iu:инн)[{SPACE}:№]*)?(?:{DIGIT}{{10}}|{DIGIT}{{12}}){RIGHT}",
            "number",
            f"{DIGIT}{{10}}",
        ),
        (
            "driver_license",
            f"{DIGIT}{AFTER_FIRST}{DIGIT}{S}?{DIGIT}{{2}}{S}?{DIGIT}{{6}}{RIGHT}",
            "number",
            f"{DIGIT}{{2}}{S}?{DIGIT}{{2}}{S}?{DIGIT}{{6}}",
        ),
        (
            "bank_card",
            f"{DIGIT}{AFTER_FIRST}{DIGIT}{{3}}{DASH}(?:{DIGIT}{{4}}{DASH}){{2}}{DIGIT}{{4}}{RIGHT}",
            "number",
            f"(?:{DIGIT}{{4}}{DASH}){{3}}{DIGIT}{{4}}",
        ),
        (
            "bank_account",
            f"{DIGIT}{AFTER_FIRST}{DIGIT}{{19}}{RIGHT}",
            "number",
            f"{DIGIT}{{20}}",
        ),
        (
            "bik",
            f"(?=[0бБ{FOLDED}]){LEFT}(?:(?iu:бик)[{SPACE}:№]*)?04{DIGIT}{{7}}{RIGHT}",
            "number",
            f"04{DIGIT}{{7}}",
        ),
        (
            "birth_date",
            f"(?=[0-9]){LEFT}{day}[./-]{month}[./-](?:19|20){DIGIT}{{2}}{RIGHT}",
            "number",
            f"[0-9][./-][0-9]{{1,2}}[./-](?:19|20){DIGIT}{{2}}",
        ),
        (
            "address",
            f"(?={CYRILLIC})(?iu)(?:{_by_first_letter(address_marks)})[{SPACE}.]+"
            rf"[А-ЯЁа-яё0-9{SPACE}\-,.]+",
            "cyrillic",
        ),
        (
            "biometric",
            *_stems(
                f"отпечат(?:ок|ки){S}+пальц",
                f"радужн(?:ая|ой){S}+оболочк",
                f"голосов(?:ой|ые){S}+образ",
                "биометр",
                f"сканирование{S}+лиц",
                f"распознавание{S}+лиц",
            ),
        ),
        (
            "health",
            *_stems(
                "диагноз",
                "заболевание",
                "болезнь",
                "лечение",
                "медицинск",
                "анализ",
                "обследование",
                "терапия",
                "операция",
                "инвалидность",
                f"группа{S}+здоровья",
            ),
        ),
        (
            "special",
            *_stems(
                "религ",
                "вероисповедание",
                "национальность",
                "раса",
                f"политическ(?:ие|ая){S}+(?:взгляд|убеждени)",
                "профсоюз",
                "интимн",
            ),
        ),
    ]
    return tuple(Rule(i, *row) for i, row in enumerate(table))


def _stems(*stems: str) -> tuple[str, str, None, tuple[str, ...]]:
    """Pattern, gate, core and stems of a word that begins with a stem."""
    return _stem_pattern(stems), "cyrillic", None, stems


def _stem_pattern(stems) -> str:
    return f"(?={CYRILLIC}){LEFT}(?iu:{_by_first_letter(stems)}){WORD}*{RIGHT}"


def _by_first_letter(stems) -> str:
    """Alternation grouped so that one letter test picks the branch."""
    groups: dict[str, list[str]] = {}
    for stem in stems:
        groups.setdefault(stem[0], []).append(stem[1:])
    return "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in groups.items())


RULES: tuple[Rule, ...] = _rules()
CATEGORIES: tuple[str, ...] = tuple(r.category for r in RULES)

# One pass for all keyword rules.  Every match starts at a word start, no stem of
# one rule is a prefix of another rule's, and no second word of a two-word stem
# starts a match, so the matches of the union are exactly those of its parts.
KEYWORD_PATTERN = _stem_pattern([stem for r in RULES for stem in r.stems])

# Categories a stock configuration lists; the bank code rule is not among them.
CONFIGURED_CATEGORIES: tuple[str, ...] = tuple(c for c in CATEGORIES if c != "bik")


def select_rules(categories=None) -> tuple[Rule, ...]:
    """Rules for the named categories, always in rule order."""
    if categories is None:
        return RULES
    wanted = set(categories)
    unknown = wanted.difference(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return tuple(r for r in RULES if r.category in wanted)
