"""Protection level of a file from its counts per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: category groups, thresholds, labels --------------------
SPECIAL = ("biometric", "health", "special")
SENSITIVE = (
    "passport",
    "snils",
    "inn",
    "driver_license",
    "bank_card",
    "bank_account",
    "bik",
)
REGULAR = ("fio", "phone", "email", "address", "birth_date")
PAYMENT = ("bank_card", "bank_account", "bik")
LARGE_VOLUME = 100
MEDIUM_VOLUME = 10
LEVEL_1, LEVEL_2, LEVEL_3, LEVEL_4 = "УЗ-1", "УЗ-2", "УЗ-3", "УЗ-4"
NO_LEVEL = "Нет ПДн"

# Own wording, one line per level.
RECOMMENDATIONS = [
    (LEVEL_1, "Highest protection: encrypt, restrict access strictly, audit every operation."),
    (LEVEL_2, "Strong protection: encrypt, control access, audit regularly."),
    (LEVEL_3, "Standard protection: control access and apply baseline safeguards."),
    (LEVEL_4, "Basic protection: limit access and apply baseline safeguards."),
    (NO_LEVEL, "No personal data was found."),
]


def _total(counts: str, group: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"coalesce({counts}['{c}'], 0)" for c in group) + ")"


def _any(counts: str, group: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"map_contains_key({counts}, '{c}')" for c in group) + ")"


def sensitive_count(counts: str) -> str:
    """Occurrences of government and payment identifiers in a counts map."""
    return _total(counts, SENSITIVE)


def regular_count(counts: str) -> str:
    """Occurrences of ordinary personal data in a counts map."""
    return _total(counts, REGULAR)


def protection_level(counts: str) -> str:
    """Level of a counts map, first rule wins.

    One to nine sensitive identifiers with nothing else give the "none" label,
    although the file keeps its findings.
    """
    sensitive, regular = sensitive_count(counts), regular_count(counts)
    return (
        f"case when {counts} is null then '{NO_LEVEL}' "
        f"when {_any(counts, SPECIAL)} then '{LEVEL_1}' "
        f"when {_any(counts, PAYMENT)} or {sensitive} >= {LARGE_VOLUME} then '{LEVEL_2}' "
        f"when {sensitive} >= {MEDIUM_VOLUME} or {regular} >= {LARGE_VOLUME} then '{LEVEL_3}' "
        f"when {regular} > 0 then '{LEVEL_4}' else '{NO_LEVEL}' end"
    )


def with_recommendations(df: DataFrame, level: str = "protection_level") -> DataFrame:
    """Add the advice of each row's level; an unknown level gets an empty text.

    The lookup table has five rows, so broadcasting it is always safe.
    """
    rows = ", ".join(f"('{name}', '{advice}')" for name, advice in RECOMMENDATIONS)
    table = df.sparkSession.sql(f"select * from values {rows} as t(`{level}`, advice)")
    return df.join(F.broadcast(table), level, "left").selectExpr(
        *df.columns, "coalesce(advice, '') as recommendation"
    )
