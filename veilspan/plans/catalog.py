"""Registered queries: one per operator, each over whole tables.

Every query takes (spark, folder of Parquet tables) and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import checks, masks
from veilspan.functions.masks import IDENTIFIER_CATEGORIES
from veilspan.functions.patterns import CATEGORIES, CONFIGURED_CATEGORIES
from veilspan.functions.sqltext import quoted
from veilspan.functions.text import decode_text, row_text
from veilspan.operators import analytics, compare
from veilspan.operators.detect import findings
from veilspan.operators.levels import regular_count, sensitive_count, with_recommendations
from veilspan.operators.profile import category_counts, profile_files
from veilspan.plans import corpus
from veilspan.plans.runtime import scratch_path, spread
from veilspan.sources import tables
from veilspan.sources.listing import family, list_files, status
from veilspan.sources.reports import (
    detailed_report,
    read_detailed,
    summary_report,
    write_report,
)

Query = Callable[[SparkSession, str], DataFrame]

# --- fixed values: suffixes given to documents in turn, and byte samples ---
ROTATED_SUFFIXES = [
    ".txt", ".MD", ".csv", ".json", ".parquet", ".html",
    ".pdf", ".docx", ".png", ".mp4", ".xlsx", "",
]
BLANK_PERIOD = 37
BLANK = " \\n\u00a0\u2003 "  # white space of every kind
CP1251_GREETING = "CFF0E8E2E5F22C20ECE8F021"  # "Привет, мир!" in cp1251
UNDEFINED_PREFIX = "98CFF0"  # a byte cp1251 lacks: the whole text becomes Latin-1

# Two scans with complementary rules give two reports over the same corpus.
IDENTIFIER_SCAN = [
    "phone", "passport", "snils", "inn", "driver_license", "bank_card", "bank_account", "bik",
]
PERSONAL_SCAN = ["fio", "email", "birth_date", "address", "biometric", "health", "special"]

TIME = "date_format(mtime, 'yyyy-MM-dd HH:mm:ss') as modified"
COUNTS = (
    "array_join(transform(map_entries(pii_counts), e -> concat(e.key, ':', e.value)), ', ')"
    " as counts"
)
PROFILE = [
    "path", "name", "size", TIME, "array_join(pii_categories, ', ') as categories", COUNTS,
    "protection_level", "format",
]


def _rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every kind of suffix, some of them blank."""
    listed = ", ".join(quoted(s) for s in ROTATED_SUFFIXES)
    rows = corpus.documents(spark, sf_dir).selectExpr(
        "doc_id",
        "concat('documents/', doc_id, "
        f"element_at(array({listed}), cast(doc_id % {len(ROTATED_SUFFIXES)} as int) + 1)) as path",
        f"case when doc_id % {BLANK_PERIOD} = 0 then '{BLANK}' else text end as text",
    )
    return rows.selectExpr("doc_id", "path", "text", f"{family('path')} as family")


# --- A: sources -------------------------------------------------------------
def src_listing(spark, sf_dir):
    """Files of the data folder; sizes are left to the file system."""
    return list_files(spark, sf_dir).select("name", "format")


def file_metadata(spark, sf_dir):
    return corpus.corpus_files(spark, sf_dir).selectExpr("path", "name", "format", "size", TIME)


def format_router(spark, sf_dir):
    return _rotated(spark, sf_dir).select("doc_id", "path", "family")


def decode_query(spark, sf_dir):
    # Rows of the second and third kind hold the text in Latin-1: as cp1251 reads it, and as it stands.
    latin = "encode(regexp_replace(text, '[^\\\\x00-\\\\x7F\\\\xA1-\\\\xFF]', '?'), 'ISO-8859-1')"
    content = (
        "case doc_id % 3 when 0 then encode(text, 'UTF-8') "
        f"when 1 then concat(unhex('{CP1251_GREETING}0D0A'), {latin}) "
        f"else concat(unhex('{UNDEFINED_PREFIX}0D'), {latin}) end"
    )
    docs = spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    decoded = docs.selectExpr("doc_id", f"{content} as content").selectExpr(
        "doc_id", f"{decode_text('content')} as text"
    )
    return decoded.selectExpr(
        "doc_id", "cast(char_length(text) as bigint) as n_chars", "md5(text) as digest"
    )


def scan_csv(spark, sf_dir):
    """CSV with commas, quotes and line breaks inside cells, as a directory scan reads it."""
    path = scratch_path(spark, "csv")
    note = "case c_custkey % 3 when 0 then concat('a, \"', c_name, '\"') when 1 then concat(c_name, '\\n', card) end"
    rows = corpus.identifiers(spark, sf_dir).withColumn("note", F.expr(note))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    # Every part file begins with its header, which is a row like any other.
    return tables.csv_rows(spark, path, tables.any_case(".csv")).select("text").where("text not like 'c_custkey %'")


def scan_json(spark, sf_dir):
    """Files of one record a line, of arrays and of an object that holds an array, read as in a scan."""
    path = scratch_path(spark, "json")
    rows = corpus.identifiers(spark, sf_dir)
    record = F.to_json(F.struct(*rows.columns))
    parts = rows.select(record.alias("value"), F.pmod("c_custkey", F.lit(30)).alias("k"), "c_custkey")
    listed = parts.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("value")), ",\n").alias("v"))
    parts.where("k < 10").select("value").write.format("text").save(f"{path}/lines")
    listed.where("k between 10 and 19").select(F.format_string("[%s]", "v").alias("value")).write.format("text").save(f"{path}/arrays")
    listed.where("k > 19").select(F.format_string('{"rows": [%s]}', "v").alias("value")).write.format("text").save(f"{path}/objects")
    folders = [f"{path}/{x}" for x in ("lines", "arrays", "objects")]
    return tables.json_records(spark, folders, tables.any_case(".txt")).select("text")


def scan_parquet(spark, sf_dir):
    """All columns of a table, read as in a scan."""
    return tables.parquet_rows_any_schema(spark, f"{sf_dir}/customer.parquet", tables.any_case(".parquet")).select("text")


def table_to_text(spark, sf_dir):
    rows = corpus.identifiers(spark, sf_dir).selectExpr(
        "c_custkey",
        "case when c_custkey % 5 = 0 then null else card end as card",
        "named_struct('snils', snils, 'name', c_name) as person",
        "inn12",
    )
    return rows.selectExpr("c_custkey", f"{row_text(rows)} as text")


def html_query(spark, sf_dir):
    return corpus.pages(spark, sf_dir).selectExpr(
        "page_id", "cast(char_length(text) as bigint) as n_chars", "md5(text) as digest"
    )


def extract_status(spark, sf_dir):
    rows = _rotated(spark, sf_dir).selectExpr(f"{status('family', 'text')} as status")
    return rows.groupBy("status").agg(F.count("*").alias("files"))


def report_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "report")
    profile = profile_files(corpus.documents(spark, sf_dir))
    write_report(detailed_report(profile), path)
    return read_detailed(spark, path)


# --- B: detection -----------------------------------------------------------
def _document_findings(spark, sf_dir, **options) -> DataFrame:
    return findings(corpus.documents(spark, sf_dir), ["doc_id"], **options)


def _detect(category: str) -> Query:
    def query(spark, sf_dir):
        found = _document_findings(spark, sf_dir, categories=[category])
        return found.select("doc_id", "position", "value")

    query.__name__ = f"detect_{category}"
    return query


def all_findings(spark, sf_dir):
    return _document_findings(spark, sf_dir).drop("ordinal")


def match_positions(spark, sf_dir):
    found = _document_findings(spark, sf_dir, validate=False)
    return found.selectExpr(
        "doc_id", "category", "position", "char_length(value) as n_chars"
    )


def findings_subset(spark, sf_dir):
    found = _document_findings(
        spark, sf_dir, categories=CONFIGURED_CATEGORIES, with_offsets=False
    )
    return found.select("doc_id", "category", "value")


# --- C, D: checks and masks ---------------------------------------------------
def validate_luhn(spark, sf_dir):
    return corpus.identifiers(spark, sf_dir).selectExpr(
        "c_custkey", "card", f"{checks.luhn_ok('card')} as ok"
    )


def validate_snils(spark, sf_dir):
    return corpus.identifiers(spark, sf_dir).selectExpr(
        "c_custkey", "snils", f"{checks.snils_ok('snils')} as ok"
    )


def validate_inn(spark, sf_dir):
    return corpus.identifiers(spark, sf_dir).selectExpr(
        "c_custkey",
        "inn10",
        f"{checks.inn_ok('inn10')} as ok10",
        "inn12",
        f"{checks.inn_ok('inn12')} as ok12",
    )


def validated_findings(spark, sf_dir):
    found = _document_findings(spark, sf_dir, validate=False, with_offsets=False)
    return found.selectExpr(
        "doc_id", "category", "value", f"{checks.value_ok('category', 'value')} as ok"
    )


def _masked(categories) -> Query:
    def query(spark, sf_dir):
        found = _document_findings(spark, sf_dir, categories=categories, with_offsets=False)
        return found.select("doc_id", "category", "value", "masked_value")

    return query


def mask_identifier(spark, sf_dir):
    columns = ["card", "snils", "inn10", "inn12"]
    return corpus.identifiers(spark, sf_dir).selectExpr(
        "c_custkey", *[f"{masks.mask_identifier(c)} as {c}" for c in columns]
    )


# --- E, F: profiles and levels ------------------------------------------------
def category_query(spark, sf_dir):
    return category_counts(corpus.corpus_rows(spark, sf_dir))


def file_profile(spark, sf_dir):
    return profile_files(corpus.documents(spark, sf_dir)).selectExpr(*PROFILE)


def corpus_scan(spark, sf_dir):
    return corpus.corpus_profile(spark, sf_dir).selectExpr(*PROFILE)


def sensitivity_sums(spark, sf_dir):
    return corpus.corpus_profile(spark, sf_dir).selectExpr(
        "path",
        f"{sensitive_count('pii_counts')} as sensitive_count",
        f"{regular_count('pii_counts')} as regular_count",
    )


def protection_level(spark, sf_dir):
    return corpus.corpus_profile(spark, sf_dir).select("path", "protection_level")


def recommendations(spark, sf_dir):
    profile = corpus.corpus_profile(spark, sf_dir).select("path", "protection_level")
    return with_recommendations(profile)


# --- G, H: reports --------------------------------------------------------------
def summary_query(spark, sf_dir):
    return summary_report(corpus.corpus_profile(spark, sf_dir))


def detailed_query(spark, sf_dir):
    return detailed_report(corpus.corpus_profile(spark, sf_dir))


def level_counts(spark, sf_dir):
    return analytics.level_counts(corpus.corpus_profile(spark, sf_dir))


def size_stats(spark, sf_dir):
    return analytics.size_stats(summary_query(spark, sf_dir))


def top_files(spark, sf_dir):
    return analytics.top_files(summary_query(spark, sf_dir))


def level_share(spark, sf_dir):
    return analytics.level_share(detailed_query(spark, sf_dir))


def format_share(spark, sf_dir):
    return analytics.format_share(detailed_query(spark, sf_dir))


def top_categories(spark, sf_dir):
    return analytics.top_categories(detailed_query(spark, sf_dir))


def family_share(spark, sf_dir):
    return analytics.family_share(detailed_query(spark, sf_dir))


# --- I: comparison ------------------------------------------------------------
def _report(spark, sf_dir, scan: int) -> DataFrame:
    categories = IDENTIFIER_SCAN if scan == 1 else PERSONAL_SCAN
    profile = corpus.corpus_profile(spark, sf_dir, categories)
    return profile.select("name", F.lit(scan).alias("seq"), "size", "protection_level")


def report_latest(spark, sf_dir):
    appended = _report(spark, sf_dir, 1).unionByName(_report(spark, sf_dir, 2))
    return compare.latest(appended)


def _compared(operator) -> Query:
    def query(spark, sf_dir):
        return operator(_report(spark, sf_dir, 1), _report(spark, sf_dir, 2))

    query.__name__ = operator.__name__
    return query


def registered() -> dict[str, Query]:
    """All queries by name."""
    others = [
        c for c in CATEGORIES if c not in (*IDENTIFIER_CATEGORIES, "fio", "email")
    ]
    return {
        "src_listing": src_listing,
        "file_metadata": file_metadata,
        "format_router": format_router,
        "decode_text": decode_query,
        "scan_csv": scan_csv,
        "scan_json": scan_json,
        "scan_parquet": scan_parquet,
        "table_to_text": table_to_text,
        "html_text": html_query,
        "extract_status": extract_status,
        "report_roundtrip": report_roundtrip,
        **{f"detect_{c}": _detect(c) for c in CATEGORIES},
        "findings": all_findings,
        "match_positions": match_positions,
        "findings_subset": findings_subset,
        "validate_luhn": validate_luhn,
        "validate_snils": validate_snils,
        "validate_inn": validate_inn,
        "validated_findings": validated_findings,
        "mask_fio": _masked(["fio"]),
        "mask_identifier": mask_identifier,
        "mask_email": _masked(["email"]),
        "mask_other": _masked(others),
        "category_counts": category_query,
        "file_profile": file_profile,
        "corpus_scan": corpus_scan,
        "sensitivity_sums": sensitivity_sums,
        "protection_level": protection_level,
        "recommendations": recommendations,
        "summary_report": summary_query,
        "detailed_report": detailed_query,
        "level_counts": level_counts,
        "size_stats": size_stats,
        "top_files": top_files,
        "level_share": level_share,
        "format_share": format_share,
        "top_categories": top_categories,
        "family_share": family_share,
        "report_latest": report_latest,
        "report_common": _compared(compare.common),
        "report_only_left": _compared(compare.only_left),
        "report_only_right": _compared(compare.only_right),
        "report_diff_counts": _compared(compare.diff_counts),
        "report_diff_sample": _compared(compare.diff_sample),
    }
