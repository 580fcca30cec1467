"""Identifier, label and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier pattern, run folder names with the k they stand for,
# and the sources whose files cover every cohort at once.
VERSIONED_ENSEMBL_ID = r"(?i)^(ENS[GPT]\d+)\.(\d+)$"
DEFAULT_RUN_DIR = "outputs"
DEFAULT_RUN_K = 2000
RUN_DIR_WITH_K = r"^outputs_k([0-9]+)$"
ALL_COHORTS = "all_cancers"
SHARED_SOURCES = ("harmonized", "mssm")
SHARED_SOURCES_BY_TYPE = {"washu": ("tumor_purity", "hla_typing")}

_OUTER_SPACE = r"(?U)^\s+|\s+$"
# One level of a header tuple: quoted text, or a bare missing mark.
_LEVEL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\b(?:nan|None)\b"""


def strip(text: Column) -> Column:
    """Strip any white space; ``trim`` drops blanks only.

    Labels that begin and end with a printable ASCII character, nearly all of
    them, skip the pattern."""
    clean = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(clean, text).otherwise(F.regexp_replace(text, _OUTER_SPACE, ""))


def clean_feature_id(raw: Column) -> Column:
    """Strip an id and drop the version of an Ensembl id; missing becomes ''."""
    text = strip(F.coalesce(raw.cast("string"), F.lit("")))
    unversioned = F.regexp_replace(text, VERSIONED_ENSEMBL_ID, "$1")
    return F.when(F.contains(text, F.lit(".")), unversioned).otherwise(text)


def clean_sample_id(raw: Column) -> Column:
    return strip(raw.cast("string"))


def camel_case(name: Column) -> Column:
    """``'tumor-purity v2'`` to ``'TumorPurityV2'``."""
    words = F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.initcap(words), " ", "")


def k_from_run_dir(name: Column) -> Column:
    """Number of selected features a run folder stands for, NULL if none."""
    digits = F.regexp_extract(name, RUN_DIR_WITH_K, 1)
    return F.when(name == DEFAULT_RUN_DIR, F.lit(DEFAULT_RUN_K)).when(
        digits != "", digits.try_cast("int")
    )


def split_list(text: Column) -> Column:
    """Items of a comma list, stripped, blanks left out."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")


def has_digit_and_letter(label: Column) -> Column:
    return label.rlike(r"\p{Nd}") & label.rlike(r"\p{L}")


def source_prefix(source: Column, cohort: Column, data_type: Column) -> Column:
    """Start of the file names that carry ``data_type`` of one source."""
    shared = source.isin(*SHARED_SOURCES)
    for name, types in SHARED_SOURCES_BY_TYPE.items():
        shared = shared | ((source == name) & data_type.isin(*types))
    scope = F.when(shared, F.lit(ALL_COHORTS)).otherwise(cohort)
    return F.concat(F.concat_ws("-", source, scope, data_type), F.lit("-"))


def header_levels(label: Column) -> Column:
    """Levels of a column label such as ``('raw', 'G0', 'ENSG0')``; a missing
    level is NULL, and a plain label has one level."""
    found = F.regexp_extract_all(label, F.lit(_LEVEL), F.lit(0))
    levels = F.transform(
        found,
        lambda level: F.when(
            level.rlike("^['\"]"),
            F.regexp_replace(F.substring(level, F.lit(2), F.length(level) - 2), r"\\(.)", "$1"),
        ),
    )
    return F.when(label.rlike(r"^\(.*\)$") & (F.size(found) > 0), levels).otherwise(
        F.array(label)
    )
