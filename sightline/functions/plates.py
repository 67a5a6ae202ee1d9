"""Plate text: two normal forms, structure, display, and edit distances."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digits, letter variants and words of Iranian plates.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
LETTERS = "ابپتثجدزژسشصطعفقکگلمنوهی"
LATIN_LETTERS = "DS"
VARIANTS_FROM, VARIANTS_TO = "يىكةۀؤأإآ", "ییکههوااا"
V2_VARIANTS_FROM, V2_VARIANTS_TO = "يىئكةۀؤ", "یییکههو"
IRAN_WORD, ALEF_WORD, ALEF = "ایران", "الف", "ا"
PLATE = rf"^(\d{{2}})([{LETTERS}{LATIN_LETTERS}])(\d{{3}})(\d{{2}})$"
SEPARATORS = r"[\s\-–—_:،,./\\|()\[\]{}]+"
INVISIBLE = r"[​-‏‪-‮⁦-⁩﻿]"
COUNTRY_LABEL = r"(?i)(?<![A-Z])I\.?R\.?A\.?N(?![A-Z])"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def persian_digits(c: Column) -> Column:
    """Display digits; the stored key is unchanged."""
    return F.translate(F.coalesce(c, F.lit("")), ASCII_DIGITS + ARABIC_DIGITS, PERSIAN_DIGITS * 2)


def normalize_plate(c: Column) -> Column:
    """The archive's key: ASCII digits, one form of each letter, no country word,
    nothing but digits, A-Z and the Arabic block. Null becomes empty."""
    v = F.upper(F.translate(ascii_digits(F.coalesce(c, F.lit(""))), VARIANTS_FROM, VARIANTS_TO))
    for word, to in ((ALEF_WORD, ALEF), (IRAN_WORD, ""), ("IRAN", ""), ("IRI", ""), ("IR", "")):
        v = F.replace(v, F.lit(word), F.lit(to))
    return F.regexp_replace(v, r"[^0-9A-Z؀-ۿ]", "")


def split_plate(c: Column) -> Column:
    """struct(prefix, letter, serial, region) of a plate, or null."""
    v = normalize_plate(c)
    parts = [F.regexp_extract(v, PLATE, i).alias(n) for i, n in enumerate(("prefix", "letter", "serial", "region"), 1)]
    return F.when(v.rlike(PLATE), F.struct(*parts))


def plausible(c: Column) -> Column:
    """Whether the text's key is a plate. A plate is its own key, so most texts need no
    normalising."""
    return F.when(c.rlike(PLATE), True).otherwise(normalize_plate(c).rlike(PLATE))


def format_plate(c: Column) -> Column:
    """Dashes between the parts; what is not a plate stays as its key."""
    return F.regexp_replace(normalize_plate(c), PLATE, "$1-$2-$3-$4")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalize_v2(c: Column, nfkc: bool = True) -> Column:
    """The temporal engine's key. Not the same as normalize_plate: compatibility
    forms, invisible marks and separators go, the country label only as a whole
    word, and Alef variants stay. ``nfkc`` False leaves out the one step that has
    no built-in function, for text known to be in that form."""
    v = F.coalesce(c, F.lit(""))
    v = _nfkc(v) if nfkc else v
    v = F.translate(ascii_digits(v), V2_VARIANTS_FROM, V2_VARIANTS_TO)
    v = F.regexp_replace(F.regexp_replace(v, INVISIBLE, ""), COUNTRY_LABEL, "")
    v = F.replace(F.replace(v, F.lit(IRAN_WORD), F.lit("")), F.lit(ALEF_WORD), F.lit(ALEF))
    v = F.replace(F.regexp_replace(v, SEPARATORS, ""), F.lit("هـ"), F.lit("ه"))
    return F.trim(F.translate(v, "ds", "DS"))


def validate_key(v: Column, min_province: int = 10, max_province: int = 99) -> Column:
    """struct(normalized, valid, reason, pattern, province) of a key in the temporal
    engine's form. The key is used many times: a computed one should be a column that
    the optimiser does not merge in."""
    part = lambda i: F.regexp_extract(v, PLATE, i)
    province = part(4).try_cast("int")
    reason = (
        F.when(v == "", "empty")
        .when(~v.rlike(PLATE), "invalid_structure")
        .when(~province.between(min_province, max_province), "invalid_province")
        .when((part(1) == "00") | (part(3) == "000"), "zero_serial")
        .otherwise("ok")
    )
    pattern = F.when(v.rlike(PLATE), F.when(part(2).isin(*LATIN_LETTERS), "diplomatic").otherwise("standard"))
    return F.struct(v.alias("normalized"), (reason == "ok").alias("valid"), reason.alias("reason"), pattern.alias("pattern"), F.nullif(part(4), F.lit("")).alias("province"))


def validate_v2(c: Column, nfkc: bool = True, min_province: int = 10, max_province: int = 99) -> Column:
    """validate_key() of the text's key."""
    return validate_key(normalize_v2(c, nfkc), min_province, max_province)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalised_distance(predicted: Column, expected: Column) -> Column:
    """Edits over the expected length, at most 1; with nothing expected, 0 for
    nothing predicted and else 1."""
    ratio = F.least(F.lit(1.0), F.levenshtein(predicted, expected) / F.greatest(F.lit(1), F.length(expected)))
    return F.when(expected == "", F.when(predicted == "", 0.0).otherwise(1.0)).otherwise(ratio)


def mismatches(a: Column, b: Column) -> Column:
    """Positions that differ, as far as both go."""
    n = F.least(F.length(a), F.length(b))
    differ = lambda i: F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0)
    return F.when(n < 1, F.lit(0)).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), differ), F.lit(0), lambda s, x: s + x))


def can_migrate(a: Column, b: Column) -> Column:
    """Whether one slot's correction leads from one plate to the other."""
    return plausible(a) & plausible(b) & (mismatches(normalize_plate(a), normalize_plate(b)) <= 1)


def csv_safe(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[\s\p{C}]*[=+\-@]|^[\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_identifier(c: Column) -> Column:
    return F.coalesce((F.length(c).between(1, 256)) & (F.trim(c) == c) & ~c.rlike(r"\p{Cntrl}"), F.lit(False))


def is_digest(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
