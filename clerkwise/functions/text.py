"""String, regex and file-name expressions."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.once import compute_once

# Field patterns. (?iU) makes Java treat case and spaces as Unicode.
FIELD_PATTERNS = {
    "applicant_name": r"(?iU)(?:applicant|name|owner)\s*[:\-]\s*([A-Za-z][A-Za-z ,.'-]{2,80})",
    "address": r"(?iU)(?:address|property address)\s*[:\-]\s*([0-9A-Za-z .,'#-]{5,120})",
    "date": r"(?iU)(?:date|submitted|filed)\s*[:\-]\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
            r"|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})",
    "parcel_number": r"(?iU)(?:parcel(?:\s*(?:id|number|no))?)\s*[:\-]\s*([A-Za-z0-9-]{4,30})",
    "case_number": r"(?iU)(?:case(?:\s*(?:id|number|no))?)\s*[:\-]\s*([A-Za-z0-9-]{4,30})",
    "amount": r"(?iU)(?:amount|fee|total)\s*[:\-]?\s*\$?\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?)",
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
}

# Log masking patterns.
MASK_EMAIL = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
MASK_KEY = r"(?U)\b(cs_[A-Za-z0-9_\-]{10,})\b"
EMAIL_SHAPE = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"

# MIME types guessed from the extensions that intake accepts.
MIME_TYPES = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "html": "text/html",
    "htm": "text/html",
}

# MIME guess for provider uploads, anything else is a byte stream.
PROVIDER_MIME = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Drop any Unicode white space at both ends (SQL TRIM only drops spaces)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


# Words of which one must occur for a pattern to match at all.
FIELD_LABELS = {
    "applicant_name": ("applicant", "name", "owner"),
    "address": ("address",),
    "date": ("date", "submitted", "filed"),
    "parcel_number": ("parcel",),
    "case_number": ("case",),
    "amount": ("amount", "fee", "total"),
    "email": ("@",),
}

# Letters that equal an ASCII letter when case is ignored, though not when lowered.
CASE_TWINS = ("\u017f", "\u0131", "\u0130")


def may_match(text: Column, lowered: Column, name: str) -> Column:
    """Cheap test that is true for every text a field pattern matches. Most
    whole documents lack most labels, and then the regex does not run."""
    tests = [F.contains(lowered, F.lit(label)) for label in FIELD_LABELS[name]]
    if name != "email":
        tests += [F.contains(text, F.lit(letter)) for letter in CASE_TWINS]
    return reduce(operator.or_, tests)


def raw_match(text: Column, lowered: Column, name: str) -> Column:
    """What a field pattern finds, '' or null when it finds nothing; for an
    address the whole match, see ``field_value``."""
    group = 0 if name == "address" else 1
    return F.when(may_match(text, lowered, name), F.regexp_extract(text, FIELD_PATTERNS[name], group))


def field_value(raw: Column, name: str) -> Column:
    """Trimmed field from the column of a raw match; null when absent.

    An address may match with blanks only: present but empty. Its whole match
    tells that apart from no match, and the same pattern cuts the value out.
    """
    value = F.regexp_extract(raw, FIELD_PATTERNS[name], 1) if name == "address" else raw
    return F.when(raw != "", F.trim(value))


def field_columns(df: DataFrame, text: Column, lowered: Column,
                  names: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with the raw matches, and one expression per field (of ``names``, if given) over them.

    Two steps, because the value refers to its match more than once.
    """
    raw = {name: f"__raw_{name}" for name in FIELD_PATTERNS if names is None or name in names}
    out = compute_once(df, {column: raw_match(text, lowered, name) for name, column in raw.items()}) if raw else df
    return out, {name: field_value(F.col(column), name) for name, column in raw.items()}


def fields_map(columns: dict[str, Column]) -> Column:
    """Map of the present fields, in pattern order."""
    if not columns:
        return F.from_json(F.lit("{}"), "map<string,string>")
    entries = [part for name, col in columns.items() for part in (F.lit(name), col)]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def mask_pii(col: Column) -> Column:
    hidden = F.when(F.contains(col, F.lit("@")), F.regexp_replace(col, MASK_EMAIL, "***@$2")).otherwise(col)
    return F.when(F.contains(col, F.lit("cs_")), F.regexp_replace(hidden, MASK_KEY, "cs_***redacted***")).otherwise(hidden)


def doc_type_key(col: Column) -> Column:
    lowered = F.lower(strip(col.cast("string")))
    spaced = F.regexp_replace(lowered, r"(?U)\s+", "_")
    plain = F.regexp_replace(spaced, "[^a-z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_+|_+$", "")


def slug_base(name: Column, most: int | None = None) -> Column:
    """Lower-case letters and digits joined by single dashes, cut to ``most`` characters if given."""
    source = strip(F.when(F.coalesce(name, F.lit("")) == "", F.lit("workspace")).otherwise(name))
    dashed = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    base = F.when(trimmed == "", F.lit("workspace")).otherwise(trimmed)
    return base if most is None else F.substring(base, 1, most)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def extension(filename: Column) -> Column:
    """Lower-case suffix without its dot; '' when there is none or it is a dot file."""
    return F.lower(F.regexp_extract(basename(filename), r"(?s)^.+\.([^.]+)$", 1))


def mime_guess(filename: Column) -> Column:
    return F.try_element_at(_literal_map(MIME_TYPES), extension(filename))


def provider_mime(filename: Column, content_type: Column) -> Column:
    given = F.nullif(content_type, F.lit(""))
    guess = F.try_element_at(_literal_map(PROVIDER_MIME), extension(filename))
    return F.coalesce(given, guess, F.lit("application/octet-stream"))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])
