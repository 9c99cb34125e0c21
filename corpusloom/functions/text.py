"""Scalar functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a lexical token keeps inner points and commas and a trailing per-cent sign.
TOKEN = r"[a-z0-9]+(?:[.,][a-z0-9]+)*%?"
#: Unicode white space; Java's class lacks the four separators at the end.
BLANK = r"[\s\x1c-\x1f]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends: the form quotes are compared in."""
    return F.trim(F.regexp_replace(text, f"(?U){BLANK}+", " "))


def null_if_blank(text: Column) -> Column:
    stripped = strip(text.cast("string"))
    return F.when(stripped != "", stripped)


def cik10(value: Column) -> Column:
    """Ten digits, zero-padded; anything but digits after the prefix is an error."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.upper(strip(value.cast("string"))), "^CIK", ""), "^-+", ""))
    padded = F.when(F.length(bare) >= 10, bare).otherwise(F.lpad(bare, 10, "0"))
    return F.when(bare.rlike("^[0-9]+$"), padded).otherwise(F.raise_error(F.concat(F.lit("not a CIK: "), F.coalesce(value.cast("string"), F.lit("null")))))


def accession_bare(accession: Column) -> Column:
    return F.trim(F.replace(accession.cast("string"), F.lit("-"), F.lit("")))


def accession_dashed(accession: Column) -> Column:
    bare = accession_bare(accession)
    dashed = F.concat_ws("-", F.substring(bare, 1, 10), F.substring(bare, 11, 2), F.substring(bare, 13, 6))
    return F.when(bare.rlike("^[0-9]{18}$"), dashed).otherwise(F.raise_error(F.concat(F.lit("not an 18-digit accession number: "), F.coalesce(accession.cast("string"), F.lit("null")))))


def document_url(archives: str, cik: Column, accession: Column, document: Column) -> Column:
    """The archive's paths have the CIK without padding."""
    return F.concat(F.lit(archives.rstrip("/") + "/edgar/data/"), cik10(cik).cast("long").cast("string"), F.lit("/"), accession_bare(accession), F.lit("/"), F.regexp_replace(document, "^/+", ""))


def index_headers_url(archives: str, cik: Column, accession: Column) -> Column:
    return document_url(archives, cik, accession, F.concat(accession_dashed(accession), F.lit("-index-headers.html")))


def stored_name(accession: Column, doc_type: Column, document: Column, extension: Column) -> Column:
    """File name of a fetched document; an exhibit's keeps a safe form of its own name."""
    base = F.element_at(F.split(F.replace(F.coalesce(document, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).otherwise(base)
    stem = F.when(stem == "", F.lit("exhibit")).otherwise(stem)
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    safe = F.when(safe == "", F.lit("exhibit")).otherwise(safe)
    tail = F.when(doc_type == "primary", F.lit("")).otherwise(F.concat(F.lit("-"), safe))
    return F.concat(accession_bare(accession), tail, extension)


def stored_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension_of(content_type: Column) -> Column:
    return F.when(F.lower(content_type).contains("plain"), F.lit(".txt")).otherwise(F.lit(".html"))


def allowed_type(content_type: Column, allowed: list[str]) -> Column:
    """Media types of the list pass, and so does an absent one."""
    bare = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (bare == "") | bare.isin([x.lower() for x in allowed])


def iso_date(text: Column) -> Column:
    """Date of strict ISO text, null for anything else."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def exhibit_label(doc_type: Column) -> Column:
    return F.replace(F.upper(F.coalesce(doc_type, F.lit(""))), F.lit("EX-"), F.lit(""))


def is_exhibit_type(doc_type: Column, prefixes: list[str]) -> Column:
    kind, wanted = F.upper(F.trim(doc_type)), [p.strip().upper() for p in prefixes if p.strip()]
    found = F.lit(False)
    for p in wanted:
        found = found | kind.startswith(p)
    return F.coalesce(found, F.lit(False))


def label_present(label: Column, present: Column) -> Column:
    """A label with no sub-number is met by any of its series."""
    series = F.exists(present, lambda p: p.startswith(F.concat(label, F.lit("."))))
    return F.array_contains(present, label) | (~F.contains(label, F.lit(".")) & series)


def chunk_id(accession: Column, document: Column, ordinal: Column) -> Column:
    return F.concat(accession, F.lit(":"), F.coalesce(document, F.lit("")), F.lit(":"), F.format_string("%05d", ordinal))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def is_unit(vector: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(dot(vector, vector) - 1) <= 2 * tolerance


def starts_with_foreign(text: Column, prefixes: list[str]) -> Column:
    """Whether a text already carries another provider's prompt prefix."""
    bare = F.regexp_replace(text, f"(?U)^{BLANK}+", "")
    found = F.lit(False)
    for p in prefixes:
        found = found | bare.startswith(p)
    return found


def refuse_foreign(text: Column, prefixes: list[str]) -> Column:
    """The text itself; one that carries another provider's prompt prefix stops the job, with its beginning."""
    return F.when(starts_with_foreign(text, prefixes), F.raise_error(F.concat(F.lit("text with a foreign prompt prefix: "), F.left(text, F.lit(40))))).otherwise(text)
