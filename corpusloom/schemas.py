"""Schemas of the tables; they are fixed and checked, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The column names and order of the control tables.
UNIVERSE = strings("ticker", "cik", "company_name")
MANIFEST = strings("cik", "ticker", "accession", "form", "filing_date", "period_of_report", "doc_type", "exhibit_label", "document", "doc_url")
LEGACY_MANIFEST = strings("cik", "ticker", "accession", "form", "filing_date", "period_of_report", "primary_doc_url")
FETCHED = strings("accession", "document", "doc_type", "path", "status", "bytes", "content_type", "sha256", "fetched_at")
LEGACY_FETCHED = strings("accession", "path", "status", "bytes", "content_type", "sha256", "fetched_at")
PARSED = strings("accession", "document", "doc_sha256", "config_fingerprint", "chunks", "path", "parsed_at")

_INT, _TEXT = T.IntegerType(), T.StringType()
_SPAN = T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)])
_NOT_TEXT = {"chunk_ordinal": _INT, "n_tokens": _INT, "char_span": _SPAN, "member": _INT}


def _typed(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _NOT_TEXT.get(n, _TEXT)) for n in names])


CHUNK = _typed("cik", "ticker", "accession", "form", "filing_date", "period", "section", "chunk_ordinal", "chunk_id", "text", "n_tokens", "char_span", "doc_type", "document", "exhibit_label")
TRUTH = _typed("qid", "member", "ticker", "accession", "document", "section", "quote", "key_status")
ENTRY = _typed("qid", "type", "status", "question")
HIT = ["rank", "score", "row", "chunk_id", "ticker", "accession", "document", "doc_type", "section", "form", "filing_date", "text"]


def check_header(found: list[str], wanted: T.StructType, where: str) -> None:
    if list(found) != wanted.fieldNames():
        raise ValueError(f"{where} has the columns {list(found)}, expected are {wanted.fieldNames()}")


def conform(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Columns of ``df`` in the schema's order and types; a missing one is an error."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in wanted])
