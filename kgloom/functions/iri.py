"""IRIs: namespaces, templates, percent-encoding and prefix rewriting, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and the prefix table, in order of precedence.
SPHN = "https://biomedit.ch/rdf/sphn-schema/sphn#"
LOCAL = "http://example.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RDFS_RANGE = "http://www.w3.org/2000/01/rdf-schema#range"
SKOS_ALT = "http://www.w3.org/2004/02/skos/core#altLabel"
SKOS_PREF = "http://www.w3.org/2004/02/skos/core#prefLabel"
ALIGN_NAMESPACE = "http://example.org/sphn#"
PREFIXES = (
    ("http://example.org/Code/icd9#", "icd9#"),
    ("http://example.org/Code/loinc#", "loinc#"),
    ("http://snomed.info/id/", "snomed#"),
    ("http://example.org/Diagnosis/", "Diagnosis/"),
    ("http://example.org/LabResult/", "LabResult/"),
    ("http://example.org/LabTestEvent/", "LabTestEvent/"),
    ("http://example.org/LabTest/", "LabTest/"),
    ("http://example.org/PATIENTS/", "PATIENTS/"),
    ("http://example.org/", ""),
)


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def local(*parts) -> Column:
    """LOCAL followed by the parts joined by slashes."""
    return F.concat(F.lit(LOCAL), F.concat_ws("/", *[_text(p) for p in parts]))


def coded(system: str, code: Column) -> Column:
    """The IRI of a code in a system, as `.../Code/system#code`."""
    return F.concat(F.lit(f"{LOCAL}Code/{system}#"), code)


def quoted(value: Column) -> Column:
    """A value as an IRI segment: UTF-8 percent-encoded but for letters, digits and `-._~`; null is NA."""
    out = F.url_encode(value.cast("string"))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(out, F.lit("NA"))


def rewrite(uri: Column, prefixes=PREFIXES) -> Column:
    """The first prefix of the table that the IRI starts with, replaced once; any other IRI as it is."""
    out = None
    for prefix, short in prefixes:
        hit, value = uri.startswith(prefix), F.concat(F.lit(short), F.substr(uri, F.lit(len(prefix) + 1)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(uri)


def rewrite_type(uri: Column) -> Column:
    """Schema classes by their local name, others by the prefix table."""
    return F.when(uri.startswith(SPHN), F.replace(uri, F.lit(SPHN), F.lit(""))).otherwise(rewrite(uri))


def rewrite_predicate(uri: Column) -> Column:
    """rdf:type in full, schema predicates by their local name, others by the prefix table."""
    return F.when(uri == RDF_TYPE, uri).otherwise(rewrite_type(uri))


def rewrite_object(p: Column, o: Column, o_kind: Column) -> Column:
    """Types by rewrite_type, IRIs by the prefix table, anything else in double quotes."""
    return F.when(p == RDF_TYPE, rewrite_type(o)).when(o_kind == "uri", rewrite(o)).otherwise(F.concat(F.lit('"'), o, F.lit('"')))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def concept_id(uri: Column) -> Column:
    """Digits of an IRI that ends in /id/<digits>, else null."""
    return _found(uri, r"/id/(\d+)$")


def icd_code(raw: Column) -> Column:
    """What follows a leading icd9# or icd10# in any case, else null (full IRIs too)."""
    return _found(raw, r"(?i)^(?:icd9#|icd10#)(.*)")


def icd9_of(uri: Column) -> Column:
    """What follows icd9# anywhere in an IRI, else null."""
    return _found(uri, r"icd9#(.*)$")


def trailing_number(uri: Column) -> Column:
    return _found(uri, r"/(\d+)$")


def bare(term: Column) -> Column:
    """A term without angle brackets at its ends."""
    return F.regexp_replace(term, r"^[<>]+|[<>]+$", "")
