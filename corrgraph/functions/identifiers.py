"""Identifiers, paths and types as column expressions, with plain-Python twins for the driver."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
RELATION = r"^[a-z][a-z0-9._-]*:[a-z][a-z0-9._-]*$"
PATTERN = r"[*?{}\[\]]"
AMBIGUOUS = r"(?i)\s+or\s+"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def is_reference_identifier(value) -> bool:
    return isinstance(value, str) and re.search(REFERENCE, value) is not None


def is_relation_identifier(value) -> bool:
    return isinstance(value, str) and re.search(RELATION, value) is not None


def reference_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(REFERENCE), F.lit(False))


def relation_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(RELATION), F.lit(False))


def encode_component(value: Column) -> Column:
    """Percent encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def make_urn(namespace, kind, value: Column) -> Column:
    return F.concat(F.lit("urn:"), F.lit(namespace), F.lit(":"), F.lit(kind), F.lit(":"), encode_component(value))


def urn(namespace: str, kind: str, value: str) -> str:
    return f"urn:{namespace}:{kind}:{quote(value, safe="!~*'()")}"


def repository_uri(repository: str, path: str) -> str:
    path = re.sub(r"^\./", "", path.replace("\\", "/"))
    return f"repo://{repository}/" + "/".join(quote(p, safe="!~*'()") for p in path.split("/"))


def repository_uris(repository: str, path: Column) -> Column:
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.concat(F.lit(f"repo://{repository}/"), F.array_join(F.transform(F.split(plain, "/"), encode_component), "/"))


def has_ambiguous_language(path: Column) -> Column:
    return path.rlike(AMBIGUOUS)


def is_path_pattern(path: Column) -> Column:
    return path.rlike(PATTERN)


def symbolic_type(value: Column) -> Column:
    """A type name without its prefix, a trailing `schema`, and anything but letters and digits, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(value, "^(reference|enum):", ""), "(?i)schema$", "")
    return F.lower(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))


def types_compatible(a: Column, b: Column) -> Column:
    symbolic = lambda x: x.rlike("^(reference|enum):")
    return F.coalesce(a.eqNullSafe(b) | (symbolic(a) & symbolic(b) & (symbolic_type(a) == symbolic_type(b))), F.lit(False))


def is_date_time(value: Column) -> Column:
    """A full date-time with zone that also parses; the pattern is needed, as parsing takes bare dates too."""
    return F.coalesce(value.rlike(DATE_TIME) & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def segment_kind(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^\[\[\.\.\.[^\]]+\]\]$"), "optional-catch-all")
        .when(segment.rlike(r"^\[\.\.\.[^\]]+\]$"), "catch-all")
        .when(segment.rlike(r"^\[[^\]]+\]$"), "dynamic")
        .when(segment.startswith("@"), "parallel")
        .when(segment.rlike(r"^\((\.|\.\.|\.\.\.)\)") | segment.rlike(r"^\(\.\.\)\(\.\.\)"), "intercepted")
        .when(segment.rlike(r"^\([^)]+\)$"), "group")
        .otherwise("static")
    )


def url_segment(segment: Column) -> Column:
    """The segment as it stands in a URL; null for groups and slots."""
    kind = segment_kind(segment)
    return (
        F.when(kind.isin("group", "parallel"), F.lit(None).cast("string"))
        .when(kind == "optional-catch-all", F.concat(F.lit("*"), F.regexp_extract(segment, r"^\[\[\.\.\.([^\]]+)\]\]$", 1), F.lit("?")))
        .when(kind == "catch-all", F.concat(F.lit("*"), F.regexp_extract(segment, r"^\[\.\.\.([^\]]+)\]$", 1)))
        .when(kind == "dynamic", F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[([^\]]+)\]$", 1)))
        .otherwise(segment)
    )


def route_path(directory: Column) -> Column:
    parts = F.filter(F.transform(F.filter(F.split(directory, "/"), lambda s: s != ""), url_segment), lambda s: s.isNotNull())
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def parameter_name(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "^[:*]", ""), r"\?$", "")


def escape_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
