"""Path trees: validated paths, their prefixes as nodes, occupants, parameters and hydration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgraph.functions.identifiers import parameter_name
from corrgraph.operators.issues import union

#: The grammar of paths.
SEGMENT = r"^(?:[A-Za-z0-9._~-]+|:[A-Za-z][A-Za-z0-9_]*|\*[A-Za-z][A-Za-z0-9_]*\??)$"
PARAMETER = r"^(?::[A-Za-z][A-Za-z0-9_]*|\*[A-Za-z][A-Za-z0-9_]*\??)$"
TOKEN = re.compile(r"\*[A-Za-z][A-Za-z0-9_]*\?|:[A-Za-z][A-Za-z0-9_]*|\*[A-Za-z][A-Za-z0-9_]*")
RESERVED = ("_", "$")


def segments(path: Column, delimiter: str = "/") -> Column:
    """The segments of a path; none for the root."""
    return F.when(path == delimiter, F.array().cast("array<string>")).otherwise(F.split(F.substring(path, len(delimiter) + 1, 1 << 30), re.escape(delimiter), -1))


def path_code(path: Column, delimiter: str = "/") -> Column:
    """The issue code of a path, or null if it is sound."""
    parts = segments(path, delimiter)
    first_bad = F.get(F.filter(parts, lambda s: s.isin(*RESERVED) | ~s.rlike(SEGMENT)), F.lit(0))
    bad_end = path.endswith("/") if delimiter == "/" else F.lit(False)
    return (
        F.when(path.isNull() | (path == ""), "PATH_TREE_PATH_MISSING")
        .when(path == delimiter, F.lit(None).cast("string"))
        .when(~path.startswith(delimiter) | bad_end, "PATH_TREE_INVALID_PATH")
        .when(F.exists(parts, lambda s: s == ""), "PATH_TREE_INVALID_PATH")
        .when(first_bad.isin(*RESERVED), "PATH_TREE_RESERVED_SEGMENT")
        .when(first_bad.isNotNull(), "PATH_TREE_INVALID_PATH")
    )


def occupied(rows: DataFrame, delimiter: str = "/") -> tuple[DataFrame, DataFrame]:
    """(path, occupant) with the first subject by id on each path, and the issues (code, subject_id, path).

    rows: (subject, path).
    """
    told = rows.withColumn("code", path_code(F.col("path"), delimiter))
    sound = told.filter("code IS NULL")
    first = sound.groupBy("path").agg(F.min("subject").alias("occupant"))
    clash = sound.join(first, "path").filter("subject <> occupant").select(F.lit("PATH_TREE_COLLISION").alias("code"), F.col("subject").alias("subject_id"), "path")
    return first, union([told.filter("code IS NOT NULL").select("code", F.col("subject").alias("subject_id"), "path"), clash])


def nodes(first: DataFrame, delimiter: str = "/") -> DataFrame:
    """(path, parent_path, segment, depth, occupant): every prefix of an occupied path, the root included.

    Prefixes are exploded within the row and made distinct by hash: a trie without walking one.
    """
    parts = segments(F.col("path"), delimiter)
    join = lambda xs: F.concat(F.lit(delimiter), F.array_join(xs, delimiter))
    prefix = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(join(F.slice("parts", 1, i)).alias("path"), F.when(i > 0, join(F.slice("parts", 1, i - 1))).alias("parent_path"), F.get("parts", i - 1).alias("segment"), i.alias("depth")))
    found = first.select(parts.alias("parts")).select(F.explode(prefix).alias("x")).select("x.*").distinct()
    return found.join(first, "path", "left").select("path", "parent_path", F.when(F.col("depth") > 0, F.col("segment")).alias("segment"), F.col("depth").cast("int").alias("depth"), "occupant")


def parameters(first: DataFrame, delimiter: str = "/") -> DataFrame:
    """(token, name) of the parameters in occupied paths."""
    tokens = first.select(F.explode(segments(F.col("path"), delimiter)).alias("token")).filter(F.col("token").rlike(PARAMETER)).distinct()
    return tokens.select("token", parameter_name(F.col("token")).alias("name"))


class HydrationError(ValueError):
    pass


def unsafe(value: str, delimiter: str, token: str) -> bool:
    return not value or bool(re.search(r"\s|[?#]", value)) or (delimiter != "/" and delimiter in value) or (not token.startswith("*") and "/" in value)


def hydrate_path(path: str, values: dict[str, str], delimiter: str = "/") -> str:
    """The path with its tokens replaced, longest first; an optional one may be left out."""
    for token in sorted(set(TOKEN.findall(path)), key=len, reverse=True):
        name = token.lstrip(":*").removesuffix("?")
        value = values.get(token, values.get(name))
        if value is None:
            if not (token.startswith("*") and token.endswith("?")):
                raise HydrationError(f"no value for {token}")
            path = path.replace(token, "")
            continue
        if unsafe(value, delimiter, token):
            raise HydrationError(f"unsafe value for {token}")
        path = path.replace(token, value)
    if delimiter == "/":
        path = re.sub(r"/{2,}", "/", path)
        return path[:-1] if len(path) > 1 and path.endswith("/") else path or delimiter
    parts = [p for p in path.split(delimiter) if p]
    return delimiter + delimiter.join(parts) if parts else delimiter


def hydrate(tree: DataFrame, values: dict[str, str], delimiter: str = "/") -> DataFrame:
    """The nodes with hydrated paths. All tokens but optional ones need a value, wherever they occur."""
    found = parameters(tree.filter("occupant IS NOT NULL").select("path"), delimiter)
    given = {}
    for token in sorted((r.token for r in found.collect()), key=len, reverse=True):  # a row a parameter, not a node
        hydrate_path(token, values, delimiter)
        name = token.lstrip(":*").removesuffix("?")
        given[token] = values.get(token, values.get(name)) or ""

    def filled(path: Column) -> Column:
        """hydrate_path() in the JVM: a segment that is a token is replaced, and empty ones go."""
        parts = F.transform(segments(path, delimiter), lambda s: F.coalesce(F.try_element_at(table, s), s)) if given else segments(path, delimiter)
        whole = F.concat(F.lit(delimiter), F.array_join(F.filter(parts, lambda s: s != ""), delimiter))
        if delimiter != "/":
            return whole
        whole = F.regexp_replace(whole, "/{2,}", "/")
        return F.when(whole == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))

    table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else None
    return tree.select(*[filled(F.col(c)).alias(c) if c in ("path", "parent_path") else F.col(c) for c in tree.columns])


def as_document(tree: DataFrame, slots: dict | None = None) -> dict:
    """The nested object that a path tree is written as. For trees that fit the driver, as routes do."""
    rows = sorted(tree.collect(), key=lambda r: r.depth)
    made: dict = {}
    for r in rows:
        node = {"_": r.path} | ({"$": {"id": r.occupant, **((slots or {}).get(r.occupant, {}))}} if r.occupant else {})
        made[r.path] = node
        if r.parent_path is not None:
            made[r.parent_path][r.segment] = node
    return made[rows[0].path] if rows else {}
