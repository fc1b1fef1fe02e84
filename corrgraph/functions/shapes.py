"""Closed shapes of policies, generations, projections and path trees: which members they have and what these hold.

A shape is a function of a value and its path that yields (path, what) for all it refuses. Documents of
this kind are single JSON values that a person or a tool hands over, so they are checked on the driver.
"""

from __future__ import annotations

import re
from datetime import datetime

from corrgraph.functions.canonical import stable_json

#: Patterns and words of the formats.
REFERENCE = r"[A-Za-z][A-Za-z0-9+.-]*:\S+"
RELATION = r"[a-z][a-z0-9._-]*:[a-z][a-z0-9._-]*"
DIGEST = r"sha256:[a-f0-9]{64}"
NAME = r"[A-Za-z][A-Za-z0-9._-]*"
TOKEN = r":[A-Za-z][A-Za-z0-9_]*|\*[A-Za-z][A-Za-z0-9_]*\??"
DATE_TIME = r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d(:?\d\d)?)"
DIRECTIONS = ("outgoing", "incoming")
SLOT_CARDINALITIES = ("exactly-one", "zero-or-one", "one-or-more", "many")
DELIMITERS = ("/", "--", ".")
VERSION = "1.0.0"


def text(pattern: str = r"(?s:.+)"):
    def check(value, path):
        if not isinstance(value, str) or not re.fullmatch(pattern, value):
            yield path, "is no text of its form"

    return check


def one_of(*words):
    def check(value, path):
        if not isinstance(value, str) or value not in words:
            yield path, "is none of " + ", ".join(words)

    return check


def date_time(value, path):
    try:
        good = isinstance(value, str) and re.fullmatch(DATE_TIME, value) and datetime.fromisoformat(value[:10])
    except ValueError:
        good = False
    if not good:
        yield path, "is no date and time"


def boolean(value, path):
    if not isinstance(value, bool):
        yield path, "is no boolean"


def share(value, path):
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
        yield path, "is no number from 0 to 1"


def primitive(value, path):
    if value is not None and not isinstance(value, str | int | float | bool):
        yield path, "is no primitive"


def value_of_context(value, path):
    yield from (list_of(primitive) if isinstance(value, list) else primitive)(value, path)


def json_object(value, path):
    if not isinstance(value, dict):
        yield path, "is no object"


def list_of(item, least: int = 0, distinct: bool = True):
    def check(value, path):
        if not isinstance(value, list):
            yield path, "is no array"
            return
        if len(value) < least:
            yield path, "is empty"
        for k, x in enumerate(value):
            yield from item(x, f"{path}/{k}")
        if distinct and len({stable_json(x) for x in value}) < len(value):
            yield path, "repeats an item"

    return check


def record(needs: dict, may: dict | None = None, least: int = 0):
    """An object with all of `needs`, any of `may`, no other member, and at least so many."""
    members = needs | (may or {})

    def check(value, path):
        if not isinstance(value, dict):
            yield path, "is no object"
            return
        yield from ((f"{path}/{k}", "is missing") for k in needs if k not in value)
        if len(value) < least:
            yield path, "is empty"
        for k, x in value.items():
            if k in members:
                yield from members[k](x, f"{path}/{k}")
            else:
                yield f"{path}/{k}", "is not expected"

    return check


def exactly_one(shape, *names):
    def check(value, path):
        yield from shape(value, path)
        if isinstance(value, dict) and sum(n in value for n in names) != 1:
            yield path, "has not exactly one of " + ", ".join(names)

    return check


def at_least_one(shape, *names):
    def check(value, path):
        yield from shape(value, path)
        if isinstance(value, dict) and not any(n in value for n in names):
            yield path, "has none of " + ", ".join(names)

    return check


def expression(value, path):
    """A context expression, of whichever form its members tell."""
    if not isinstance(value, dict):
        yield path, "is no expression"
        return
    nested = {"all": list_of(expression, 1, False), "any": list_of(expression, 1, False), "not": expression}
    for name, shape in nested.items():
        if name in value:
            yield from record({name: shape})(value, path)
            return
    key, operator = text(), value.get("operator")
    if operator in ("in", "not-in"):
        yield from record({"key": key, "operator": text(), "values": list_of(primitive, 1)})(value, path)
    elif operator == "exists":
        yield from record({"key": key, "operator": text()}, {"value": boolean})(value, path)
    else:
        yield from record({"key": key, "operator": one_of("equals", "not-equals"), "value": primitive})(value, path)


IDENTIFIER, WORD, VERSIONED = text(REFERENCE), text(), one_of(VERSION)
IDENTIFIERS, WORDS = list_of(IDENTIFIER), list_of(WORD, 1)
BOUND = record({"id": IDENTIFIER, "digest": text(DIGEST)})
LOCATOR = record({"uri": IDENTIFIER}, {"mediaType": WORD, "revision": WORD, "digest": WORD})
ENTITY = record({"id": IDENTIFIER, "kind": WORD}, {"label": WORD, "schema": IDENTIFIER, "locators": list_of(LOCATOR, 0, False), "attributes": json_object})
SELECTOR = record(
    {},
    {"ids": list_of(IDENTIFIER, 1), "relations": list_of(text(RELATION), 1), "sourceKinds": WORDS, "targetKinds": WORDS, "provenanceStatuses": list_of(one_of("declared", "observed", "generated", "inferred"), 1)},
    1,
)
DECLARATION = exactly_one(
    record(
        {"coverage": one_of("total", "partial"), "determinism": one_of("deterministic", "nondeterministic"), "reversibility": one_of("reversible", "irreversible")},
        {"mapping": IDENTIFIER, "select": SELECTOR, "applicability": record({}, {"when": expression, "unless": expression}, 1)},
    ),
    "mapping",
    "select",
)
POLICY = record(
    {
        "schemaVersion": VERSIONED,
        "id": IDENTIFIER,
        "graph": at_least_one(record({"id": IDENTIFIER}, {"revision": WORD, "digest": text(DIGEST)}), "revision", "digest"),
        "mappings": list_of(DECLARATION, 0, False),
        "constraints": list_of(record({"id": IDENTIFIER, "kind": text(RELATION), "subjects": list_of(IDENTIFIER, 1)}, {"parameters": json_object}), 0, False),
        "evidence": list_of(
            record(
                {"id": IDENTIFIER, "subjects": list_of(IDENTIFIER, 1), "kind": WORD, "result": one_of("supports", "contradicts", "inconclusive"), "producer": WORD},
                {"observedAt": date_time, "confidence": share, "locator": LOCATOR, "digest": WORD, "attributes": json_object},
            ),
            0,
            False,
        ),
    },
    {
        "$schema": text(r"(?s:.*)"),
        "waivers": list_of(record({"id": IDENTIFIER, "codes": WORDS, "subjects": list_of(IDENTIFIER, 1), "reason": WORD, "expiresAt": date_time, "assertedBy": WORD}), 0, False),
        "metadata": json_object,
    },
)


def context(value, path):
    yield from json_object(value, path)
    if isinstance(value, dict):
        for k, x in value.items():
            yield from value_of_context(x, f"{path}/{k}")


SEALED = {"schemaVersion": VERSIONED, "id": IDENTIFIER, "digest": text(DIGEST)}
SCHEMA = {"$schema": text(r"(?s:.*)")}
GENERATION = record(
    SEALED
    | {
        "evaluatedAt": date_time,
        "graph": record({"id": IDENTIFIER, "digest": text(DIGEST)}, {"revision": WORD}),
        "policy": BOUND,
        "context": context,
        "activeMappings": IDENTIFIERS,
        "inactiveMappings": list_of(record({"id": IDENTIFIER, "reason": one_of("when-not-satisfied", "inhibited")}), 0, False),
        "evidence": IDENTIFIERS,
        "waiversApplied": IDENTIFIERS,
    },
    SCHEMA,
)
SLOT = {"name": text(NAME), "relation": text(RELATION), "direction": one_of(*DIRECTIONS), "cardinality": one_of(*SLOT_CARDINALITIES)}
SPEC = record(
    {"schemaVersion": VERSIONED, "id": IDENTIFIER, "select": record({}, {"ids": list_of(IDENTIFIER, 1), "kinds": WORDS}, 1), "slots": list_of(record(SLOT, {"targetKinds": WORDS, "allowLossy": boolean}), 0, False)},
    SCHEMA | {"pathTree": record({}, {"attribute": text(NAME), "delimiter": one_of(*DELIMITERS)}), "metadata": json_object},
)
FILLED = record(SLOT | {"name": WORD, "mappings": IDENTIFIERS, "targets": list_of(ENTITY)})
PROJECTION = record(SEALED | {"generation": BOUND, "graph": BOUND, "spec": BOUND, "entries": list_of(record({"subject": ENTITY, "slots": list_of(FILLED, 0, False)}), 0, False)}, SCHEMA)
OCCUPANT = record({"id": IDENTIFIER, "kind": WORD, "slots": json_object}, {"label": WORD})


def node(value, path):
    """A node of a path tree, and those under it; a list of what is open keeps deep trees off the stack."""
    left = [(value, path)]
    while left:
        value, path = left.pop()
        if not isinstance(value, dict):
            yield path, "is no object"
            continue
        yield from WORD(value.get("_"), f"{path}/_")
        if "$" in value:
            yield from OCCUPANT(value["$"], f"{path}/$")
        for k, x in value.items():
            if k in ("_", "$"):
                continue
            if not k or k[0] in "_$":
                yield f"{path}/{k}", "is not expected"
            else:
                left.append((x, f"{path}/{k}"))


TREE = record(SEALED | {"projection": BOUND, "spec": BOUND, "attribute": text(NAME), "delimiter": one_of(*DELIMITERS), "params": list_of(text(TOKEN)), "tree": node}, SCHEMA)

#: Kind of document: its shape and the code of one that breaks it.
KINDS = {
    "policy": (POLICY, "INVALID_VIABILITY_POLICY"),
    "generation": (GENERATION, "INVALID_VIABLE_GENERATION"),
    "projection-spec": (SPEC, "INVALID_PROJECTION_SPEC"),
    "projection": (PROJECTION, "INVALID_PROJECTION"),
    "path-tree": (TREE, "INVALID_PATH_TREE"),
}


def findings(value, kind: str) -> list[tuple[str, str]]:
    """(code, path and what) of all that a document's shape breaks."""
    shape, code = KINDS[kind]
    return [(code, f"{path} {what}") for path, what in shape(value, "$")]
