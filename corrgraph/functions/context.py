"""Context expressions: evaluated on the driver for one context, or as a column for a context per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMITIVES = (str, int, float, bool, type(None))


def parse_context(value) -> dict:
    """A flat object of primitives and arrays of them; anything else raises."""
    if not isinstance(value, dict):
        raise ValueError("a context is an object")
    for k, v in value.items():
        if not k or not (isinstance(v, PRIMITIVES) or (isinstance(v, list) and all(isinstance(x, PRIMITIVES) for x in v))):
            raise ValueError(f"context key {k!r} is empty or nested")
    return value


def same(a, b) -> bool:
    """Equal values of one type; numbers are one type, booleans another."""
    kind = lambda x: "b" if isinstance(x, bool) else "n" if isinstance(x, int | float) else type(x).__name__
    return kind(a) == kind(b) and a == b


def evaluate(expression: dict, context: dict) -> bool:
    """Whether an expression holds. A missing key fails every operator, negated ones too."""
    if "all" in expression:
        return all(evaluate(e, context) for e in expression["all"])
    if "any" in expression:
        return any(evaluate(e, context) for e in expression["any"])
    if "not" in expression:
        return not evaluate(expression["not"], context)
    key, operator = expression["key"], expression["operator"]
    if operator == "exists":
        return (key in context) == expression.get("value", True)
    if key not in context:
        return False
    held = context[key] if isinstance(context[key], list) else [context[key]]
    asked = expression["values"] if operator in ("in", "not-in") else [expression["value"]]
    found = any(same(h, a) for h in held for a in asked)
    return not found if operator in ("not-in", "not-equals") else found


def required_keys(expression: dict | None) -> set[str]:
    """Keys whose value an expression needs; `exists` needs none."""
    if not expression:
        return set()
    for k in ("all", "any"):
        if k in expression:
            return set().union(*map(required_keys, expression[k])) if expression[k] else set()
    if "not" in expression:
        return required_keys(expression["not"])
    return set() if expression["operator"] == "exists" else {expression["key"]}


def inactive_reason(applicability: dict | None, context: dict) -> str | None:
    """None if active."""
    applicability = applicability or {}
    if "when" in applicability and not evaluate(applicability["when"], context):
        return "when-not-satisfied"
    if "unless" in applicability and evaluate(applicability["unless"], context):
        return "inhibited"
    return None


def as_column(expression: dict, context: Column) -> Column:
    """The expression over a column of type map<string, string>, for a context in each row."""
    if "all" in expression:
        return _fold(expression["all"], context, lambda a, b: a & b, True)
    if "any" in expression:
        return _fold(expression["any"], context, lambda a, b: a | b, False)
    if "not" in expression:
        return ~as_column(expression["not"], context)
    there = F.map_contains_key(context, expression["key"])
    if expression["operator"] == "exists":
        return there if expression.get("value", True) else ~there
    asked = expression["values"] if expression["operator"] in ("in", "not-in") else [expression["value"]]
    found = F.coalesce(F.element_at(context, expression["key"]).isin([str(a) for a in asked]), F.lit(False))
    return there & (~found if expression["operator"] in ("not-in", "not-equals") else found)


def _fold(parts, context, join, start):
    out = F.lit(start)
    for p in parts:
        out = join(out, as_column(p, context))
    return out
