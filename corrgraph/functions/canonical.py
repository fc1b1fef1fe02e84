"""Canonical JSON and content digests, on the driver for documents and as columns for records."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of the root collation for ASCII: punctuation, then digits, then letters.
PUNCTUATION = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
RANK = {c: k for k, c in enumerate(PUNCTUATION)} | {c: 100 + k for k, c in enumerate("0123456789")}


def collation_key(text: str) -> tuple:
    """Sorts as the root collation does: letters without case first, then lower case before upper."""
    primary = [RANK.get(c, 200 + ord(c.lower()[:1] or c) if not c.isspace() else -1) for c in text]
    return primary, [c.isupper() for c in text], text


def number_text(value: float) -> str:
    """A double as JavaScript prints it."""
    if isinstance(value, int):
        return str(value)
    if math.isnan(value) or math.isinf(value):
        return "null"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        mantissa, exponent = text.split("e")
        if -7 < int(exponent) < 0:
            return f"{value:.{max(0, len(mantissa.replace('.', '').lstrip('-')) - 1 - int(exponent))}f}"
        return f"{mantissa}e{'+' if int(exponent) > 0 else '-'}{abs(int(exponent))}"
    return text


def _key_order(key: str):
    """Integer-like keys first, as numbers; the others in collation order."""
    whole = key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1
    return (0, int(key), ()) if whole else (1, 0, collation_key(key))


def compact(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(value[k])}" for k in sorted(value, key=_key_order)) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number_text(value)


def stable_json(value) -> str:
    return compact(value) + "\n"


def content_digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def value_digest(value) -> str:
    return content_digest(stable_json(value))


def values_equal(a, b) -> bool:
    return stable_json(a) == stable_json(b)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_json(**columns: Column) -> Column:
    """Canonical JSON of a flat record, absent members (null) left out."""
    names = sorted(columns, key=_key_order)
    return F.concat(F.to_json(F.struct(*[columns[n].alias(n) for n in names])), F.lit("\n"))
