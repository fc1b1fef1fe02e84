"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Patterns find assignments, access keys and long hexadecimal runs. The novelty test measures every
candidate in a sensitive context: its surroundings and the candidate are compressed after a dictionary of
code and identifiers, and the bytes that the candidate adds are its novelty. Identifiers and words add
little; random strings add about a byte a character, and are reported as kind `novel`.

A candidate is a run of CANDIDATE characters or more from the alphabets of keys that is no plain word:
it has a digit and a letter, or changes between capitals and small letters more often than every fourth
character. Its context is sensitive if a sensitive word stands in it, or ends at most REACH characters
before it, or begins at most REACH characters after it. Its surroundings are the CONTEXT characters on
either side, so a text takes time in proportion to its length, whatever stands in it.

Spans are counted in code points, end exclusive. Only rows flow through: nothing is shuffled.

Defined results: null and empty texts have no spans; other columns are not read; rows that repeat an id
are judged one by one, and ids may be of any type; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import documents, lean

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the matches of [0-9a-f]+ that have 32 characters or more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(r"(?i:secret|token|passw|api[_-]?key|credential|private[_-]?key|bearer|auth[_-]?key|signature|access[_-]?key|client[_-]?id)", re.A)
SENSITIVE_WORDS = ("secret", "token", "passw", "key", "credential", "bearer", "signature", "client")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
TURNS = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")
#: How far from a token a sensitive word counts, and the context on each side that is compressed with it.
REACH, CONTEXT = 48, 256
#: Bytes that a token must add for each of its characters.
NOVELTY = 0.7
#: Code and identifiers that prime the compressor, apart from the alphabet and digits.
CODE = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx ****************
import os import sys from public static void main String args function return const let var class struct interface
def __init__(self, name, value): if not isinstance(value, str): raise ValueError for key, value in items(): print(
your_api_key_here your-access-token-here changeme example placeholder REPLACE_ME password_hash token_expiration
access_token refresh_token client_secret client_id api_key private_key public_key secret_key session_token
authorization_endpoint authentication_required get_access_token set_password validate_credentials user_password
database_connection_string configuration application environment production development localhost
https://www.example.com/index.html http://api.example.com/v1/users content-type application/json
getElementById addEventListener removeEventListener createElement setAttribute toString valueOf hasOwnProperty
SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE PRIMARY KEY
the of and to in is that it for was on are with as his they at be this from have or by one had not but what all
"""


@functools.lru_cache(1)
def compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(CODE.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)


def novelty(token: str, before: str = "", after: str = "") -> float:
    """Compressed bytes that the token adds to its surroundings, for each of its characters."""
    size = lambda s: len(compressor().compress(s.encode("utf-8", "replace")))
    around = before + after
    return (size(around + "\n" + token) - size(around + "\n")) / max(1, len(token))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(kind's place, start, end, kind) of the fixed patterns."""
    out, low = [], text.lower()
    if any(map(low.__contains__, ASSIGN_WORDS)):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def plain(token: str) -> bool:
    """Whether a token is left alone as a word or an identifier."""
    return not MIXED.match(token) and len(TURNS.findall(token)) * 4 < len(token)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that the primed compressor cannot shorten, apart from base spans."""
    low = text.lower()
    if not any(map(low.__contains__, SENSITIVE_WORDS)):
        return []
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out, at, reached = [], 0, -1  # base spans that begin before the candidate's end, and how far they go
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reached = max(reached, base[at][2])
            at += 1
        if reached > a or plain(m[0]):
            continue
        k = bisect.bisect_left(ends, a - REACH)  # the first word that ends late enough
        if k == len(words) or starts[k] > b + REACH:
            continue
        if novelty(m[0], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]) >= NOVELTY:
            out.append((a, 3, b))
    return out


def scan(text: str) -> tuple:
    base = base_spans(text)
    join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *n, hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + novel_spans(text, base)))


def scan_batches(batches):
    import pyarrow as pa

    for batch in batches:
        found = [scan(t.as_py() or "") for t in batch.column(1)]
        columns = [pa.array([x[k] for x in found], pa.int64() if k < 3 else pa.string()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of every row of df."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = dict(df.dtypes)[id_col]
    return rows.mapInArrow(lean(scan_batches), f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("_id", id_col)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
