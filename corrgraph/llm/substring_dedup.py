"""Substring deduplication by hashing units of lines.

A unit is a line, a paragraph (lines up to a blank one) or, as op2 takes it, a sentence of a line. Units
are normalised (lower case, white space made one blank) and hashed to 128 bits. The earliest occurrence
of a digest, by (id, start), is kept; every later one is a repeat. Repeats that follow each other in a
document form a run. A run is removed if it has `least` words or more in units of `least_unit` words or
more, or if units of any length that follow each other in it, and in the same order in an earlier
document, have as many: short phrases that recur by chance stay, and so do strings of them that no other
document has in their order. With `least` 0 every repeat is removed, whatever its length.

For the second test each unit also carries a digest of its string: the units from it on until they have
`least` words. Strings that the first test decides carry none.

Digests above HEAVY_SHARE of all units are found with a Misra-Gries sketch, verified by one exact
aggregate and broadcast (at most 1 / HEAVY_SHARE of them), so that common lines are decided where they
lie; all others are dealt by digest once, and no group of those exceeds HEAVY_SHARE of the units.

Defined results: null and empty texts have no units and stay as they are (null gives an empty text);
rows that repeat an id, or have none, are documents of their own, in the order of a hash of their texts,
those without an id last; removed spans are offsets in the original text; an empty table gives an empty
result; columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgraph.llm.common import ROW, documents, lean, save, text_of, unique_ids, with_row_key

MIN_RUN_WORDS = 20
MIN_UNIT_WORDS = 4
HEAVY_SHARE = 0.001
#: What a unit is.
UNITS = {
    "sentence": re.compile(r"\S(?:[^\n]*?[.!?](?=\s|$)|[^\n]*)"),
    "line": re.compile(r"[^\s][^\n]*"),
    "paragraph": re.compile(r"\S(?:.|\n(?![^\S\n]*\n))*"),
}


def units_of(text: str, unit: str = "sentence") -> list[tuple[int, int, int, int, int]]:
    """(start, end, words, two halves of the digest) of each unit."""
    out = []
    for m in UNITS[unit].finditer(text):
        words = m[0].lower().split()
        digest = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "replace"))
        out.append((m.start(), m.end(), len(words), (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
    return out


def strings_of(units: list, least: int, least_unit: int = MIN_UNIT_WORDS) -> list[tuple[int | None, int | None]]:
    """Two halves of the digest of each unit's string: the units from it on, until they have `least` words.

    None where too few follow, and where units of `least_unit` words have as many by themselves.
    """
    if not least:
        return [(None, None)] * len(units)
    digests = np.array([u[3:] for u in units], np.int64).tobytes()
    out, j, words, long = [], 0, 0, 0
    for i, u in enumerate(units):
        while j < len(units) and words < least:
            words += units[j][2]
            long += units[j][2] if units[j][2] >= least_unit else 0
            j += 1
        if words < least or long >= least:
            out.append((None, None))
        else:
            digest = xxhash.xxh3_128_intdigest(digests[16 * i : 16 * j])
            out.append(((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
        words -= u[2]
        long -= u[2] if u[2] >= least_unit else 0
    return out


def unit_batches(least: int, least_unit: int, unit: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, ids, rows = batch.slice(i, 512), [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = units_of(t, unit)
                    ids += [d] * len(found)
                    rows += [(k, *u, *s) for k, (u, s) in enumerate(zip(found, strings_of(found, least, least_unit), strict=True))]
                columns = [pa.array([r[k] for r in rows], pa.int64() if k >= 4 else pa.int32()) for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), *columns], names=["_id", "_nth", "_start", "_end", "_words", "_high", "_low", "_string_high", "_string_low"])

    return run


def repeats(units: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The units that are not the first of their digest, with the id of the first."""
    total = units.count()
    candidates = units.stat.freqItems(["_high"], share).select(F.explode("_high_freqItems").alias("_high"))
    heavy = save(
        units.join(F.broadcast(candidates), "_high", "left_semi")
        .groupBy("_high", "_low")
        .agg(F.min(F.struct("_id", "_start")).alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > share * total)
        .select("_high", "_low", F.col("_first._id").alias("_of"), F.col("_first._start").alias("_at")),
        "heavy",
    )
    near = units.join(F.broadcast(heavy), ["_high", "_low"])
    order = Window.partitionBy("_high", "_low").orderBy("_id", "_start")
    rest = units.join(F.broadcast(heavy), ["_high", "_low"], "left_anti")
    rest = rest.withColumn("_of", F.first("_id").over(order)).withColumn("_at", F.first("_start").over(order))
    again = ~(F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_start") == F.col("_at")))
    return near.unionByName(rest).filter(again).select("_id", "_nth", "_start", "_end", "_words", "_of")


def repeated_strings(units: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(_id, _nth, _of) of the units whose string an earlier document has: the id of the first of those.

    Heavy strings are found as heavy digests are. Their rows know their first from the broadcast and are
    spread over parts, so that no group of the window exceeds HEAVY_SHARE of the strings.
    """
    key = ["_string_high", "_string_low"]
    strings = units.filter("_string_high IS NOT NULL").select("_id", "_nth", *key)
    total = strings.count()
    candidates = strings.stat.freqItems(["_string_high"], share).select(F.explode("_string_high_freqItems").alias("_string_high"))
    own = F.struct("_id")  # as min passes over null
    heavy = save(
        strings.join(F.broadcast(candidates), "_string_high", "left_semi").groupBy(*key).agg(F.min(own).alias("_told"), F.count("*").alias("_n")).filter(F.col("_n") > share * total).drop("_n"),
        "heavy_strings",
    )
    told = strings.join(F.broadcast(heavy), key, "left").withColumn("_part", F.when(F.col("_told").isNotNull(), F.pmod(F.xxhash64("_id", "_nth"), F.lit(math.ceil(1 / share)))))
    told = told.withColumn("_first", F.coalesce("_told", F.min(own).over(Window.partitionBy(*key, "_part"))))
    return told.filter(own != F.col("_first")).select("_id", "_nth", F.col("_first._id").alias("_of"))


def runs(found: list, least: int, least_unit: int = MIN_UNIT_WORDS) -> list[tuple[int, int, int, int, list]]:
    """(first unit's start, last unit's end, units, words, ids of the first occurrences) of the runs to remove.

    Rows of found without a start are repeated strings; all units of one are repeats.
    """
    out, now = [], []
    strings = {u["_nth"]: u["_of"] for u in found if u["_start"] is None}
    for u in [*sorted((u for u in found if u["_start"] is not None), key=lambda u: (u["_nth"], u["_start"])), None]:
        if now and (u is None or u["_nth"] > now[-1]["_nth"] + 1):
            ordered = [strings[x["_nth"]] for x in now if x["_nth"] in strings]
            if ordered or sum(x["_words"] for x in now if x["_words"] >= least_unit) >= least:
                out.append((now[0]["_start"], now[-1]["_end"], len(now), sum(x["_words"] for x in now), [x["_of"] for x in now] + ordered))
            now = []
        if u is not None and not (now and u["_nth"] == now[-1]["_nth"]):
            now.append(u)
    return out


def cut_batches(least: int, least_unit: int):
    """A function for mapInArrow over (_id, _text, _found): the text without its repeated runs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    gone = runs(found or [], least, least_unit)
                    kept, at = [], 0
                    for a, b, *_ in gone:
                        kept.append((at, a))
                        at = b + len(text[b:]) - len(text[b:].lstrip()) if b < len(text) else b
                    kept = [(a, b) for a, b in [*kept, (at, len(text))] if a < b]
                    join = lambda spans: ",".join(f"{x[0]}:{x[1]}" for x in spans)
                    rows.append((sum(x[2] for x in gone), sum(x[3] for x in gone), join(gone), join(kept), sorted({d for x in gone for d in x[4] if d is not None}), "".join(text[a:b] for a, b in kept)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(part.column(0).type), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["_id", "n_removed", "removed_words", "removed_spans", "kept_spans", "first_docs", "text"])

    return run


def drop_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_RUN_WORDS, least_unit: int = MIN_UNIT_WORDS, unit: str = "sentence") -> DataFrame:
    """id, n_removed (units), removed_words, removed_spans, kept_spans, first_docs, text of every row of df."""
    kind = dict(df.dtypes)[id_col]
    if kind == "bigint" and unique_ids(df, id_col):
        return cut_repeats(df, id_col, text_col, least, least_unit, unit).withColumnRenamed("_id", id_col)
    rows = with_row_key(df.select(F.col(f"`{id_col}`").alias("_own"), text_of(text_col).alias("_text")), "_own", "_text")
    out = save(cut_repeats(rows, ROW, "_text", least, least_unit, unit), "cut")
    names = rows.select(F.col(ROW).alias("_row"), "_own")
    told = out.select("_id", F.explode("first_docs").alias("_at")).join(names, F.col("_at") == F.col("_row"))
    told = told.groupBy(F.col("_id").alias("_of")).agg(F.array_sort(F.collect_set("_own")).alias("_firsts"))
    out = out.join(names, F.col("_id") == F.col("_row")).join(told, F.col("_id") == F.col("_of"), "left")
    firsts = F.coalesce("_firsts", F.array().cast(f"array<{kind}>")).alias("first_docs")
    return out.select(F.col("_own").alias(id_col), "n_removed", "removed_words", "removed_spans", "kept_spans", firsts, "text")


def cut_repeats(df: DataFrame, id_col: str, text_col: str, least: int, least_unit: int, unit: str) -> DataFrame:
    """drop_repeated_passages() for a bigint id that no two rows share; the id is _id."""
    texts = df.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    units = save(texts.mapInArrow(lean(unit_batches(least, least_unit, unit)), "_id long, _nth int, _start int, _end int, _words int, _high long, _low long, _string_high long, _string_low long"), "units")
    found = repeats(units).unionByName(repeated_strings(units), allowMissingColumns=True).groupBy("_id").agg(F.collect_list(F.struct("_nth", "_start", "_end", "_words", "_of")).alias("_found"))
    both = texts.join(found.withColumnRenamed("_id", "_of_id"), F.col("_id") == F.col("_of_id"), "left").select("_id", "_text", "_found")
    return both.mapInArrow(lean(cut_batches(least, least_unit)), "_id long, n_removed long, removed_words long, removed_spans string, kept_spans string, first_docs array<long>, text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(documents(spark, sf_dir))
