"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

A BPE encoding is the one sequence of pieces in which every neighbouring pair (u, v) is left alone:
encoding u + v gives u, v again. Score a pair 0 if that holds and minus infinity if not; then the
encoding is the best path, and a chunk of text acts on what enters it as a max-plus matrix. Its rows
and columns are boundary states: the pieces that may lie across (or end at) the chunk's two borders.
With scores of 0 and minus infinity, a row of the matrix is a set, kept as bits of an integer.

Giant documents (GIANT code points or more) are cut into chunks of CHUNK, whatever is there. Each chunk
yields its matrix. Matrices are multiplied up a tree, FAN_IN neighbours a task, to one matrix for a
document; the one path through it then goes down the same tree and leaves a state on every border. Each
chunk traces its own pieces back, by itself. No task takes more than FAN_IN matrices or one chunk.

A place that no piece crosses (no piece has its two characters side by side) has a single state, so a
chunk's matrix is the product of its part before the first such place, which is a column, and of its
part after the last one, which is a row; what lies between is a stretch from one state to one state,
whose score is 0, as every text has an encoding. The trace runs the scan over each such stretch, stretch
by stretch, all of a chunk side by side; equal stretches of a task are traced once.

Documents below GIANT go to the library whole. Where the pairs leave no single path, which the tests
have never seen, a stretch or a document goes to the library too.

Decoding joins pieces: it gives the text back with U+2581 read as a blank, as the library does.

Defined results: null encodes as empty; empty texts have no ids; rows that repeat an id are rows of
their own, and null ids stay null; bytes that are no valid text decode as U+FFFD; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import documents, drop_saved, lean, partitions, save, text_of

GIANT = 32_768
CHUNK = 8_192
FAN_IN = 16
#: Pairs and stretches that a worker keeps while a task runs.
KNOWN_PAIRS, KNOWN_STRETCHES = 300_000, 150_000
GAP = "▁"
#: The state before the first piece, and the states' part that is no piece.
START = (0, 0, "")


@functools.lru_cache(2)
def model(path: str) -> Model:  # noqa: F821
    """One for each worker process."""
    return Model(path)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i)):
                self.pieces[m.id_to_piece(i)] = i
        self.reach = max(map(len, self.pieces))
        lengths: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 1:
                lengths.setdefault(p[:2], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.head = m.encode("\n")
        self.number = dict(self.pieces)
        self.traced: dict[str, tuple[int, ...]] = {}
        self.misses = 0
        self.forget()

    def forget(self) -> None:
        """Drop what a task has learned, but for a bounded table of stretches; workers outlive their tasks."""
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def bare(self, text: str) -> list[int]:
        """The ids of a stretch of escaped text, without the gap that the library puts before a text."""
        return self.lib.encode("\n" + text.replace(GAP, " "))[len(self.head) :]

    def ids(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece, or of one character that is no piece: its bytes."""
        if piece not in self.known:
            self.known[piece] = (self.pieces[piece],) if piece in self.pieces else tuple(self.bare(piece))
        return self.known[piece]

    def key(self, u: str, v: str) -> int:
        """A number for a pair; characters that are no pieces are numbered by their code points."""
        a = self.number.get(u)
        b = self.number.get(v)
        return (a if a is not None else ord(u) + (1 << 21) if u else 1 << 23) << 24 | (b if b is not None else ord(v) + (1 << 21))

    def learn(self, wanted: dict[int, tuple[str, str]]) -> dict[int, bool]:
        """Ask the library about pairs, in one call."""
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        texts, n = ["\n" + (u + v).replace(GAP, " ") for u, v in wanted.values()], len(self.head)
        told = self.lib.encode(texts, num_threads=1) if len(texts) > 32 else map(self.lib.encode, texts)  # a list starts a thread
        out = {k: tuple(ids[n:]) == ((*self.ids(u), *self.ids(v)) if u else self.ids(v)) for (k, (u, v)), ids in zip(wanted.items(), told, strict=True)}
        self.pairs.update(out)
        return out

    def stays(self, u: str, v: str) -> bool:
        """Whether encoding u + v gives u, v."""
        key = self.key(u, v)
        return self.pairs[key] if key in self.pairs else self.learn({key: (u, v)})[key]

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that the text has at a place; a character that is no piece stands for itself."""
        found, have = [text[at]], self.number
        for n in self.lengths.get(text[at : at + 2], ()):
            if (p := text[at : at + n]) in have and len(p) == n:
                found.append(p)
        return found

    def trace_all(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """The ids of stretches between places that no piece crosses, by the scan from one state to one state.

        All stretches advance place by place together, so that the pairs a step needs are one question. From
        one state, one piece at most ends at each place on paths that stay; it is the state of that place.
        """
        new = [t for t in dict.fromkeys(stretches) if t not in self.traced]
        if len(self.traced) + len(new) > KNOWN_STRETCHES:
            self.traced.clear()
            new = list(dict.fromkeys(stretches))
        ends = [[None] * (len(t) + 1) for t in new]  # of each place the piece that ends there
        for e in ends:
            e[0] = ""
        known = self.pairs.get
        for group in range(0, len(new), 4096):
            rows = range(group, min(len(new), group + 4096))
            for place in range(max((len(new[k]) for k in rows), default=0)):
                late, unknown = [], {}
                for k in rows:
                    t, end = new[k], ends[k]
                    if (u := end[place]) is None:
                        continue
                    for v in self.starting(t, place):
                        key = self.key(u, v)
                        good = known(key)
                        if good:
                            end[place + len(v)] = v
                        elif good is None:
                            late.append((key, end, v))
                            unknown[key] = (u, v)
                if unknown:
                    answers = self.learn(unknown)
                    for key, end, v in late:
                        if answers[key]:
                            end[place + len(v)] = v
                rows = [k for k in rows if len(new[k]) > place + 1]
        for t, e in zip(new, ends, strict=True):
            out, at = [], len(t)
            while at > 0 and e[at]:
                out.append(self.ids(e[at]))
                at -= len(e[at])
            if at:
                self.misses += 1
            self.traced[t] = tuple(self.bare(t)) if at else tuple(i for ids in reversed(out) for i in ids)
        return [self.traced[t] for t in stretches]


def states(m: Model, text: str, border: int) -> list[tuple[int, int, str]]:
    """(start, end, piece), relative to the border, of every piece that starts before it and ends at or after it."""
    return [(i - border, i - border + len(p), p) for i in range(max(0, border - m.reach), border) for p in m.starting(text, i) if i + len(p) >= border]


def advance(m: Model, text: str, reached: dict, stop: int, until: int | None = None, trace: dict | None = None) -> dict:
    """Carry sets along the pairs that stay. reached: {(end, piece): set}, sets being bits.

    Returns the pieces that end at or after `stop` (and start before it); with `until`, what arrives
    at that hard place instead. trace gets the piece before each.
    """
    at, out = {}, {}
    for (end, piece), bits in reached.items():
        at.setdefault(end, {})[piece] = bits
    goal = stop if until is None else until
    place = min(at, default=goal)
    while place < goal:
        here = at.pop(place, None)
        if here:
            for v in m.starting(text, place):
                bits = 0
                for u, b in here.items():
                    if m.stays(u, v):
                        bits |= b
                        if trace is not None:
                            trace[place + len(v), v] = (place, u)
                if bits:
                    side = at.setdefault(place + len(v), {})
                    side[v] = side.get(v, 0) | bits
        place += 1
    for end, found in at.items():
        for piece, bits in found.items():
            out[end, piece] = out.get((end, piece), 0) | bits
    return out


def hard_places(m: Model, text: str, first: int, last: int) -> list[int]:
    """The places in [first, last) that no piece crosses."""
    inside = m.inside
    return [k for k, (a, b) in enumerate(itertools.pairwise(text[first - 1 : last]), first) if a + b not in inside]


def hard_edges(m: Model, text: str, first: int, last: int) -> tuple[int, int] | None:
    """The first and the last of hard_places()."""
    hard = lambda k: text[k - 1 : k + 1] not in m.inside
    lo = next((k for k in range(first, last) if hard(k)), None)
    return None if lo is None else (lo, next(k for k in range(last - 1, lo - 1, -1) if hard(k)))


class Chunk:
    """A stretch [first, last) of escaped text with a margin on both sides; places are the slice's own."""

    def __init__(self, m: Model, text: str, first: int, last: int, opens: bool, closes: bool):
        self.m, self.text, self.first, self.last = m, text, first, last
        self.enter = [START] if opens else states(m, text, first)
        self.leave = [(0, 0, "end")] if closes else states(m, text, last)
        self.closes = closes
        self.hard = hard_edges(m, text, first + m.reach, last - m.reach) if last - first > 3 * m.reach else None

    def seeds(self, only: int | None = None) -> dict:
        return {(self.first + e, p): 1 << k for k, (_, e, p) in enumerate(self.enter) if only is None or k == only}

    def finish(self, reached: dict) -> list[int]:
        if self.closes:
            bits = 0
            for (end, _), b in reached.items():
                if end == self.last:
                    bits |= b
            return [bits]
        place = {(self.last + e, p): k for k, (_, e, p) in enumerate(self.leave)}
        row = [0] * len(self.leave)
        for key, bits in reached.items():
            if key in place:
                row[place[key]] |= bits
        return row

    def matrix(self) -> list[int]:
        """For each leaving state the set of entering states from which it can be reached."""
        m, text = self.m, self.text
        if not self.hard:
            return self.finish(advance(m, text, self.seeds(), self.last))
        lo, hi = self.hard
        arrived = advance(m, text, self.seeds(), self.last, lo)
        head = [functools.reduce(operator.or_, (b for (end, _), b in arrived.items() if end == lo), 0)]
        return times(head, self.finish(advance(m, text, {(hi, ""): 1}, self.last)))

    def trace(self, reached: dict, stop: int, wanted, until: int | None = None) -> list[int] | None:
        back: dict = {}
        ends = advance(self.m, self.text, reached, stop, until, back)
        key = next((k for k in ends if wanted(k)), None)
        if key is None:
            return None
        ids = []
        while key in back and key not in reached:
            ids.append(self.m.ids(key[1]))
            key = back[key]
        return [i for p in reversed(ids) for i in p]

    def ids(self, enter: int, leave: int) -> list[int] | None:
        """The ids of the pieces after the entering one, up to and with the leaving one; None if there is no way."""
        goal = (lambda k: k[0] == self.last) if self.closes else (lambda k: k == (self.last + self.leave[leave][1], self.leave[leave][2]))
        if not self.hard:
            return self.trace(self.seeds(enter), self.last, goal)
        lo, hi = self.hard
        head = self.trace(self.seeds(enter), self.last, lambda k: k[0] == lo, lo)
        middle = self.m.trace_all([self.text[a:b] for a, b in itertools.pairwise([*hard_places(self.m, self.text, lo, hi), hi])])
        tail = self.trace({(hi, ""): 1}, self.last, goal)
        return None if head is None or tail is None else [*head, *itertools.chain.from_iterable(middle), *tail]


def times(a: list[int], b: list[int]) -> list[int]:
    """The max-plus product: a's entering states for each of b's leaving states, through any state between."""
    out = []
    for bits in b:
        row, k = 0, 0
        while bits:
            if bits & 1:
                row |= a[k]
            bits, k = bits >> 1, k + 1
        out.append(row)
    return out


def ways(matrices: list[list[int]], enter: int, leave: int) -> list[tuple[int, int]]:
    """(entering, leaving) state of each of some neighbours on the one path from `enter` to `leave`; -1 where there is none or another.

    The products from the left and from the right meet on every border.
    """
    row = lambda m, rows: [int(any(rows[k] for k in range(len(rows)) if b >> k & 1)) for b in m]
    before, now = [], [int(k == enter) for k in range(enter + 1)]
    for m in matrices:
        now += [0] * (max((b.bit_length() for b in m), default=0) - len(now))
        now = row(m, now)
        before.append(now)
    wanted, at = 1 << leave if leave >= 0 else 0, []
    for m, reached in zip(reversed(matrices), reversed(before), strict=True):
        both = [j for j, x in enumerate(reached) if x and wanted >> j & 1]
        at.append(both[0] if len(both) == 1 else -1)
        wanted = functools.reduce(operator.or_, (b for j, b in enumerate(m) if wanted >> j & 1), 0)
    at.reverse()
    return list(zip([enter, *at[:-1]], at, strict=True)) if -1 not in at and enter >= 0 else [(-1, -1)] * len(at)


def cut(text: str, reach: int, chunk: int) -> list[tuple[int, str, int, int, bool, bool]]:
    """(number, slice with margins, first, last, opens, closes) of a document's chunks."""
    whole = GAP + text.replace(" ", GAP)
    starts = list(range(0, len(whole), chunk))
    if len(starts) > 1 and len(whole) - starts[-1] < 4 * reach:
        starts.pop()
    out = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(whole)
        left = max(0, a - 2 * reach)
        out.append((k, whole[left : b + 2 * reach], a - left, b - left, k == 0, b == len(whole)))
    return out


def encode_giant(m: Model, text: str, chunk: int = CHUNK) -> list[int]:
    """The ids of one text by the scan, in one place; the Spark operator deals the same steps."""
    if not text:
        return []
    chunks = [Chunk(m, *c[1:]) for c in cut(text, m.reach, chunk)]
    levels = [[c.matrix() for c in chunks]]
    while len(levels[-1]) > 1:
        levels.append([functools.reduce(times, levels[-1][k : k + FAN_IN]) for k in range(0, len(levels[-1]), FAN_IN)])
    path = [(0, 0)]
    for level in reversed(levels[:-1]):
        path = [w for k, (a, b) in enumerate(path) for w in ways(level[k * FAN_IN : (k + 1) * FAN_IN], a, b)]
    found = [c.ids(a, b) if a >= 0 else None for c, (a, b) in zip(chunks, path, strict=True)]
    return m.lib.encode(text) if None in found else [i for ids in found for i in ids]


# --- on tables --------------------------------------------------------------------------------


def lists(ids: list[list[int]]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def forgetting(path: str, run):
    """run, with the worker's model emptied of what it has learned at the end."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            model(path).forget()

    return lean(go)


def encode_batches(path: str):
    """mapInArrow over (_id, _hash, _text): whole texts through the library."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = model(path).lib.encode(part.column(2).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(found), pa.array([1] * len(found), pa.int32())], names=["_id", "_hash", "ids", "n_chunks"])

    return lean(run)


def cut_batches(path: str, chunk: int):
    """mapInArrow over (_hash, _text): the chunks of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = cut(t, model(path).reach, chunk)
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                columns = [pa.array([h] * len(rows)), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["_hash", "_nth", "_slice", "_first", "_last", "_opens", "_closes"])

    return lean(run)


def matrix_batches(path: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [["%x" % b for b in Chunk(model(path), *r).matrix()] for r in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.string()))], names=["_hash", "_nth", "_matrix"])

    return forgetting(path, run)


def unpacked(pdf) -> list[list[int]]:
    return [[int(x, 16) for x in row] for row in pdf["_matrix"]]


def multiply(pdf):
    """applyInPandas over FAN_IN neighbours at most, which share _of: their product."""
    product = functools.reduce(times, unpacked(pdf.sort_values("_nth")))
    return pdf[["_hash", "_of"]].head(1).rename(columns={"_of": "_nth"}).assign(_matrix=[["%x" % b for b in product]])


def part_ways(pdf):
    """applyInPandas over FAN_IN neighbours at most, which all name the way of their product: the way of each."""
    pdf = pdf.sort_values("_nth")
    found = ways(unpacked(pdf), int(pdf["_in"].iloc[0]), int(pdf["_out"].iloc[0]))
    return pdf[["_hash", "_nth"]].assign(_in=[a for a, _ in found], _out=[b for _, b in found])


def trace_batches(path: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [Chunk(model(path), *r[:5]).ids(*r[5:]) if r[5] >= 0 else None for r in zip(*(batch.column(k).to_pylist() for k in range(2, 9)), strict=True)]
            lost = pa.array([r is None for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([r or [] for r in rows]), lost], names=["_hash", "_nth", "_ids", "_lost"])

    return forgetting(path, run)


def scan(texts: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(_hash, ids, n_chunks, lost) of texts (_hash, _text), each once, by the scan; lost where it found no single path."""
    spark = texts.sparkSession
    pieces = save(texts.mapInArrow(cut_batches(model_path, chunk), "_hash string, _nth long, _slice string, _first int, _last int, _opens boolean, _closes boolean"), "chunks")
    found = pieces.repartition(partitions(spark)).mapInArrow(matrix_batches(model_path), "_hash string, _nth long, _matrix array<string>")
    levels = [save(found, "matrices")]
    while (levels[-1].agg(F.max("_nth")).first()[0] or 0) > 0:
        above = levels[-1].withColumn("_of", F.floor(F.col("_nth") / FAN_IN)).groupBy("_hash", "_of").applyInPandas(multiply, "_hash string, _nth long, _matrix array<string>")
        levels.append(save(above, "matrices"))
    way = levels[-1].select("_hash", "_nth", F.lit(0).cast("long").alias("_in"), F.lit(0).cast("long").alias("_out"))
    for level in reversed(levels[:-1]):
        of = way.select(F.col("_hash").alias("_h"), F.col("_nth").alias("_of"), "_in", "_out")
        both = level.join(of, (F.col("_hash") == F.col("_h")) & (F.floor(F.col("_nth") / FAN_IN) == F.col("_of"))).drop("_h")
        way = both.groupBy("_hash", "_of").applyInPandas(part_ways, "_hash string, _nth long, _in long, _out long")
    way = save(way, "ways")
    drop_saved(*levels)
    on = (F.col("_hash") == F.col("_h")) & (F.col("_nth") == F.col("_n"))
    both = pieces.join(way.select(F.col("_hash").alias("_h"), F.col("_nth").alias("_n"), "_in", "_out"), on).select(*pieces.columns, "_in", "_out")
    traced = both.mapInArrow(trace_batches(model_path), "_hash string, _nth long, _ids array<int>, _lost boolean")
    whole = traced.groupBy("_hash").agg(F.sort_array(F.collect_list(F.struct("_nth", "_ids"))).alias("_all"), F.max("_lost").alias("lost"))
    out = save(whole.select("_hash", F.flatten(F.transform("_all", lambda x: x["_ids"])).alias("ids"), F.size("_all").alias("n_chunks"), "lost"), "traced")
    drop_saved(pieces, way)
    return out


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, text_sha256, ids, n_chunks of every row of df."""
    kind, text = dict(df.dtypes)[id_col], text_of(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.sha2(text, 256).alias("_hash"), text.alias("_text"))
    by_library = lambda rows: rows.mapInArrow(encode_batches(model_path), f"_id {kind}, _hash string, ids array<int>, n_chunks int")
    plain, long = rows.filter(F.length("_text") < giant), rows.filter(F.length("_text") >= giant)
    found = scan(long.select("_hash", "_text").dropDuplicates(["_hash"]), model_path, chunk)
    keys = long.select("_id", F.col("_hash").alias("_own"))
    out = by_library(plain).unionByName(keys.join(found.filter("NOT lost"), F.col("_own") == F.col("_hash")).select("_id", "_hash", "ids", "n_chunks"))
    if found.filter("lost").limit(1).count():
        out = out.unionByName(by_library(long.join(found.filter("lost").select(F.col("_hash").alias("_own")), F.col("_hash") == F.col("_own"), "left_semi")))
    return out.withColumnsRenamed({"_id": id_col, "_hash": "text_sha256"})


def decode_batches(path: str, keep_ids: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts, sums, sizes = [], [], []
                for x in part.column(1):
                    ids = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)
                    texts.append(model(path).lib.decode(ids.tolist()) if len(ids) else "")
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    sizes.append(len(ids))
                digests = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]
                columns = [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(digests), *([part.column(1)] if keep_ids else []), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "text_sha256", "n_chunks", "n_ids", "ids_crc32", "decoded_sha256", *(["ids"] if keep_ids else []), "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """id, text_sha256, n_chunks, n_ids, ids_crc32, decoded_sha256, decoded, and ids if they are to be kept, of every row of encode()'s result."""
    kind = dict(encoded.dtypes)[id_col]
    rows = encoded.select(F.col(f"`{id_col}`").alias("_id"), "ids", "text_sha256", "n_chunks")
    out = rows.mapInArrow(lean(decode_batches(model_path, keep_ids)), f"_id {kind}, text_sha256 string, n_chunks int, n_ids long, ids_crc32 long, decoded_sha256 string, {'ids array<int>, ' if keep_ids else ''}decoded string")
    return out.withColumnRenamed("_id", id_col)


def both_batches(path: str, keep_ids: bool):
    """mapInArrow over (_id, _hash, _text): whole texts through the library and back, as decode() tells of them."""

    def run(batches):
        import pyarrow as pa

        m = model(path).lib
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = m.encode(part.column(2).to_pylist(), num_threads=1)
                digests = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in m.decode(ids, num_threads=1)] if ids else []
                sums = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
                columns = [part.column(0), part.column(1), pa.array([1] * len(ids), pa.int32()), pa.array(list(map(len, ids)), pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string()), *([lists(ids)] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "text_sha256", "n_chunks", "n_ids", "ids_crc32", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return lean(run)


def round_trips(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, digests of ids and texts (and the ids, if they are to be kept), and whether decoding gave the very text back.

    The ids of a text that goes to the library whole are decoded where they are made, so they need not
    leave the worker; those of giant documents are made by encode() and written before they are decoded.
    """
    kind, text = dict(docs.dtypes)["doc_id"], text_of("text")
    rows = docs.select(F.col("doc_id").alias("_id"), F.sha2(text, 256).alias("_hash"), text.alias("_text"))
    kinds = f"_id {kind}, text_sha256 string, n_chunks int, n_ids long, ids_crc32 long, decoded_sha256 string" + ", ids array<int>" * keep_ids
    plain = rows.filter(F.length("_text") < GIANT).mapInArrow(both_batches(model_path, keep_ids), kinds).withColumnRenamed("_id", "doc_id")
    giant = decode(save(encode(docs.filter(F.length(text) >= GIANT), model_path), "encoded"), model_path, keep_ids=keep_ids).drop("decoded")
    return plain.unionByName(giant).withColumn("round_trip", F.col("decoded_sha256") == F.col("text_sha256"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
