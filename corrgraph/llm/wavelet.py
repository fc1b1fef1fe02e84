"""Token ids in wavelet matrices, one compressed file for each shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has one bit plane for each bit of
an id, most significant first; each plane splits the ids stably into zeros then ones for the next.
Planes are cut into blocks, each compressed by itself, with the count of ones before each block, so
access(), rank() and select() read a few blocks of each plane of the one file.

File: magic, a JSON header with its length (documents' ids and lengths live in compressed arrays),
then the blocks. All integers are little-endian.

Documents are dealt by ranges of (id, hash of the text), a range a task, and sorted within, so shards
follow the ids, and many rows of one id are parted; a shard ends at SHARD_TOKENS ids or at its range's
end. A file is written under a temporary name and renamed, and its bytes depend on its rows alone: a
task that runs twice writes the same file twice.

Defined results: null and empty texts hold the end id alone; a document longer than a shard has a
shard to itself; rows that repeat an id follow each other, and null ids come first; ids are integers or
strings; an empty table has no files and no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import string
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import documents, lean, new_dir, partitions, save, text_of

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 16
END_ID = 1
MAGIC = b"WVM1"
CACHE_WORDS = 400_000
#: Rows that are encoded together, words that the model gets at a time, and tails of marks that are kept.
ROWS, JOINED, TAILS = 1024, 1024, 1 << 12
#: Marks that may end a chunk; not the apostrophe, which the vocabulary's rules join with letters.
TAIL = string.punctuation.replace("'", "")
MARKS = (b"\xcc", b"\xcd")
GAPS = re.compile(r"[^\S\x1c-\x1f]+")


# --- the matrix -------------------------------------------------------------------------------


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The planes (packed bits) and their numbers of zeros."""
    planes, zeros, now = [], [], ids
    for level in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        zeros.append(len(now) - int(np.count_nonzero(ones)))
        last, now = now, np.empty_like(now)
        last.compress(~ones, out=now[: zeros[-1]])
        last.compress(ones, out=now[zeros[-1] :])
    return planes, zeros


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """A shard as the bytes of its file."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes, zeros = build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    press = zstandard.ZstdCompressor(level=1)
    meta = [press.compress(json.dumps(doc_ids).encode()), press.compress(np.asarray(lengths, "<u8").tobytes())]
    blocks, sizes, ranks = [], [], []
    step = BLOCK_BITS // 8
    for plane in planes:
        counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), step)) if len(plane) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).tolist())
        parts = [press.compress(plane[i : i + step].tobytes()) for i in range(0, len(plane), step)]
        blocks += parts
        sizes.append([len(x) for x in parts])
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "ranks": ranks, "sizes": sizes, "meta": [len(x) for x in meta]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *meta, *blocks])


class WaveletFile:
    """Reads a shard's file; blocks are decompressed as they are needed, the last ones are kept."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        self.data, at = memoryview(data), 8 + struct.unpack("<I", data[4:8])[0]
        self.head = head = json.loads(data[8:at])
        self.n, self.bits, self.zeros, self.ranks = head["n"], head["bits"], head["zeros"], head["ranks"]
        self.open = zstandard.ZstdDecompressor().decompress
        a, b = head["meta"]
        self.doc_ids = json.loads(self.open(self.data[at : at + a]))
        self.lengths = np.frombuffer(self.open(self.data[at + a : at + a + b]), "<u8").astype(np.int64)
        at += a + b
        self.at = []
        for sizes in head["sizes"]:
            ends = np.cumsum([at, *sizes])
            self.at.append(ends.tolist())
            at = int(ends[-1])
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.kept:
            if len(self.kept) > 256:
                self.kept.clear()
            raw = self.open(self.data[self.at[plane][k] : self.at[plane][k + 1]])
            self.kept[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self.kept[plane, k]

    def ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        k, rest = divmod(i, BLOCK_BITS)
        return self.ranks[plane][k] + (int(self.block(plane, k)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane in range(self.bits):
            bit = int(self.block(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            value = value << 1 | bit
            i = self.zeros[plane] + self.ones(plane, i) if bit else i - self.ones(plane, i)
        return value

    def rank(self, value: int, i: int) -> int:
        """How often an id occurs before place i."""
        if value >> self.bits:
            return 0
        start = 0
        for plane in range(self.bits):
            if value >> (self.bits - 1 - plane) & 1:
                start, i = (self.zeros[plane] + self.ones(plane, x) for x in (start, i))
            else:
                start, i = (x - self.ones(plane, x) for x in (start, i))
        return i - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of an id (from 0); -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        start = 0
        for plane in range(self.bits):
            one = value >> (self.bits - 1 - plane) & 1
            start = self.zeros[plane] + self.ones(plane, start) if one else start - self.ones(plane, start)
        at = start + k
        for plane in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - plane) & 1
            at = self.find(plane, at - self.zeros[plane] if one else at, one)
        return at

    def find(self, plane: int, k: int, one: int) -> int:
        """The place of the k-th one or zero of a plane."""
        before = self.ranks[plane] if one else [i * BLOCK_BITS - r for i, r in enumerate(self.ranks[plane])]
        low, high = 0, len(before) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before[mid] <= k else (low, mid)
        bits = self.block(plane, low)
        return low * BLOCK_BITS + int(np.flatnonzero(bits if one else 1 - bits)[k - before[low]])

    def all_ids(self) -> np.ndarray:
        """Every id in order: the planes are joined again from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            edges = self.at[plane]
            raw = b"".join(self.open(self.data[a:b]) for a, b in itertools.pairwise(edges))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            split = self.zeros[plane]
            out = np.empty_like(values)
            out[np.flatnonzero(~ones)] = values[:split]
            out[np.flatnonzero(ones)] = values[split:] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = out
        return values


# --- encoding ---------------------------------------------------------------------------------


def byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else the next unused one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return {b: b if b in prints else next(spare) for b in range(256)}


def pieced(pieces: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces of these numbers one after another, and how many each has."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    return gathered(np.frombuffer(b"".join(pieces), "<u4"), sizes, which)


def gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pieced() of pieces that lie one after another in ids."""
    own = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(own) - own)
    return ids.take(np.repeat(shift, own) + np.arange(own.sum())), own


def strings(words) -> list[str]:
    """An Arrow array without nulls as a list; to_pylist() takes six times as long."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk between white space once.

    The vocabulary's rules drop white space, never look across it, lower-case, and part letters from
    punctuation. So a text's ids are those of its chunks in turn, and a chunk of letters that ends in
    marks has the ids of the letters and of the marks. Letters whose normal form is themselves go
    straight to the library's BPE model, many words in a call; all other chunks take its whole way, so
    no chunk's ids depend on what was met before. Arrow splits the texts and numbers their distinct chunks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # without rules, but for the blanks between words
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size, last = self.tokenizer.get_vocab_size(), self.tokenizer.model.end_of_word_suffix
        self.packed = [struct.pack("<I", i) for i in range(size)]
        self.ends = np.array([bool(last) and (self.tokenizer.id_to_token(i) or "").endswith(last) for i in range(size)])
        self.letters = {b: c for b, c in byte_letters().items() if b != ord(" ")}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, chunk: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(chunk, add_special_tokens=False).ids))

    def tail(self, marks: str) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            if len(self.tails) >= TAILS:
                self.tails.clear()
            self.tails[marks] = found = self.whole(marks)
        return found

    def plain(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, told apart by the model's ends of words."""
        out = []
        for k in range(0, len(words), JOINED):
            own = words[k : k + JOINED]
            text = " ".join(own)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(own):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:  # a vocabulary that marks no ends
                out += [b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(w)]) for w in text.split(" ")]
        return out

    def other(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks of any kind."""
        words: dict[str, bytes] = {}
        out: list = []
        for chunk in chunks:
            core = chunk.rstrip(TAIL)
            if not core.isalpha() or core != core.lower() or not core.isascii() and not unicodedata.is_normalized("NFC", core):
                out.append(self.whole(chunk))
            else:
                words[core] = b""
                out.append((core, chunk[len(core) :]))
        words = dict(zip(words, self.plain(list(words)), strict=True))
        return [x if isinstance(x, bytes) else words[x[0]] + self.tail(x[1]) if x[1] else words[x[0]] for x in out]

    def look_up(self, chunks: list[str], encode) -> list[bytes]:
        """The ids of distinct chunks; encode gives those of the ones that are not known."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [c for c in chunks if c not in known]
        if older and new:
            known.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in older]
        if new:
            known.update(zip(new, encode(new), strict=True))
        return list(map(known.__getitem__, chunks))

    def ids_of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, an Arrow array, one after another, and how many each has."""
        import pyarrow.compute as pc

        # ASCII letters are known without the marks after them, and both are put together here
        cores = pc.ascii_rtrim(words, TAIL)
        plain = pc.and_(pc.ascii_is_alpha(cores), pc.ascii_is_lower(cores))
        keys, rest = cores.filter(plain).dictionary_encode(), words.filter(pc.invert(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        pieces = self.look_up(strings(keys.dictionary), self.plain)
        which = np.empty((len(words), 2), np.int64)
        which[plain, 0], which[~plain, 0] = keys.indices.to_numpy(), np.arange(len(pieces), len(pieces) + len(rest))
        pieces += self.look_up(strings(rest), self.other)
        sizes = [pc.binary_length(x).to_numpy() for x in (cores, words)]
        own, tails = np.flatnonzero(plain & (sizes[0] < sizes[1])), {"": 0}
        each = zip(strings(words.take(own)), sizes[0][own].tolist(), strict=True)
        which[:, 1] = len(pieces)
        which[own, 1] += np.array([tails.setdefault(w[n:], len(tails)) for w, n in each], np.int64)
        ids, counts = pieced([*pieces, b"", *(self.tail(t) for t in tails if t)], which.ravel())
        return ids, counts.reshape(-1, 2).sum(1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        low, odd = [], {}
        for k, text in enumerate(texts):
            # Python's lower case is the library's, but for the capital sigma and the dotted I; the library
            # composes first, so capitals with marks (U+0300 to U+037F, by their first byte) are left to it
            if text.isascii() or not any(map(text.encode("utf-8", "replace").__contains__, MARKS)) and "\u03a3" not in text and "\u0130" not in text:
                text = text.lower()
            # Arrow, as Python, splits at four separators that are no white space to the library
            if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):
                odd[k], text = [w for w in GAPS.split(text) if w], ""
            low.append(text)
        parts = pc.utf8_split_whitespace(pa.array(low, pa.large_string()))
        words = parts.flatten().dictionary_encode()
        ids, sizes = self.ids_of(words.dictionary)  # of an empty word, which Arrow finds before and after white space, none
        ids, counts = gathered(ids, sizes, words.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts)])[parts.offsets.to_numpy()].tolist()
        out = [ids[a:b].tobytes() for a, b in itertools.pairwise(ends)]
        for k, chunks in odd.items():
            at = {c: n for n, c in enumerate(dict.fromkeys(chunks))}
            out[k] = pieced(self.look_up(list(at), self.other), np.array([at[c] for c in chunks], np.int64))[0].tobytes()
        return out


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, kept from task to task."""
    return WordEncoder(path)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(folder: str, tokenizer_path: str, shard_tokens: int, end_id: int):
    """A function for mapInArrow over rows (_range, _id, _text) sorted so: writes files, tells of each."""

    def run(batches):
        import pyarrow as pa

        encoder, end = word_encoder(tokenizer_path), struct.pack("<I", end_id)
        store, root = filesystem(folder)
        held, ids, lengths, size, now, number, told = [], [], [], 0, None, 0, []

        def flush():
            nonlocal held, ids, lengths, size, number
            if not ids:
                return
            name = f"{root}/shard-{now:08d}-{number:06d}.wvm"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(pack(np.frombuffer(b"".join(held), "<u4"), ids, np.array(lengths)))
            store.move(draft, name)
            told.append((now, number, name.rsplit("/", 1)[1], len(ids), size))
            held, ids, lengths, size, number = [], [], [], 0, number + 1

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                ranges, doc_ids, texts = (c.to_pylist() for c in batch.slice(i, ROWS).columns)
                for r, d, data in zip(ranges, doc_ids, encoder.encode(texts), strict=True):
                    n = len(data) // 4 + 1
                    if r != now or size + n > shard_tokens:
                        flush()
                        if r != now:
                            now, number = r, 0
                    held += [data, end]
                    ids.append(d)
                    lengths.append(n)
                    size += n
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["_range", "_number", "_file", "_docs", "_tokens"])

    return run


def read_shards(folder: str, id_type):
    """A function for mapInArrow over rows (_file, _start): a row for each document of each file."""

    def run(batches):
        import pyarrow as pa

        store, root = filesystem(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    shard = WaveletFile(f.read())
                data = shard.all_ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, id_type), pa.array(starts + start), pa.array(shard.lengths), pa.array(sums, pa.int64()), pa.array([name] * len(sums))], names=["_id", "start", "n_tokens", "ids_crc32", "shard"])

    return run


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Write the shards of df to a folder all executors share; (_range, _number, _file, _docs, _tokens) of each file."""
    spark = df.sparkSession
    order = F.col("_id"), F.xxhash64("_text")
    dealt = df.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).repartitionByRange(partitions(spark), *order)
    dealt = dealt.sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("_range"), "_id", "_text")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    return save(dealt.mapInArrow(lean(write_shards(folder, tokenizer_path, shard_tokens, end_id)), "_range long, _number long, _file string, _docs long, _tokens long"), "shards")


def read_tokens(spark, shards: DataFrame, folder: str, id_col: str = "doc_id", id_kind: str = "bigint") -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, ids_crc32, shard.

    A file's start is the ids of the files before it: summed by range first, then within the range,
    so the one driver-side list has a row for each range, of which there are few by choice.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ranges = sorted((r[0], r[1]) for r in shards.groupBy("_range").agg(F.sum("_tokens")).collect())
    before = [(r, s) for (r, _), s in zip(ranges, itertools.accumulate((t for _, t in ranges), initial=0), strict=False)]
    firsts = spark.createDataFrame(before, "_range long, _before long")
    inside = Window.partitionBy("_range").orderBy("_number")
    files = shards.join(F.broadcast(firsts), "_range").select(
        "_file", (F.col("_before") + F.sum("_tokens").over(inside) - F.col("_tokens")).alias("_start")
    )
    kind = to_arrow_type(_parse_datatype_string(id_kind))
    assert isinstance(kind, pa.DataType)
    found = files.repartition(partitions(spark), "_file").mapInArrow(lean(read_shards(folder, kind)), f"_id {id_kind}, start long, n_tokens long, ids_crc32 long, shard string")
    return found.withColumnRenamed("_id", id_col)


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    folder = new_dir(spark, "tokens")
    shards = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, shards, folder, id_kind=dict(docs.dtypes)["doc_id"])
