"""Language identification with hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of +1 and -1, drawn from its code point (of
the small letter), whatever the script. A trigram's vector binds its letters' vectors, permuted by place:
the product of the first rotated twice, the second rotated once, and the third. A text's vector is the
bundle (sum) of its trigrams', a language's prototype the bundle of its training texts', with the mean of
all prototypes taken off. The prediction is the prototype of the largest cosine.

Training bundles whole numbers in each task, and sums the bundles by (language, dimension) over all
training rows: DIMENSIONS rows for a language reach the driver, whatever the corpus. Sums of whole numbers
are exact, so prototypes do not depend on how rows are dealt.

Defined results: 'und' with score 0 for null texts and texts without a letter, and where nothing
could be learned; ties go to the language first in order. Rows are scored one by one, so rows that repeat
an id are rows of their own, and ids may be of any type; an empty table gives an empty result; columns
other than id, text and (in training) language are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import documents, lean

DIMENSIONS = 1024
SEED = 20240
#: Bits of a code point in a trigram's code, letter vectors that a worker keeps, trigrams that are bound at once,
#: texts and characters of a slice, and characters of a piece of a text.
BITS = 21
KEPT_LETTERS = 1 << 13
BOUND = 1 << 13
SLICE_TEXTS, SLICE_CHARS = 256, 1 << 20
PIECE = 1 << 20


class Letters:
    """Code points to letters: 0 for what is no letter, else the code point of the small letter. Filled as code points are met."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if len(found) and found.min() < 0:
            for c in np.unique(points[found < 0]).tolist():
                self.table[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
            found = self.table[points]
        return found


@functools.lru_cache(KEPT_LETTERS)
def letter_vector(c: int) -> np.ndarray:
    return np.random.default_rng((SEED, c)).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams."""
    places = [codes >> 2 * BITS, codes >> BITS & (1 << BITS) - 1, codes & (1 << BITS) - 1]
    letters, at = np.unique(np.concatenate(places), return_inverse=True)
    memory = np.array([letter_vector(c) for c in letters.tolist()], np.int8).reshape(-1, DIMENSIONS)
    a, b, c = np.split(at, 3)
    return np.roll(memory, 2, 1)[a] * np.roll(memory, 1, 1)[b] * memory[c]


def bundle(codes: np.ndarray, counts: np.ndarray, start) -> np.ndarray:
    """start and the sum of the trigrams' vectors, each as often as counts (or a matrix of them) says; bound a block at a time."""
    for i in range(0, len(codes), BOUND):
        start = start + counts[..., i : i + BOUND] @ trigram_vectors(codes[i : i + BOUND]).astype(counts.dtype)
    return start


def pieces_of(text: str):
    """A text in pieces that end with the two characters that the next begins with, so that each trigram is in one; gaps around it."""
    whole = f" {text} "
    for i in range(0, max(1, len(whole) - 2), PIECE):
        yield whole[i : i + PIECE + 2]


def trigrams(texts: list[str], letters: Letters) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct trigrams of some texts, by code, and for each text the places there of its own.

    Gaps are one symbol wide, and a trigram's middle is a letter. Where the texts have few letters,
    trigrams are told by a table, else by their order.
    """
    owner, runs = [], []
    for k, text in enumerate(texts):
        for piece in pieces_of(text):
            owner.append(k)
            runs.append(letters(np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)))
    marked = np.zeros(1 + max((int(r.max()) for r in runs), default=0), bool)
    for r in runs:
        marked[r] = True
    alphabet = np.flatnonzero(marked).astype(np.int64)
    size = len(alphabet)
    rank = np.zeros(len(marked), np.int64 if size > 1024 else np.int32)
    rank[alphabet] = np.arange(size)
    found = [[] for _ in texts]
    for k, r in zip(owner, runs, strict=True):
        at = rank[r]
        found[k].append(((at[:-2] * size + at[1:-1]) * size + at[2:])[r[1:-1] > 0])
    codes = [f[0] if len(f) == 1 else np.concatenate(f) for f in found]
    if size**3 <= 1 << 22:
        there = np.zeros(size**3, bool)
        for c in codes:
            there[c] = True
        seen = np.flatnonzero(there)
        column = np.zeros(size**3, np.int32)
        column[seen] = np.arange(len(seen))
        places = [column[c] for c in codes]
    else:
        seen = np.unique(np.concatenate(codes))
        places = [np.searchsorted(seen, c) for c in codes]
    first, rest = np.divmod(seen, size * size) if size else (seen, seen)
    return alphabet[first] << 2 * BITS | alphabet[rest // max(size, 1)] << BITS | alphabet[rest % max(size, 1)], places


def slices(texts: list):
    """(first, last) of runs of texts of so many characters together."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and (size + len(t or "") > SLICE_CHARS or k - first >= SLICE_TEXTS):
            yield first, k
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def bundle_batches(batches):
    """mapInArrow over (lang, text): (lang, dimension, n), the bundle of each language's texts in the task."""
    import pyarrow as pa

    letters, sums = Letters(), {}
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        for i, j in slices(texts):
            codes, places = trigrams(texts[i:j], letters)
            for lang in dict.fromkeys(langs[i:j]):
                n = np.bincount(np.concatenate([p for p, own in zip(places, langs[i:j], strict=True) if own == lang]), minlength=len(codes))
                own = np.flatnonzero(n)
                sums[lang] = sums.get(lang, 0) + bundle(codes[own], n[own].astype(np.float64), np.zeros(DIMENSIONS)).astype(np.int64)  # exact below 2^53
    for lang, n in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(n)], names=["lang", "dimension", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes, from rows (lang, text)."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(lean(bundle_batches), "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n"))
    table = sums.orderBy("lang", "dimension").toPandas()
    langs = sorted(table["lang"].unique())
    order = {x: k for k, x in enumerate(langs)}
    profile = np.zeros((len(langs), DIMENSIONS))
    profile[table["lang"].map(order).to_numpy(np.int64), table["dimension"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    return langs, profile.astype(np.float32)


def score_batches(langs: list[str], prototypes: np.ndarray):
    """A function for mapInArrow over (_id, _held, _text)."""

    def run(batches):
        import pyarrow as pa

        letters = Letters()
        middle = prototypes.mean(0) if len(langs) > 1 else np.zeros(DIMENSIONS, np.float32)
        spread = prototypes - middle
        spread = spread / np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-9)

        def judge(texts):
            seen, at = trigrams([t or "" for t in texts], letters)
            if not len(seen) or not langs:
                return ["und"] * len(texts), [0.0] * len(texts)
            total = np.zeros((len(texts), DIMENSIONS), np.float32)
            for i in range(0, len(seen), BOUND):  # a block of trigrams at a time, for all texts
                size = min(BOUND, len(seen) - i)
                n = np.array([np.bincount(a[(a >= i) & (a < i + size)] - i if len(seen) > BOUND else a, minlength=size) for a in at], np.float32)
                total = bundle(seen[i : i + size], n, total)
            total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            best = ((total - middle) @ spread.T).argmax(1)
            raw = (total * prototypes[best]).sum(1) / np.maximum(np.linalg.norm(prototypes[best], axis=1), 1e-9)
            none = [len(a) == 0 for a in at]
            return [("und" if e else langs[b]) for b, e in zip(best, none, strict=True)], [0.0 if e else float(min(1.0, max(0.0, r))) for r, e in zip(raw, none, strict=True)]

        for batch in batches:
            found, scores, texts = [], [], batch.column(2).to_pylist()
            for i, j in slices(texts):
                a, b = judge(texts[i:j])
                found += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["_id", "held_out", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """id, held_out, lang_pred, score of every row of df."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), (held if held is not None else F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(lean(score_batches(*model)), f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held).select("lang", "text"))
    return predict(docs, model, held=held)
