"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of those of its hash and of the hashes of its first four and five
letters, so inflected forms share what their stem has learned. Filters of several widths run over
the words, each filter's largest response in the text is kept, and a logistic layer weighs them.

Every labelled row teaches. Their texts are written once as the buckets of their words, dealt to shards of
about SHARD rows by a hash. Counts by label and by language are summed over all of them. Then come EPOCHS
rounds: from the common network each shard takes one pass of Adam over its rows, and the new network is the
mean of the shards', weighed by rows (a bucket's embedding by how often each shard moved it). Sums are of
whole numbers, so they do not depend on which task ended first. Four fifths of the rows, by a hash of the
id, train; the others, of which the network has seen nothing, set a threshold for each language. A shard is
as large whatever the corpus, and the driver holds one network and counts by bucket.

The language is guessed from the text: each word's bucket has a weight for each language, learned from
the labelled rows' own texts and languages, and the largest sum wins. Nothing but the text of a row enters
its score; where no row names a language, one threshold serves all. A score is the model's probability
with its logit moved so that the language's threshold scores CUT.

Scoring needs no convolution: a filter's response to a window is a sum of one number for each word
and place, so a table holds every bucket's numbers, and windows are sums of looked-up rows. Texts are split
and their words numbered many at a time by Arrow, so each distinct word of a batch is looked up once; rows are
read SLICE words at a time, so a worker holds a bounded table however long a text is.

Defined results: null and empty texts score as a text without words; without labelled rows of both
kinds every score is 0; rows are scored one by one, whole, so rows that repeat an id have scores of their
own (and each of their texts teaches the id's label); ids may be of any type; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.llm.common import documents, drop_saved, id_filter, lean, save

WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 16
WORDS, STEMS = 1 << 15, 1 << 13
BUCKETS = WORDS + 2 * STEMS
EPOCHS = 6
BATCH = 32
RATE = 0.01
CUT = 0.7
KNOWN_WORDS = 1 << 16
SLICE = 1 << 15
#: Labelled rows of a shard, about; steps of a whole number that stands for a parameter or for a logit.
SHARD = 2048
STEPS, LOGIT_STEPS = 1 << 24, 1 << 10
NOT_LETTERS = re.compile(r"[\W\d_]+")


def buckets_of(chunk: str) -> tuple[int, int, int]:
    """The buckets of a word's hash and of its first four and five letters; the last one, of no word, without a letter."""
    word = chunk if chunk.isalpha() else NOT_LETTERS.sub("", chunk)
    if not word:
        return (BUCKETS,) * 3
    hashed = xxhash.xxh32_intdigest
    return hashed(word) % WORDS, WORDS + hashed("4" + word[:4]) % STEMS, WORDS + STEMS + hashed("5" + word[:5]) % STEMS


#: The letters among the bytes of lower-cased ASCII words, and the longest word that hashes() takes.
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
SHORT = 15


def hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh32 of each row's first `sizes` bytes, SHORT at most; letters: (rows, 16), zero beyond them."""
    turn = lambda h, n: h << np.uint32(n) | h >> np.uint32(32 - n)
    one, two, three, four, five = (np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    lanes, whole, h = letters.view("<u4"), sizes // 4, five + sizes.astype(np.uint32)
    for k in range(3):
        own = np.flatnonzero(whole > k)
        h[own] = turn(h[own] + lanes[own, k] * three, 17) * four
    for k in range(3):
        own = np.flatnonzero(sizes % 4 > k)
        h[own] = turn(h[own] + letters[own, 4 * whole[own] + k] * five, 11) * one
    h = (h ^ h >> np.uint32(15)) * two
    h = (h ^ h >> np.uint32(13)) * three
    return h ^ h >> np.uint32(16)


def buckets_of_all(words) -> tuple[np.ndarray, np.ndarray]:
    """buckets_of() every word of an Arrow array of lower-cased words, and which are left out: long ones and those beyond ASCII."""
    n = len(words)
    starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    count = lambda kept: np.diff(np.concatenate([[0], np.cumsum(kept)])[starts])
    kept = LETTER[data]
    sizes = count(kept)
    left = (count(data > 127) > 0) | (sizes > SHORT)
    first, sizes, plain = np.cumsum(sizes) - sizes, np.where(left, 0, sizes), np.concatenate([data[kept], np.zeros(16, np.uint8)])
    letters = plain[np.minimum(first, len(plain) - 16)[:, None] + np.arange(16)]
    letters[np.arange(16) >= sizes[:, None]] = 0
    out = np.empty((n, 3), np.uint16)
    out[:, 0] = hashes(letters, sizes) % np.uint32(WORDS)
    for k, stem in ((1, 4), (2, 5)):
        marked = np.zeros((n, 16), np.uint8)
        marked[:, 0], marked[:, 1 : 1 + stem] = ord(str(stem)), letters[:, :stem]
        out[:, k] = hashes(marked, 1 + np.minimum(sizes, stem)) % np.uint32(STEMS) + np.uint32(WORDS + (k - 1) * STEMS)
    out[sizes == 0] = BUCKETS
    return out, left


class Numbers(dict):
    """Word to number; a word that is not there gets the next one, and its buckets go to `new`."""

    def __init__(self):
        self.new = array("H")

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        self.new.extend(buckets_of(chunk))
        return k


class Vocabulary:
    """Numbers words as they come; `new` holds the buckets of those numbered since it was last emptied."""

    def __init__(self):
        self.number = Numbers()

    @property
    def new(self) -> np.ndarray:
        return np.array(self.number.new, np.uint16).reshape(-1, 3)

    def taken(self) -> np.ndarray:
        """The buckets of the new words, which are new no more."""
        out, self.number.new = self.new, array("H")
        return out

    def read(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))


def chunks_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def numbered(texts: list[str | None]) -> tuple:
    """chunks_of() all texts, as numbers one text after another; where each text's begin, and the end; the words by number, an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.utf8_trim_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    parts = pc.utf8_split_whitespace(low)
    words = parts.flatten().dictionary_encode()
    at, starts = words.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    empty = pc.equal(low, "").to_numpy(zero_copy_only=False)  # Arrow splits the empty text into one empty word
    if empty.any():
        at = np.delete(at, starts[:-1][empty])
        starts = starts - np.concatenate([[0], np.cumsum(empty)])
    return at, starts, words.dictionary


class Encoder:
    """Texts to the buckets of their words, (words, 3); its table of known words is bounded."""

    def __init__(self):
        self.words, self.table = Vocabulary(), np.empty((KNOWN_WORDS + SLICE, 3), np.uint16)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[np.ndarray]:
        at, starts, words = numbered(texts)
        own = self.look_up(words)
        return [own.take(at[a:b], 0) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def look_up(self, words) -> np.ndarray:
        out, left = buckets_of_all(words)
        left = np.flatnonzero(left)
        for a in range(0, len(left), SLICE):
            if len(self.words.number) > KNOWN_WORDS:
                self.words = Vocabulary()
            own = left[a : a + SLICE]
            at = self.words.read(words.take(own).to_pylist())
            n, new = len(self.words.number), self.words.taken()
            self.table[n - len(new) : n] = new
            out[own] = self.table.take(at, 0)
        return out


def summed(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each word the sum of its three buckets' rows."""
    out = table.take(buckets[:, 0], 0)
    out += table.take(buckets[:, 1], 0)
    out += table.take(buckets[:, 2], 0)
    return out


class Tally:
    """In how many texts each bucket stands: by label, and for whole words by language."""

    def __init__(self):
        self.labels, self.langs = np.zeros((2, BUCKETS + 1), np.int64), {}

    def add(self, words: np.ndarray, label: int | None, lang: str | None) -> None:
        own = np.unique(words)
        if label is not None:
            self.labels[label, own] += 1
        if lang is not None:
            self.langs.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[own[own < WORDS]] += 1

    def weights(self) -> np.ndarray:
        """(buckets, languages): how much each bucket of a whole word speaks for a language; no columns where none is named."""
        seen = np.array([self.langs[x] for x in sorted(self.langs)], np.float64).reshape(-1, BUCKETS + 1).T
        if not seen.shape[1]:
            return seen.astype(np.float32)
        share = (seen + 0.5) / (seen.sum(0) + 0.5 * WORDS)
        weights = np.log(share / share.mean(1, keepdims=True))
        weights[seen.sum(1) < 2] = 0
        return weights.astype(np.float32)


def offsets() -> list[tuple[int, int]]:
    """(width, place in the window) of each block of FILTERS columns of the response table."""
    return [(w, j) for w in WIDTHS for j in range(w)]


#: Of each column of the response table: its filter, and its place in the window.
FILTER_OF = np.array([WIDTHS.index(w) * FILTERS + k for w, _ in offsets() for k in range(FILTERS)])
PLACE_OF = np.array([j for _, j in offsets() for _ in range(FILTERS)])
#: Of each width, the first column; and the columns by place, then width, as largest() takes them.
FIRST_OF = [offsets().index((w, 0)) * FILTERS for w in WIDTHS]
BY_PLACE = np.argsort(PLACE_OF, kind="stable")


def largest(rows: np.ndarray) -> np.ndarray:
    """Largest response of each filter to words as rows of the response table, whose columns are BY_PLACE; 0 where no window fits."""
    n, all_filters = len(rows), len(WIDTHS) * FILTERS
    sums, first = rows[:, :all_filters].copy(), all_filters
    for j in range(1, max(WIDTHS)):
        k = sum(w <= j for w in WIDTHS) * FILTERS  # filters before this reach no place j
        sums[: max(n - j, 0), k:] += rows[j:, first : first + all_filters - k]
        sums[max(n - j, 0) :, k:] = -np.inf
        first += all_filters - k
    while n > 1:  # whole rows at a time, the upper half against the lower
        half = (n + 1) // 2
        np.maximum(sums[: n - half], sums[half:n], out=sums[: n - half])
        n = half
    best = sums[0] if n else np.full(all_filters, -np.inf, np.float32)
    return np.where(best == -np.inf, np.float32(0), best)


class Network:
    """Embeddings (buckets x dimensions), filters (blocks x dimensions x FILTERS), the logistic layer, and Adam's state."""

    DENSE = ("filters", "shift", "weight", "bias")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.02, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
        self.filters = rng.normal(0, 0.1, (len(offsets()), DIMENSIONS, FILTERS)).astype(np.float32)
        self.filters[:, 0, : FILTERS // 2] = 1.0 / np.array([w * w for w, _ in offsets()], np.float32)[:, None]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.weight.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] = 0.5
        self.bias = np.zeros(1, np.float32)
        self.embed[-1] = 0  # what is no word
        self.first = {n: np.zeros_like(getattr(self, n)) for n in self.DENSE}
        self.second = {n: np.zeros_like(getattr(self, n)) for n in self.DENSE}
        self.step = 0.0

    def start_from(self, seen: np.ndarray, total: np.ndarray) -> None:
        """Dimension 0 starts as each bucket's shrunken log odds; training moves it on. seen: (2, buckets) of total (2) texts."""
        odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
        self.embed[:, 0] = odds * (seen.sum(0) / (seen.sum(0) + 12)) / 2
        self.embed[-1] = 0

    def dense(self) -> np.ndarray:
        """All but the embeddings, in one row; the second moments by their roots."""
        parts = [getattr(self, n) for n in self.DENSE] + [self.first[n] for n in self.DENSE] + [np.sqrt(self.second[n]) for n in self.DENSE]
        return np.concatenate([*(p.ravel().astype(np.float64) for p in parts), [self.step]])

    def set_dense(self, row: np.ndarray) -> None:
        at = 0
        for turn in range(3):
            for n in self.DENSE:
                like = getattr(self, n)
                value = row[at : at + like.size].reshape(like.shape).astype(np.float32)
                at += like.size
                if turn == 0:
                    setattr(self, n, value)
                else:
                    (self.first if turn == 1 else self.second)[n] = value if turn == 1 else value**2
        self.step = float(row[at])

    def copy(self) -> Network:
        out = Network.__new__(Network)
        out.embed, out.first, out.second = self.embed.copy(), {}, {}
        out.filters = self.filters
        out.shift, out.weight, out.bias = self.shift, self.weight, self.bias
        out.set_dense(self.dense())
        return out

    def pooled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter to words as embeddings, and where."""
        n, best, where = len(words), np.zeros(len(self.shift), np.float32), np.full(len(self.shift), -1)
        blocks = words @ self.filters.transpose(1, 0, 2).reshape(DIMENSIONS, -1)
        turned = np.ascontiguousarray(blocks.T)  # sums and searches run along the words
        for k, w in enumerate(WIDTHS):
            if n < w:
                continue
            first, own = FIRST_OF[k], slice(k * FILTERS, (k + 1) * FILTERS)
            r = turned[first : first + FILTERS, : n - w + 1]
            for j in range(1, w):
                r = r + turned[first + j * FILTERS : first + (j + 1) * FILTERS, j : j + n - w + 1]
            where[own] = at = r.argmax(1)
            best[own] = r[np.arange(FILTERS), at]
        return best, where

    def read(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pooled() of a text of any length, SLICE words at a time; windows that cross two slices are in one of them."""
        best, where = self.pooled(summed(self.embed, buckets[:SLICE]))
        step = SLICE - max(WIDTHS) + 1
        for a in range(step, len(buckets), step):
            own, at = self.pooled(summed(self.embed, buckets[a : a + SLICE]))
            wins = (at >= 0) & (own > best)
            best, where = np.where(wins, own, best), np.where(wins, at + a, where)
        return best, where

    def logit(self, best: np.ndarray) -> float:
        return float(np.maximum(best + self.shift, 0) @ self.weight + self.bias[0])

    def learn_from(self, batch: list[tuple[np.ndarray, int]], balance: np.ndarray, rate: float, rng, moves: np.ndarray) -> None:
        """One step of Adam on some texts (buckets, label); moves counts how often each embedding was moved."""
        grad = {n: np.zeros_like(getattr(self, n)) for n in self.DENSE}
        columns = self.filters.transpose(0, 2, 1).reshape(-1, DIMENSIONS)
        steep, met, pulls = np.zeros_like(columns), [], []
        for buckets, label in batch:
            if label == 0 and len(buckets) and rng.random() < 0.5:  # short texts are harmless too
                n = int(rng.integers(1, min(len(buckets), 40) + 1))
                i = int(rng.integers(0, len(buckets) - n + 1))
                buckets = buckets[i : i + n]
            if not len(buckets):
                continue
            best, where = self.read(buckets)
            lit = np.maximum(best + self.shift, 0)
            p = 1 / (1 + np.exp(-np.clip(lit @ self.weight + self.bias[0], -30, 30)))
            d = np.float32((p - label) * balance[label] / len(batch))
            grad["weight"] += d * lit
            grad["bias"] += d
            back = d * self.weight * (lit > 0)
            grad["shift"] += back
            pull = np.where(where >= 0, back, 0)[FILTER_OF]
            own = np.flatnonzero(pull)
            at = buckets[where[FILTER_OF[own]] + PLACE_OF[own]]
            steep[own] += pull[own, None] * self.embed[at].sum(1)
            met.append(at)
            pulls.append(pull[own, None] * columns[own])
        grad["filters"] = steep.reshape(len(offsets()), FILTERS, DIMENSIONS).transpose(0, 2, 1)
        self.step += 1
        for n in self.DENSE:
            self.first[n] += 0.1 * (grad[n] - self.first[n])
            self.second[n] += 0.001 * (grad[n] ** 2 - self.second[n])
            value = getattr(self, n)
            value -= (rate * (self.first[n] / (1 - 0.9**self.step)) / (np.sqrt(self.second[n] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
        if met:
            at, pull = np.concatenate(met).ravel(), np.repeat(np.concatenate(pulls), 3, 0)
            np.add.at(self.embed, at, np.float32(-0.5) * pull)
            self.embed[-1] = 0
            moves += np.bincount(at, minlength=BUCKETS + 1)

    def responses(self) -> np.ndarray:
        """Each bucket's numbers for every filter and place."""
        return np.concatenate([self.embed @ f for f in self.filters], 1)


def thresholds(langs: np.ndarray, steps: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_langs: int) -> np.ndarray:
    """The logit of the best F1 for each language, and of all texts together, which also serves those with too few cases.

    Each row is a language, a logit in whole LOGIT_STEPS, rounded down, and how many toxic and clean texts have it.
    """

    def best(own):
        z, at = np.unique(steps[own], return_inverse=True)
        y, n = (np.bincount(at, x[own], len(z))[::-1] for x in (toxic, toxic + clean))
        z = z[::-1]
        f1 = 2 * np.cumsum(y) / (np.cumsum(n) + max(y.sum(), 1))
        k = int(f1.argmax())
        return ((z[k] + z[k + 1] + 1) / 2 if k + 1 < len(z) else z[k]) / LOGIT_STEPS

    every = best(langs >= 0)
    out = []
    for k in range(n_langs):
        own = langs == k
        out.append(best(own) if toxic[own].sum() >= 8 and clean[own].sum() >= 8 else every)
    return np.array([*out, every], np.float32)


class Rounds:
    """One pass of training over texts as they come, shard by shard; each shard starts from the same network.

    close() gives a shard's share of the next network, as whole numbers to be summed: (key, n, DIMENSIONS values). A key is a
    bucket, and its values how far it moved, times n moves; or beyond the buckets a piece of dense(), times n rows.
    """

    def __init__(self, net: Network, balance: np.ndarray, turn: int):
        self.start, self.balance, self.turn = net, balance, turn
        self.net = None

    def open(self, shard: int) -> None:
        self.net, self.moves, self.n, self.waiting = self.start.copy(), np.zeros(BUCKETS + 1, np.int64), 0, []
        self.rng = np.random.default_rng((11, self.turn, shard))

    def add(self, words: np.ndarray, label: int) -> None:
        self.waiting.append((words, label))
        self.n += 1
        if len(self.waiting) == BATCH:
            self.learn()

    def learn(self) -> None:
        if self.waiting:
            self.net.learn_from(self.waiting, self.balance, RATE * 0.7**self.turn, self.rng, self.moves)
            self.waiting = []

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.learn()
        at = np.flatnonzero(self.moves[:BUCKETS])
        moved = (self.net.embed[at].astype(np.float64) - self.start.embed[at]) * self.moves[at, None]
        dense = self.net.dense()
        rest = np.pad(dense, (0, -len(dense) % DIMENSIONS)).reshape(-1, DIMENSIONS) * self.n
        self.net = None
        key = np.concatenate([at, BUCKETS + 1 + np.arange(len(rest))])
        n = np.concatenate([self.moves[at], np.full(len(rest), self.n)])
        return key, n, np.rint(np.concatenate([moved, rest]) * STEPS).astype(np.int64)


def merged(net: Network, key: np.ndarray, n: np.ndarray, values: np.ndarray) -> Network:
    """The network that the summed shares of all shards make of net."""
    out, mean = net.copy(), values / STEPS / n[:, None]
    own = key < BUCKETS
    out.embed[key[own]] += mean[own].astype(np.float32)
    out.set_dense(mean[~own][np.argsort(key[~own])].ravel())
    return out


def judged(net: Network, speaks: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """A text's language, and its logit in whole LOGIT_STEPS."""
    own, n = np.unique(words[:, 0], return_counts=True)
    return guess(n @ speaks[own].astype(np.float64)), int(np.floor(net.logit(net.read(words)[0]) * LOGIT_STEPS))


def finished(net: Network, speaks: np.ndarray, cuts: np.ndarray) -> dict:
    """The model that a Scorer takes; the table says all that scoring needs of the embeddings."""
    table = np.ascontiguousarray(np.concatenate([net.responses()[:, BY_PLACE], speaks], 1))
    net.embed = net.embed[:0]
    return {"net": net, "table": table, "cuts": cuts}


def balanced(total: np.ndarray) -> np.ndarray:
    """The weight of a text of each label, so that both labels weigh the same."""
    return 0.5 * total.sum() / np.maximum(total, 1)


def fit(inputs: list[np.ndarray], labels: list[int], langs: list[str | None]) -> dict | None:
    """The model of a few texts as rows of buckets, in one shard; None if a label is missing."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    check = np.arange(len(y)) % 5 == 4
    if not (0 < y[check].sum() < check.sum() and 0 < y[~check].sum() < (~check).sum()):
        check[:] = False
    chosen, probe = np.flatnonzero(~check), np.flatnonzero(check if check.any() else ~check)
    tally, total = Tally(), np.bincount(y[chosen], minlength=2)
    for i, words in enumerate(inputs):
        tally.add(words, None if check[i] else int(y[i]), langs[i])
    net, speaks = Network(), tally.weights()
    net.start_from(tally.labels, total)
    for turn in range(EPOCHS):
        rounds = Rounds(net, balanced(total), turn)
        rounds.open(0)
        for i in chosen:
            rounds.add(inputs[i], int(y[i]))
        net = merged(net, *rounds.close())
    lang, step = np.array([judged(net, speaks, inputs[i]) for i in probe]).T
    return finished(net, speaks, thresholds(lang, step, y[probe], 1 - y[probe], speaks.shape[1]))


def guess(weights: np.ndarray) -> int:
    """The language of the largest weight; the last threshold, which is that of all, where no word speaks."""
    return int(weights.argmax()) if weights.any() else len(weights)


def encode_batches(batches):
    """mapInArrow over (_shard, _order, _check, _label, _lang, _text): the same with the buckets of the text's words."""
    import pyarrow as pa

    encoder = Encoder()
    for batch in batches:
        words = pa.array([own.tobytes() for own in encoder.all(batch.column(5).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], words], names=["_shard", "_order", "_check", "_label", "_lang", "_words"])


def words_in(column):
    """The texts of a column of buckets, one by one."""
    for x in column:
        yield np.frombuffer(x.as_py(), np.uint16).reshape(-1, 3)


def tally_batches(batches):
    """mapInArrow over (_fit, _label, _lang, _words): (kind, bucket, n); a kind is a label, or a language after a colon."""
    import pyarrow as pa

    tally = Tally()
    for batch in batches:
        for fits, label, lang, words in zip(*(c.to_pylist() for c in batch.columns[:3]), words_in(batch.column(3)), strict=True):
            tally.add(words, label if fits else None, lang)
    for kind, seen in (("0", tally.labels[0]), ("1", tally.labels[1]), *((f":{x}", n) for x, n in tally.langs.items())):
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["kind", "bucket", "n"])


def round_batches(net: Network, balance: np.ndarray, turn: int):
    """A function for mapInArrow over (_shard, _label, _words), the rows of a shard one after another: what Rounds gives."""

    def run(batches):
        import pyarrow as pa

        def share():
            key, n, values = rounds.close()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(n, pa.int64()), *(pa.array(v) for v in values.T.copy())], names=["key", "n", *(f"v{k}" for k in range(DIMENSIONS))])

        rounds, last = Rounds(net, balance, turn), None
        for batch in batches:
            for shard, label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words_in(batch.column(2)), strict=True):
                if shard != last:
                    if last is not None:
                        yield share()
                    rounds.open(shard)
                    last = shard
                rounds.add(words, label)
        if last is not None:
            yield share()

    return run


def judge_batches(net: Network, speaks: np.ndarray):
    """A function for mapInArrow over (_label, _words): (lang, step, toxic)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            told = np.array([judged(net, speaks, w) for w in words_in(batch.column(1))], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), batch.column(0)], names=["lang", "step", "toxic"])

    return run


def taught(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Every row of docs with a label, written once as buckets: _shard, _order, _check, _label, _lang, _words.

    A shard is one file, in the order of a hash. Rows that repeat an id are rows of their own, and an id with
    both labels has both.
    """
    kind = dict(docs.dtypes)[id_col]
    ids = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").try_cast(kind).alias("_id"), F.col("toxic").cast("int").alias("_label"))
    ids = save(ids.filter("_id IS NOT NULL").distinct(), "labels")
    shards = ids.count() // SHARD + 1
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("_own"), lang.cast("string").alias("_lang"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows, _ = id_filter(rows, "_own", ids, "_id")  # only rows that may have a label are dealt
    rows = rows.join(ids, F.col("_own") == F.col("_id")).withColumn("_order", F.xxhash64("_id", "_label", "_text", "_lang"))
    parts = [F.pmod("_order", F.lit(shards)).cast("int").alias("_shard"), "_order", (F.pmod(F.xxhash64("_id", "_label"), F.lit(5)) == 4).alias("_check"), "_label", "_lang", "_text"]
    schema = "_shard int, _order long, _check boolean, _label int, _lang string, _words binary"
    words = rows.select(*parts).mapInArrow(lean(encode_batches), schema)
    return save(words.repartitionById(shards, "_shard").sortWithinPartitions("_order"), "taught")


def columns_of(table: DataFrame) -> list[np.ndarray]:
    """The columns of a small table."""
    return [c.to_numpy(zero_copy_only=False) if len(c) else np.zeros(0, np.int64) for c in (x.combine_chunks() for x in table.toArrow().columns)]


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None = "lang") -> dict | None:
    """The model of all rows of docs that have a label; None if a label is missing.

    What reaches the driver are sums by bucket, as many rows as there are buckets (and for languages, as many
    for each), one network a round, and counts by logit.
    """
    rows = taught(docs, labels, id_col, text_col, lang_col)
    counts = {(r._check, r._label): r["count"] for r in rows.groupBy("_check", "_label").count().collect()}
    model = fit_rows(rows, counts) if {y for _, y in counts} == {0, 1} else None
    drop_saved(rows)
    return model


def fit_rows(rows: DataFrame, counts: dict) -> dict:
    """What fit() does, over the shards of taught()."""
    parted = len(counts) == 4  # both labels on both sides; else all rows train, and set thresholds too
    fits = ~F.col("_check") if parted else F.lit(True)
    total = np.array([sum(n for (check, y), n in counts.items() if y == label and not (parted and check)) for label in (0, 1)])
    tally = Tally()
    sums = rows.select(fits.alias("_fit"), "_label", "_lang", "_words").mapInArrow(lean(tally_batches), "kind string, bucket int, n long")
    kinds, buckets, n = columns_of(sums.groupBy("kind", "bucket").agg(F.sum("n").alias("n")))
    for kind in sorted(set(kinds)):
        own = kinds == kind
        seen = tally.labels[int(kind)] if kind[0] != ":" else tally.langs.setdefault(kind[1:], np.zeros(BUCKETS + 1, np.int64))
        seen[buckets[own]] = n[own]
    net, speaks = Network(), tally.weights()
    net.start_from(tally.labels, total)
    names = [f"v{k}" for k in range(DIMENSIONS)]
    for turn in range(EPOCHS):
        shares = rows.filter(fits).select("_shard", "_label", "_words").mapInArrow(lean(round_batches(net, balanced(total), turn)), "key int, n long, " + ", ".join(f"{v} long" for v in names))
        key, n, *values = columns_of(shares.groupBy("key").agg(*(F.sum(c).alias(c) for c in ["n", *names])))
        net = merged(net, key, n, np.array(values).T)
    probe = rows.filter("_check") if parted else rows
    told = probe.select("_label", "_words").mapInArrow(lean(judge_batches(net, speaks)), "lang long, step long, toxic int")
    lang, step, toxic, clean = columns_of(told.groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    return finished(net, speaks, thresholds(lang, step, toxic, clean, speaks.shape[1]))


class Scorer:
    """Scores texts by a model; its table of known words is bounded."""

    def __init__(self, model: dict | None):
        self.model = model
        if model:
            self.net, self.table, self.cuts = model["net"], model["table"], model["cuts"]
            self.n_langs = len(self.cuts) - 1
            self.at = float(np.log(CUT / (1 - CUT)))
            self.encoder = Encoder()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.model:
            return [0.0] * len(texts)
        at, starts, words = numbered(texts)
        buckets = self.encoder.look_up(words)
        if len(buckets) <= KNOWN_WORDS:
            table = summed(self.table, buckets)
            rows = lambda a, b: table.take(at[a:b], 0)
        else:
            rows = lambda a, b: summed(self.table, buckets.take(at[a:b], 0))
        return [self.score_rows(rows, a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def score_rows(self, rows, start: int, end: int) -> float:
        """The score of the words from start to end; rows(a, b) gives the table's rows of those from a to b."""
        width = max(WIDTHS)
        best, weights = np.zeros(len(self.net.shift), np.float32), np.zeros(self.n_langs, np.float64)
        for a in range(start, end, SLICE - width + 1):  # windows that cross two slices are in one of them
            found = rows(a, min(end, a + SLICE))
            own = largest(found)
            best = own if a == start else np.where(np.arange(len(own)) // FILTERS < min(len(found), width), np.maximum(best, own), best)
            weights += found[: SLICE - width + 1, found.shape[1] - self.n_langs :].sum(0, dtype=np.float64)
        z = self.net.logit(best) - self.cuts[guess(weights)] + self.at
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def score_batches(model: dict | None):
    """A function for mapInArrow over (_id, _held, _text)."""

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], names=["_id", "held_out", "score", "predicted"])

    return run


def keep_batches(model: dict | None, text: int):
    """A function for mapInArrow over whole rows: those whose text (column number `text`) scores below CUT."""

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([s < CUT for s in scorer.scores(batch.column(text).to_pylist())], pa.bool_()))

    return run


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """id, held_out, score, predicted of every row of df. labels: (doc_id, toxic); held rows teach nothing."""
    kind = dict(df.dtypes)[id_col]
    held = held if held is not None else F.lit(False)
    model = learn(df.filter(~held), labels.filter(~held_out()), id_col, text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), held.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(lean(score_batches(model)), f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """df without the rows that toxicity() would predict to be toxic, each judged by itself as it streams by."""
    model = learn(df.filter(~(held if held is not None else F.lit(False))), labels.filter(~held_out()), id_col, text_col)
    plain = df.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return plain.mapInArrow(lean(keep_batches(model, df.columns.index(text_col))), plain.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held=held_out())
