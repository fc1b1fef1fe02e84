"""N-gram Jaccard join with R-trees over count vectors.

A document is the set of its distinct shingles of SHINGLE words, each hashed to 64 bits (within a pair
of documents of n shingles a collision has a chance near n^2 / 2^64). Shingles fall into
groups by their leading bits, and a document is the point of its counts by group; larger documents
have more groups, and fold to fewer where they meet smaller ones. Two sets share at most the sum of
the smaller coordinates, so an R-tree over points bounds the overlap of a query with a whole node by
the node's upper corner, and drops it when the bound is below what the sizes require.

Points meet in blocks, dealt by shingles, in two passes:

1. grouping: a block is all documents with the same smallest shingle, for PERMUTATIONS orders. Each
   document looks in the block's tree for one partner outside its own group so far, so a block of g
   documents gives g - 1 candidates at most, however alike they are. Verified, they are links, and
   linked documents get one label. This pass may miss links.
2. completing: in one total order of shingles, documents that reach the similarity share one of their
   first n - ceil(0.85 n) + 1 shingles. Every block of such a shingle with more than one label is
   searched by tree for all pairs of different labels. So every link is found, or joins documents that
   are linked by others already; components come out whole.

No task takes a block of unbounded size. Shingles that the count below finds in HOT documents or more
are told mixed from one label by an aggregate, the others where their rows meet. Blocks that share their
smallest document meet in one task, which tells each pair once; where those have more than LEAD rows,
they are cut into parts of PART documents, every pair of parts is a task, and a pair of documents is
told by the smallest of the blocks that both are in.

The order puts shingles that many documents have last; a Misra-Gries count in each task finds them.
Any order gives the same links; this one keeps common passages from making large blocks. Candidates
are verified on the shingles of the whole texts. Equal sets are one class, compared once.

Defined results: null and empty texts and those without words have no shingles and stand alone; a
text of fewer words than SHINGLE is one shingle; rows that repeat an id, or have none, are documents of
their own, and a component is named by the smallest id in it (null if it has none). Ids may be of any
type that has an order; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import ROW, components, documents, drop_saved, id_filter, lean, partitions, save, text_of, unique_ids, with_group_first, with_row_key, without_ids

SHINGLE = 4
PERCENT = 85
#: Groups of a document's point: a power of two, an eighth of its shingles or more, within these bounds.
FEWEST, MOST = 64, 1024
PERMUTATIONS = 3
LEAF = 64
#: Leaves that a query of the grouping pass looks at; the completing pass looks at all it cannot drop.
LOOKS = 16
#: A block of the grouping pass above this many documents is split; all parts get its first document.
BLOCK = 4096
#: Documents from which a shingle is hot, rows of blocks with one smallest document that one task takes,
#: documents of a part of larger ones, and the blocks a document names there to tell a pair once.
HOT = 4096
LEAD = 4096
PART = 1024
NAMED = 64
#: Pairs that a task remembers as told, and pairs of an Arrow batch.
TOLD = 1 << 19
PAIRS = 1 << 14
#: Counters of a task, and common shingles that the order knows at most.
COUNTERS = 1 << 16
COMMON = 1 << 16
CACHE = 200_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Multipliers of the orders of the grouping pass; the first leaves the hash as it is.
ORDERS = np.array([1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Words(dict):
    """Word to hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: Words, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, np.uint64((0 if len(h) >= size else n) * int(ODD[4]) & (1 << 64) - 1), np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * (ODD[k % 4] + np.uint64(2 * (k // 4)))
    s ^= s >> np.uint64(31)
    s *= ODD[4]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def alike(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


# --- the tree ---------------------------------------------------------------------------------


class CountTree:
    """An R-tree over points of counts, packed in the order of size and coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        keys = tuple(points[:, k] for k in range(min(4, points.shape[1]))) + (sizes,)
        self.order = np.lexsort(keys)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: upper corners, least and greatest sizes of each node
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def reaches(self, point, size, tops, low, high) -> np.ndarray:
        """Upper bounds of the overlap where it may suffice, else -1."""
        bound = np.minimum(tops, point).sum(1, dtype=np.int64)
        least = np.maximum(low, -(-self.percent * size // 100))  # the smallest partner that could do
        need = -(-self.percent * (size + least) // (100 + self.percent))
        return np.where((least <= high) & (100 * size >= self.percent * low) & (bound >= need), bound, -1)

    def search(self, point: np.ndarray, size: int, looks: int | None = None):
        """Places (in the caller's numbering) whose bound suffices, leaf by leaf, the best leaves first."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high = self.levels[depth]
            bound = self.reaches(point, size, tops[nodes], low[nodes], high[nodes])
            good = bound >= 0
            nodes, bound = nodes[good], bound[good]
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = np.concatenate([np.arange(k * LEAF, min(below, (k + 1) * LEAF)) for k in nodes]) if len(nodes) else nodes
        for k in nodes[np.argsort(-bound, kind="stable")][:looks]:
            a, b = k * LEAF, min(len(self.points), (k + 1) * LEAF)
            bound = self.reaches(point, size, self.points[a:b], self.sizes[a:b], self.sizes[a:b])
            found = self.order[a:b][bound >= 0]
            if len(found):
                yield found


def groups_for(n: int) -> int:
    return min(MOST, max(FEWEST, 1 << max(0, (n // 8 - 1).bit_length())))


def pack_point(s: np.ndarray) -> bytes:
    """The counts by group; one byte each if they fit, else four, which the length tells."""
    groups = groups_for(len(s))
    counts = np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpack_points(packed: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """The points, folded to so many groups."""
    out = np.empty((len(packed), groups), np.int32)
    for k, (data, n) in enumerate(zip(packed, sizes.tolist(), strict=True)):
        point = np.frombuffer(data, "u1" if len(data) == groups_for(n) else "<u4")
        out[k] = point if len(point) == groups else point.reshape(groups, -1).sum(1)
    return out


def classes_of(sizes: np.ndarray):
    """For each number of groups: it, the rows that have it, and those rows with the next larger ones.

    Sizes that can be alike differ by less than a half, so they have the same number or the next.
    """
    groups = np.array([groups_for(n) for n in sizes.tolist()])
    for g in np.unique(groups):
        yield int(g), np.flatnonzero(groups == g), np.flatnonzero(groups == 2 * g)


def bounds(points: np.ndarray, sizes: np.ndarray, percent: int, i: int) -> np.ndarray:
    """Whether each row may be alike with row i."""
    least, both = np.minimum(sizes, sizes[i]), np.minimum(points, points[i]).sum(1)
    return ((100 + percent) * both >= percent * (sizes + sizes[i])) & (100 * least >= percent * np.maximum(sizes, sizes[i]))


def forest(packed: list[bytes], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Candidate pairs that join a block's documents into groups, without a circle; the first document is tried first."""
    root = list(range(len(sizes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []

    def join(i, j):
        a, b = find(i), find(j)
        if a != b:
            out.append((min(i, j), max(i, j)))
            root[max(a, b)] = min(a, b)

    for g, own, larger in classes_of(sizes):
        rows = np.concatenate([own, larger])
        points, n = unpack_points([packed[k] for k in rows], sizes[rows], g), sizes[rows]
        if len(rows) < 2:
            continue
        near = bounds(points, n, percent, 0)
        for k in np.flatnonzero(near)[1:]:
            join(int(rows[0]), int(rows[k]))
        tree = CountTree(points, n, percent) if len(rows) > LEAF else None
        for k in range(1, len(own)):
            if near[k]:
                continue
            found = tree.search(points[k], int(n[k]), LOOKS) if tree else [np.flatnonzero(bounds(points, n, percent, k))]
            mine = find(int(rows[k]))
            other = next((int(rows[j]) for part in found for j in part if find(int(rows[j])) != mine), None)
            if other is not None:
                join(int(rows[k]), other)
    return out


def across(packed: list[bytes], sizes: np.ndarray, labels: np.ndarray, percent: int, sides: np.ndarray | None = None):
    """All candidate pairs (i, j) of different labels, and of different sides where there are sides."""
    for g, own, larger in classes_of(sizes):
        rows = np.concatenate([own, larger])
        if len(rows) < 2:
            continue
        points, n, names = unpack_points([packed[k] for k in rows], sizes[rows], g), sizes[rows], labels[rows]
        side = None if sides is None else sides[rows]
        tree = CountTree(points, n, percent) if len(rows) > LEAF else None
        for k in range(len(own)):
            for part in tree.search(points[k], int(n[k])) if tree else [np.flatnonzero(bounds(points, n, percent, k))]:
                good = (part > k) & (names[part] != names[k])
                if side is not None:
                    good &= side[part] != side[k]
                for j in part[good].tolist():
                    yield int(rows[k]), int(rows[j])


# --- batches ----------------------------------------------------------------------------------


def info_batches(size: int):
    """mapInArrow over (_id, _text): for each row its set's size and digest; then the task's common shingles."""

    def run(batches):
        import pyarrow as pa

        words = Words()
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names = ["_id", "_n", "_high", "_low", "_shingle", "_count"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, sets = batch.slice(i, 256), []
                for t in part.column(1).to_pylist():
                    sets.append(shingles(t, words, size))
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([(d >> 64) - (1 << 63) for d in digests]), pa.array([(d & (1 << 64) - 1) - (1 << 63) for d in digests]), none, none], names=names)
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                often = c > 1
                known = np.searchsorted(hashes, h)
                known[known == len(hashes)] = 0
                often |= (hashes[known] == h) if len(hashes) else False
                hashes, back = np.unique(np.concatenate([hashes, h[often]]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c[often]]), len(hashes)).astype(np.int64)
                if len(hashes) > COUNTERS:  # Misra-Gries: take what the first one too many has from all
                    counts -= np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
                    hashes, counts = hashes[counts > 0], counts[counts > 0]
        keep = counts >= 4
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(n, batch.column(0).type if n else pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(hashes[keep].view(np.int64)), pa.array(counts[keep])], names=names) if n else pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64())] * 6, names=names)

    return run


def print_batches(size: int, percent: int, common: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """mapInArrow over (_id, _text): size, point, keys of the grouping pass, keys of the completing pass, hot ones apart.

    common: shingles that many documents have, in order; their places in the total order; whether they are hot.
    """

    def run(batches):
        import pyarrow as pa

        words = Words()
        hashes, ranks, hot = common
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for t in part.column(1).to_pylist():
                    s = shingles(t, words, size)
                    n = len(s)
                    if not n:
                        rows.append((0, None, None, None, None))
                        continue
                    first = [int(s[(s * m).argmin()].view(np.int64)) for m in ORDERS[:PERMUTATIONS]]
                    rank, many = np.zeros(n, np.int64), np.zeros(n, bool)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        rank, many = np.where(hashes[at] == s, ranks[at], 0), (hashes[at] == s) & hot[at]
                    chosen = np.lexsort((s, rank))[: n - -(-percent * n // 100) + 1]
                    keys, many = s[chosen].view(np.int64), many[chosen]
                    rows.append((n, pack_point(s), first, keys[~many], keys[many]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4))], names=["_id", "_n", "_point", "_first", "_keys", "_hot"])

    return run


def blocks(batches, key_columns: int, columns: int):
    """Runs of rows with equal leading columns, from batches sorted by them."""
    held, now = [[] for _ in range(columns)], None
    for batch in batches:
        values = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*values[:key_columns], strict=True))
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != now:
                for c, v in zip(held, values, strict=True):
                    c += v[start:i]
                start = i
                if i < len(keys):
                    if held[0]:
                        yield held
                    held, now = [[] for _ in range(columns)], keys[i]
    if held[0]:
        yield held


def tells(key: int, a: list[int] | None, b: list[int] | None) -> bool:
    """Whether block `key` tells a pair: the smallest of the blocks that both documents name, or any if they name none in common."""
    both = set(a or ()).intersection(b or ())
    return not both or min(both) == key


def pair_batches(percent: int, labelled: bool):
    """mapInArrow over (_key, _part, _hub or _lead, _id, _n, _point, _label[, _side, _named]) sorted: candidate pairs of each block."""

    def found(held):
        ids, sizes = held[3], np.array(held[4], np.int64)
        if not labelled:
            yield from forest(held[5], sizes, percent)
            return
        sides = np.array(held[7], np.int64)
        for i, j in across(held[5], sizes, np.array(held[6]), percent, sides if sides[0] >= 0 else None):
            if tells(held[0][0], held[8][i], held[8][j]):
                yield i, j

    def run(batches):
        import pyarrow as pa

        lead, told, a, b = None, set(), [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        for held in blocks(batches, 2, 9 if labelled else 7):
            ids = held[3]
            if len(ids) < 2:
                continue
            if labelled and (held[2][0] != lead or len(told) > TOLD):  # blocks of one lead come one after the other, and often hold the same pairs
                lead, told = held[2][0], set()
            for i, j in found(held):
                pair = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
                if labelled:
                    if pair in told:
                        continue
                    told.add(pair)
                a.append(pair[0])
                b.append(pair[1])
                if len(a) >= PAIRS:
                    yield out()
                    a, b = [], []
        if a:
            yield out()

    return run


def mixed_batches(batches):
    """mapInArrow over (_key, _id, _label) sorted by key: the rows of blocks that have two labels or more.

    No block here is hot, so what is held of one is bounded. Their new key is a sum over the hashes of the block's ids: blocks of the same documents get the same
    key and need one search. Blocks that differ and meet by chance only give more candidates. Blocks are
    dealt by their lead, the smallest id, so that those which share documents mostly meet in one task.
    """
    import pandas as pd
    import pyarrow as pa

    held = None

    def mixed(table, last):
        """The mixed blocks of the rows, and the last block, which may go on in the next batch."""
        key, ids, label = (c.to_numpy(zero_copy_only=False) for c in table.columns)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = len(key) if last else starts[-1]
        differs = np.concatenate([[False], (label[1:] != label[:-1]) & (key[1:] == key[:-1])])
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        good = np.zeros(len(starts), bool)
        good[block[differs]] = True
        keep = np.flatnonzero(good[block[:end]])
        sums = np.add.reduceat(pd.util.hash_array(ids), starts).view(np.int64)  # hot blocks have a hash of their key
        leads = np.minimum.reduceat(ids, starts)
        out = table.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([pa.array(sums[block[keep]]), pa.array(leads[block[keep]], out.column(1).type), out.column(1), out.column(2)], names=["_key", "_lead", "_id", "_label"]), None if last else table.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        out, held = mixed(batch, False)
        yield out
    if held is not None and held.num_rows:
        yield mixed(held, True)[0]


def verify_batches(size: int, percent: int):
    """mapInArrow over (_hub, _part, _member, _text) sorted, the hub's own row (_member null) first: the links."""

    def run(batches):
        import pyarrow as pa

        words, now, own = Words(), None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                a, b = [], []
                part = batch.slice(i, 128)
                for hub, salt, member, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingles(text, words, size)
                    if member is None:
                        now, own = (hub, salt), s
                    elif now == (hub, salt) and len(s) and len(own):
                        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        if alike(len(own), len(s), int((own[at] == s).sum()), percent):
                            a.append(hub)
                            b.append(member)
                kind = part.column(0).type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


# --- the join ---------------------------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that are links, by the sets of their whole texts.

    Pairs are dealt by a, which is compared with its partners as they stream by; one with many
    partners is dealt in parts, each with its own copy of a's text. The table of pairs goes once it is read.
    """
    spark = pairs.sparkSession
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(512)).alias("_parts"))
    rows = pairs.join(hubs, "a").select(F.col("a").alias("_hub"), F.pmod(F.xxhash64("b"), F.col("_parts").cast("long")).alias("_part"), F.col("b").alias("_member"), F.col("b").alias("_of"))
    heads = hubs.select(F.col("a").alias("_hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)).alias("_part"), F.lit(None).cast("long").alias("_member"), F.col("a").alias("_of"))
    wanted = save(rows.unionByName(heads), "wanted")
    asked, _ = id_filter(texts, "_id", wanted, "_of")
    dealt = wanted.join(asked, F.col("_of") == F.col("_id")).select("_hub", "_part", "_member", "_text")
    dealt = dealt.repartition(partitions(spark), "_hub", "_part").sortWithinPartitions("_hub", "_part", F.col("_member").asc_nulls_first())
    links = save(dealt.mapInArrow(lean(verify_batches(size, percent)), "a long, b long"), "links", True)
    drop_saved(wanted, pairs)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every row of df; component_id is the smallest id reachable by links."""
    if dict(df.dtypes)[id_col] == "bigint" and unique_ids(df, id_col):
        found = joined(df, id_col, text_col, size, percent)
        return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))
    rows = with_row_key(df.select(F.col(f"`{id_col}`").alias("_own"), text_of(text_col).alias("_text")), "_own", "_text")
    found = joined(rows, ROW, "_text", size, percent)
    names = rows.select(F.col(ROW).alias("_row"), "_own")  # keys sort as ids do, so the smallest key has the smallest id
    told = found.join(names, F.col("_id") == F.col("_row")).select(F.col("_own").alias(id_col), F.col("_n").alias("n_shingles"), "_component")
    return told.join(names, F.col("_component") == F.col("_row")).select(id_col, "n_shingles", F.col("_own").alias("component_id"))


def joined(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(_id, _n, _component) of every row of df, whose id is a bigint that no two rows share."""
    spark = df.sparkSession
    texts = df.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    told = save(texts.mapInArrow(lean(info_batches(size)), "_id long, _n long, _high long, _low long, _shingle long, _count long"), "info", True)
    info = told.filter("_n IS NOT NULL").drop("_shingle", "_count")
    counted = told.filter("_shingle IS NOT NULL").groupBy("_shingle").agg(F.sum("_count").alias("c"))
    # at most COMMON rows of two numbers: only the order of shingles and the way of a block depend on them, no result does
    common = counted.filter("c >= 16").orderBy(F.col("c").desc(), "_shingle").limit(COMMON).toPandas()
    hashes, counts = common["_shingle"].to_numpy(np.int64).view(np.uint64), common["c"].to_numpy(np.int64)
    ranks = np.lexsort((hashes, counts)).argsort() + 1 if len(hashes) else np.zeros(0, np.int64)
    place = np.argsort(hashes)
    order = (hashes[place], ranks[place], counts[place] >= HOT)

    alone = save(info.filter("_n = 0").select("_id", "_n", F.col("_id").alias("_component")), "alone", True)
    classes = save(with_group_first(info.filter("_n > 0"), ["_high", "_low"], "_id", "_class"), "classes")
    drop_saved(told)
    firsts = without_ids(texts, "_id", classes.filter("_id <> _class"), "_id")
    prints = firsts.mapInArrow(lean(print_batches(size, percent, order)), "_id long, _n long, _point binary, _first array<long>, _keys array<long>, _hot array<long>")
    prints = save(prints.filter("_n > 0"), "prints")

    # pass 1: grouping
    keyed = prints.select("_id", "_n", "_point", F.explode(F.array_distinct("_first")).alias("_key"))
    hubs = keyed.groupBy("_key").agg(F.min("_id").alias("_hub"), F.count("*").alias("_size")).filter("_size > 1")
    keyed = keyed.join(hubs, "_key").withColumn("_part", F.when(F.col("_id") == F.col("_hub"), F.lit(None)).otherwise(F.pmod(F.xxhash64("_id"), F.ceil(F.col("_size") / F.lit(BLOCK)))))
    parts = F.when(F.col("_part").isNull(), F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / F.lit(BLOCK)).cast("long") - 1)).otherwise(F.array(F.col("_part").cast("long")))
    keyed = keyed.select("_key", F.explode(parts).alias("_part"), (F.col("_id") != F.col("_hub")).cast("int").alias("_hub"), "_id", "_n", "_point", F.lit(0).alias("_label"))
    dealt = keyed.repartition(partitions(spark), "_key", "_part").sortWithinPartitions("_key", "_part", "_hub", "_id")
    pairs = dealt.mapInArrow(lean(pair_batches(percent, False)), "a long, b long").distinct()
    links = verified(save(pairs, "pairs", True), texts, size, percent)
    labels = components(links).withColumnsRenamed({"node": "_node", "component": "_label"})

    # pass 2: completing
    mixed = save(mixed_blocks(prints, labels).distinct(), "mixed")
    points = prints.select(F.col("_id").alias("_p"), "_n", "_point")
    columns = ["_key", "_part", "_lead", "_id", "_n", "_point", "_label", "_side", "_named"]
    whole = F.lit(0).cast("long").alias("_part"), F.lit(-1).alias("_side"), F.lit(None).cast("array<long>").alias("_named")
    large = save(mixed.groupBy("_lead").count().filter(F.col("count") > LEAD).select("_lead"), "large", True)
    small = mixed.join(large, "_lead", "left_anti").select("*", *whole).join(points, F.col("_id") == F.col("_p")).select(*columns)
    dealt = small.repartition(partitions(spark), "_lead").sortWithinPartitions("_lead", "_key", "_id")
    pairs = dealt.mapInArrow(lean(pair_batches(percent, True)), "a long, b long")
    if large.limit(1).count():
        cut = in_parts(mixed.join(large, "_lead", "left_semi")).join(points, F.col("_id") == F.col("_p")).select(*columns)
        dealt = cut.repartition(partitions(spark), "_key", "_part").sortWithinPartitions("_key", "_part", "_id")
        pairs = pairs.unionByName(dealt.mapInArrow(lean(pair_batches(percent, True)), "a long, b long"))
    pairs = save(pairs.distinct(), "pairs2", True)
    drop_saved(prints, mixed, large)
    more = verified(pairs, texts, size, percent)

    # equal sets are linked too, and components are named by the smallest id of all
    final = components(links.unionByName(more)).withColumnsRenamed({"node": "_node", "component": "_component"})
    drop_saved(links, more)
    out = classes.join(final, F.col("_class") == F.col("_node"), "left").select("_id", "_n", F.coalesce("_component", "_class").alias("_component"))
    return out.unionByName(alone)


def mixed_blocks(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """(_key, _lead, _id, _label): the rows of the completing pass's blocks that have more than one label."""
    spark = prints.sparkSession
    maybe, rest = id_filter(prints.select("_id", "_keys", "_hot"), "_id", labels, "_node")  # few documents have a label of another
    maybe = maybe.join(labels, F.col("_id") == F.col("_node"), "left").withColumn("_label", F.coalesce("_label", "_id")).drop("_node")
    known = rest.withColumn("_label", F.col("_id")).unionByName(maybe)
    dealt = known.select(F.explode("_keys").alias("_key"), "_id", "_label").repartition(partitions(spark), "_key").sortWithinPartitions("_key")
    cold = dealt.mapInArrow(lean(mixed_batches), "_key long, _lead long, _id long, _label long")
    hot = known.select(F.explode("_hot").alias("_hot_key"), "_id", "_label")
    leads = hot.groupBy("_hot_key").agg(F.min("_id").alias("_lead"), F.min("_label").alias("_x"), F.max("_label").alias("_y")).filter("_x <> _y")
    both = hot.join(F.broadcast(leads), "_hot_key")  # at most COMMON rows
    return cold.unionByName(both.select(F.xxhash64("_hot_key").alias("_key"), "_lead", "_id", "_label"))


def in_parts(mixed: DataFrame) -> DataFrame:
    """Blocks as pairs of parts: a row for each part that its own one meets, with its side there and the blocks its document names."""
    named = mixed.groupBy("_lead", "_id").agg(F.slice(F.array_sort(F.collect_set("_key")), 1, NAMED).alias("_named"))
    sizes = mixed.groupBy("_key", "_lead").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("_parts"))
    rows = mixed.join(named, ["_lead", "_id"]).join(sizes, ["_key", "_lead"]).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_parts").cast("long")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    part = F.least("_own", "_other").cast("long") * (1 << 31) + F.greatest("_own", "_other")
    side = F.when(F.col("_parts") == 1, -1).when(F.col("_own") == F.col("_other"), -1).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return rows.select("_key", part.alias("_part"), "_lead", "_id", "_label", side.alias("_side"), "_named")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """df with one row of each component: the one that names it."""
    unique = dict(df.dtypes)[id_col] == "bigint" and unique_ids(df, id_col)
    rows, key = (df, id_col) if unique else (with_row_key(df, id_col, text_col), ROW)
    gone = save(joined(rows, key, text_col, size, percent).filter("_id <> _component").select(F.col("_id").alias("_gone")), "near")
    left = without_ids(rows, key, gone, "_gone")
    return left if unique else left.drop(ROW)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.k + b.k - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, u) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u)
SELECT d.doc_id, coalesce(any_value(n.k), 0) AS n_shingles, coalesce(min(r.u), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.v = d.doc_id GROUP BY d.doc_id
"""
