"""N-gram Jaccard join: a size-aware heavy-light join of word shingle sets.

Method: a global order of shingles puts the frequent ones last. A pair of sets that agree to the threshold shares at
least k of the first d + k shingles of each, where d is the number of shingles a set may lack. Small sets enumerate all
subsets of size two of their first d + 2 shingles and meet where a subset is equal. Large sets post their first d + 1
shingles to inverted lists, which are scanned; small sets that may match a large one post there as well. The boundary
between small and large is where the measured costs of both ways cross. Short lists drop pairs whose sizes or places of
the shared shingle rule a match out. What is left is verified on whole sets.

Scale: equal sets are collapsed first, by a partial aggregate, so a group of copies costs one set. Lists with the same
members are scanned once, and lists that share members are scanned together where that ships fewer sets. A crowded list
is parted by sizes, and the sets of what is crowded still by equal parts of their shingles, one of which similar sets
have; a row is made once a size or a part and not once a block of the list. What is long after that, as near copies are,
is cut into blocks and scanned as pairs of blocks by different tasks, so a task holds two blocks at most. Intersections are
counted pair by pair for rare shingles and by products of the incidence matrix for others, and a task returns one link
per member to the least it is connected to, never all pairs. Only the order's ``HEAVY`` most frequent shingles are broadcast; they
change speed, not results: any order gives the same links.

Defined results: null, empty and wordless texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle. Rows that share a doc_id are one document for linking, each with its own n_shingles. Rows of null
doc_id link with nothing. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, byte_columns, forget, kept_in_worker, mixed, range_hashes, slices, table, words, written
from tidemark.llm.components import components

SHINGLE = 3
THRESHOLD = (90, 100)
#: Shingles known to be frequent, which come last in the order, and how many a batch proposes.
HEAVY = 1 << 18
PROPOSED = 1 << 15
#: Lists of more members are scanned as a whole; in shorter ones pairs are told apart by size and position first.
SHORT_LIST = 32
#: Members and shingles of a block of a list.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Homes of a list whose sets are compared by home.
HOMES = 8
#: Shingles of at most so many sets of a group are counted pair by pair.
LIGHT = 16
_MATRIX = 1 << 22
#: Bits of the sketch of a set, at most.
SKETCH_BITS = 1 << 13


class Sets:
    """Distinct shingles of texts laid end to end, sorted within each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> None:
        starts, ends, n_words = words(data, bounds)
        hashes = range_hashes(data, starts, ends, lower=True)
        n = len(n_words)
        owner = np.repeat(np.arange(n), n_words)
        first = np.cumsum(n_words) - n_words
        place = np.arange(len(hashes)) - first[owner]
        size = np.minimum(shingle, n_words)[owner]
        begins = place <= n_words[owner] - size
        at, size, owner = np.flatnonzero(begins), size[begins], owner[begins]
        h = mixed(size.astype(np.uint64))
        for k in range(shingle):
            inside = k < size
            step = np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0)) if len(at) else h
            h = np.where(inside, mixed(h * np.uint64(0x9E3779B97F4A7C15) + step), h)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.shingles, self.owner = h[fresh], owner[fresh]
        self.sizes = np.bincount(self.owner, minlength=n)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that are equal for equal sets."""
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(self.shingles ^ np.uint64(salt)))))
            out.append((sums[self.bounds[1:]] - sums[self.bounds[:-1]]).view(np.int64))
        return out[0], out[1]

    def part_keys(self, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Owners and keys of sets, of which any two similar sets share one.

        Sets of two neighbouring classes of sizes are parted by a hash of the shingle into one part more than similar
        ones may differ in shingles, so one part at least is equal in both. A key is the sum of a part.
        """
        num, den = threshold
        step = class_step(threshold)
        own = np.floor(np.log(np.maximum(self.sizes, 1)) / step).astype(np.int64)
        dealt, value = (mixed(self.shingles ^ np.uint64(salt)) for salt in (0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35))
        owners, keys = [], []
        for group in (own, own - 1):
            most = np.floor(np.exp((group + 2) * step)).astype(np.int64) + 1
            parts = np.where(self.sizes > 0, (den - num) * 2 * most // (num + den) + 1, 0)
            ends = np.concatenate(([0], np.cumsum(parts)))
            sums = np.zeros(int(ends[-1]), np.uint64)
            np.add.at(sums, ends[self.owner] + (dealt % parts[self.owner].astype(np.uint64)).astype(np.int64), value)
            owner = np.repeat(np.arange(len(parts)), parts)
            place = (group[owner] << 32) + np.arange(len(owner)) - ends[owner]
            owners.append(owner)
            keys.append(mixed(sums ^ mixed(place.view(np.uint64))).view(np.int64))
        return np.concatenate(owners), np.concatenate(keys)

    def sketches(self) -> pa.ListArray:
        """For each set the parity, bit by bit, of how many of its shingles fall on the bit.

        A shingle that only one of two sets has changes one bit, so the sets differ in at least as many shingles as their
        sketches do in bits. A sketch has about a bit a shingle; folded in half it is the sketch of half the bits.
        """
        bits = np.clip(1 << np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64), 64, SKETCH_BITS)
        ends = np.concatenate(([0], np.cumsum(bits)))
        at = mixed(self.shingles ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64) & (bits - 1)[self.owner]
        odd = np.bincount(ends[self.owner] + at, minlength=int(ends[-1])) & 1
        flat = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
        return pa.ListArray.from_arrays(pa.array((ends // 64).astype(np.int32)), pa.array(flat))


_COUNTED = pa.schema([("shingle", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("repeated", pa.int64())])


def _proposed(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The most frequent shingles of texts with their counts; how many there are in all, and of shingles that repeat.

    The shingles are held once and sorted in place.
    """
    found = np.concatenate(
        [Sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle).shingles for a, b in slices(bounds)]
    )
    found.sort()
    fresh = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    n = np.diff(first, append=len(found))
    often = np.flatnonzero(n > 2)
    top = often[np.argsort(-n[often], kind="stable")[:PROPOSED]]
    return found[first[top]], n[top], len(found), int(n[n > 1].sum())


def shingle_statistics(documents: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The most frequent shingles in order with their counts, and the share of shingles that occur again near by."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, bounds = byte_columns(rows.column(0))
            for i, j in slices(bounds, 16 << 20):
                shingles, n, total, repeated = _proposed(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)
                yield batch(_COUNTED, (shingles.view(np.int64), n, np.zeros(len(n)), np.zeros(len(n))))
                yield batch(_COUNTED, ([None], [None], [total], [repeated]))

    rows = arrow_map(documents.select(F.col("text").cast("string")), propose, "shingle long, n long, total long, repeated long")
    rows = rows.groupBy("shingle").agg(*[F.sum(c).alias(c) for c in ("n", "total", "repeated")])
    heavy = rows.orderBy(F.col("shingle").isNull().desc(), F.desc("n"), "shingle").limit(HEAVY + 1).toPandas()
    whole, heavy = heavy[heavy["shingle"].isna()], heavy[heavy["shingle"].notna()]
    share = float((whole["repeated"] / whole["total"].clip(lower=1)).iloc[0]) if len(whole) else 0.0
    shingles = heavy["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], heavy["n"].to_numpy(np.int64)[order], share


def may_lack(n: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """How many shingles of a set of n may be missing in a similar set."""
    num, den = threshold
    return n - (num * n + den - 1) // den


def class_step(threshold: tuple[int, int] = THRESHOLD) -> float:
    """How much the logarithms of sizes of a class differ. Sizes of similar sets are of one class or neighbouring ones."""
    num, den = threshold
    return float(np.log(max(den / num, 1.01))) * (1 + 1e-9)


def cost_boundary(repeated: float, threshold: tuple[int, int] = THRESHOLD) -> int:
    """The largest set for which meeting by subsets costs no more than scanning lists.

    A key costs its bytes in the shuffle, and the set it ships if the key is met again. A shingle is met again with the
    measured share, a pair of shingles with the square of it.
    """
    n = np.arange(1, 10_001)
    d = may_lack(n, threshold)
    lists = (d + 1) * (16 + repeated * 8 * n)
    subsets = (d + 2) * (d + 1) / 2 * (16 + repeated**2 * 8 * n)
    worth = (subsets <= lists) | (d == 0)
    return int(n[: worth.argmin()].max(initial=1)) if not worth.all() else int(n[-1])


class _Order:
    def __init__(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        self.shingles, self.counts = shingles, counts
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """0 for a shingle that is not known to be frequent, else its count."""
        out = np.zeros(len(shingles), np.int64)
        near = np.flatnonzero(self.maybe[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(near) and len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingles[near]), len(self.shingles) - 1)
            same = self.shingles[at] == shingles[near]
            out[near[same]] = self.counts[at[same]]
        return out


def _keys(sets: Sets, order: _Order, boundary: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and meeting keys of sets: list postings and, for small sets, subsets of size two."""
    ranked = np.lexsort((sets.shingles, order.weights(sets.shingles), sets.owner))
    place = np.arange(len(ranked)) - sets.bounds[sets.owner]
    n = sets.sizes
    lack = may_lack(n, threshold)
    num, den = threshold
    # A small set meets large ones in the lists if its size allows a match above the boundary.
    posts = den * n >= num * (boundary + 1)
    listed = (place <= lack[sets.owner]) & posts[sets.owner]
    owners, keys = [sets.owner[listed]], [mixed(sets.shingles[ranked[listed]] ^ np.uint64(0xA5A5))]
    # A set that may lack nothing still meets one that has a shingle more, if the threshold admits that.
    for i in np.flatnonzero((n <= boundary) & ((lack > 0) | (den * n >= num * (n + 1)))):
        first = np.sort(sets.shingles[ranked[sets.bounds[i] : sets.bounds[i] + lack[i] + 2]])
        a, b = np.triu_indices(len(first), 1)
        owners.append(np.full(len(a), i))
        keys.append(mixed(mixed(first[a]) * np.uint64(0x9E3779B97F4A7C15) + first[b]))
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    by = np.argsort(owners, kind="stable")
    return owners[by], keys[by].view(np.int64)


_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
    + [("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
)


def _sketches(documents: DataFrame, order: _Order, boundary: int, threshold: tuple[int, int], shingle: int) -> DataFrame:
    spread = documents.sparkSession.sparkContext.broadcast(order)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, bounds = byte_columns(rows.column(2))
            for i, j in slices(bounds):
                sets = Sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)
                owners, keys = _keys(sets, spread.value, boundary, threshold)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=j - i)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
                s1, s2 = sets.signatures()
                own = [rows.column(c).slice(i, j - i) for c in (0, 1)]
                yield batch(_SKETCH, (*own, sets.sizes, s1, s2, lists, sets.sketches()))

    return arrow_map(_texts(documents), sketch, "doc_id long, t long, n long, s1 long, s2 long, keys array<long>, sketch array<long>")


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, t, text): t is a hash that tells the texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _shared(n: int, owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many values each two of n owners share; no owner has a value twice, and owners rise."""
    _, which, df = np.unique(value, return_inverse=True, return_counts=True)
    by = np.argsort(which, kind="stable")
    owner, which, df = owner[by], which[by], df[which[by]]
    inter = np.zeros((n, n), np.float32)
    # Light values: each pair of their few owners.
    light = df <= LIGHT
    few, own = which[light], owner[light]
    for apart in range(1, min(LIGHT, len(few))):
        same = np.flatnonzero(few[apart:] == few[:-apart])
        if not len(same):
            break
        pairs, times = np.unique(own[same] * n + own[same + apart], return_counts=True)
        inter[pairs // n, pairs % n] += times
        inter[pairs % n, pairs // n] += times
    # Heavy values: products of the incidence matrix, some columns at a time.
    owner, column = owner[~light], which[~light]
    fresh = np.append(True, column[1:] != column[:-1]) if len(column) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    width = max(1, _MATRIX // max(n, 1))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((n, int(column[hi - 1]) - a + 1), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        inter += part @ part.T
    return inter


def _roots(near: np.ndarray) -> np.ndarray:
    """For each of n the least it is connected to by a symmetric matrix."""
    n = len(near)
    root = np.arange(n, dtype=np.int32)
    while True:
        least = root.copy()
        for a in range(0, n, 256):
            own = np.where(near[a : a + 256], root[None, :], np.int32(n)).min(axis=1, initial=n)
            least[a : a + 256] = np.minimum(root[a : a + 256], own)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _met(sets: Sets, threshold: tuple[int, int]) -> np.ndarray:
    """For each set the least number of a set it is connected to by links within this group."""
    n, num, den = len(sets.sizes), *threshold
    inter = _shared(n, sets.owner, sets.shingles)
    inter[np.arange(n), np.arange(n)] = sets.sizes
    near = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        shared = np.rint(inter[a : a + 256]).astype(np.int64)
        union = sets.sizes[a : a + 256, None] + sets.sizes[None, :] - shared
        near[a : a + 256] = (den * shared >= num * union) & (union > 0)
    return _roots(near)


def _plausible(n: np.ndarray, sketches: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """For each set the least it is connected to by pairs that may be similar, from sizes and sketches alone."""
    num, den = threshold
    width = np.array([len(x) for x in sketches])
    folded = {}
    for w in np.unique(width).tolist():
        wide = width >= w
        rows = np.zeros((len(n), w), np.uint64)
        rows[wide] = [np.bitwise_xor.reduce(x.view(np.uint64).reshape(-1, w), axis=0) for x, y in zip(sketches, wide, strict=True) if y]
        folded[w] = rows
    near = np.zeros((len(n), len(n)), bool)
    for a in range(0, len(n), 256):
        x, y = n[a : a + 256, None], n[None, :]
        i, j = np.nonzero(den * np.minimum(x, y) >= num * np.maximum(x, y))
        i, j = i[i + a < j] + a, j[i + a < j]
        least = np.minimum(width[i], width[j])
        for w, rows in folded.items():
            of = np.flatnonzero(least == w)
            for k in range(0, len(of), _MATRIX // 64 // w + 1):
                p, q = i[of[k : k + _MATRIX // 64 // w + 1]], j[of[k : k + _MATRIX // 64 // w + 1]]
                differ = np.bitwise_count(rows[p] ^ rows[q]).sum(axis=1, dtype=np.int64)
                close = (num + den) * differ <= (den - num) * (n[p] + n[q])
                near[p[close], q[close]] = True
    return _roots(near | near.T)


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ, or null where one is more than twice as wide as the other."""

    def half(a: Column) -> Column:
        n = (F.size(a) / 2).cast("int")
        return F.zip_with(F.slice(a, 1, n), F.slice(a, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    x, y = (F.when(F.size(p) == 2 * F.size(q), half(p)).otherwise(p) for p, q in ((x, y), (y, x)))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows that agree in the first columns and stand together, as slices of batches."""
    open_key, group = None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        by = np.stack([rows.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(by[:, a].tolist())
            if key != open_key and group:
                yield open_key, group
                group = []
            open_key = key
            group.append(rows.slice(a, b - a))
    if group:
        yield open_key, group


_SUBLIST = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("hub", pa.int64()), ("member", pa.int64())])


def _sublists(lists: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Parts of lists, by block pair, within which sets may be similar: (key, i, j, hub, member)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches, 3):
            rows = pa.Table.from_batches(group).combine_chunks()
            order = np.argsort(rows["member"].to_numpy(), kind="stable")
            member, n = rows["member"].to_numpy()[order], rows["n"].to_numpy()[order]
            flat, ends = rows["sketch"].chunk(0).flatten().to_numpy(), rows["sketch"].chunk(0).offsets.to_numpy()
            sketches = [flat[ends[k] - ends[0] : ends[k + 1] - ends[0]] for k in order.tolist()]
            root = _plausible(n, sketches, threshold)
            several = np.bincount(root, minlength=len(n))[root] > 1
            member, hub = member[several], member[root][several]
            yield batch(_SUBLIST, (*[np.full(len(member), k) for k in key], hub, member))

    order = lists.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return arrow_map(order.select("key", "i", "j", "member", "n", "sketch"), part, "key long, i int, j int, hub long, member long")


def _scanned(members: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """Links within each block pair (kind, key, i, j), whose rows come together in order."""

    def links(group: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([g[0] for g in group])
        if len(ids) < 2:
            return
        data = np.concatenate([g[1] for g in group])
        lengths = np.concatenate([np.diff(g[2]) for g in group])
        order = np.argsort(ids, kind="stable")
        sets = _sets_of(data, np.concatenate(([0], np.cumsum(lengths))), order, shingle)
        root = _met(sets, threshold)
        ids = ids[order]
        other = ids != ids[root]
        if other.any():
            yield batch(_LINK, (ids[other], ids[root][other]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 4):
            yield from links([(r.column(4).to_numpy(), *byte_columns(r.column(5))) for r in parts])

    order = members.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j")
    return arrow_map(order.select("kind", "key", "i", "j", "doc_id", "text"), scan, "a long, b long")


def _sets_of(data: np.ndarray, bounds: np.ndarray, order: np.ndarray, shingle: int) -> Sets:
    """Sets of texts in the given order, worked out slice by slice."""
    parts = [Sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle) for i, j in slices(bounds)]
    sizes = np.concatenate([p.sizes for p in parts])
    shingles = np.concatenate([p.shingles for p in parts])
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = parts[0]
    out.sizes = sizes[order]
    out.owner = np.repeat(np.arange(len(order)), out.sizes)
    out.bounds = np.concatenate(([0], np.cumsum(out.sizes)))
    out.shingles = shingles[np.repeat(at[order] - out.bounds[:-1], out.sizes) + np.arange(int(out.bounds[-1]))]
    return out


def _blocks(sets: Column, shingles: Column, block_sets: int) -> Column:
    return F.ceil(F.greatest(sets / block_sets, shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of (member, kind, key, blocks) once for each pair of blocks their member belongs to."""
    whole = rows.where("blocks = 1").select("member", "kind", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows = rows.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    rows = rows.select("member", "kind", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("member", "kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return whole.unionByName(rows)


def _grouped(rows: DataFrame, block_sets: int) -> DataFrame:
    """Rows (member, key) of groups of several members with their blocks; of groups with the same members one."""
    rows = rows.select("member", "key")
    groups = rows.groupBy(F.col("key").alias("of")).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64("member").cast("decimal(20,0)")).alias("who"),
        F.min("member").alias("hub"),
    )
    groups = groups.where("members > 1").groupBy("members", "who", "hub").agg(F.min("of").alias("of"))
    groups = groups.select("of", F.ceil(F.col("members") / block_sets).cast("int").alias("blocks"))
    return rows.join(groups, F.col("key") == F.col("of")).drop("of")


def _uncrowded(
    lists: DataFrame, documents: DataFrame, classes: DataFrame, threshold: tuple[int, int], block_sets: int, shingle: int
) -> DataFrame:
    """(member, key, i, j) of long lists (member, n, key, blocks): what may be similar meets in some (key, i, j).

    Only groups of a size class and its neighbour that are crowded still are parted by equal parts of their sets, and only
    what agrees in a part and is crowded still is dealt by pairs of blocks.
    """
    own = F.floor(F.log("n") / class_step(threshold))
    crowded = lists.where("blocks > 1")
    sizes = [crowded.select("member", F.xxhash64("key", of).alias("key")) for of in (own, own - 1)]
    sized = written(_grouped(sizes[0].unionByName(sizes[1]), block_sets), "sized")
    crowd = sized.where("blocks > 1").select("member").distinct()
    at = classes.select("node", F.col("rep").alias("of_doc"), F.col("t").alias("of_t"))
    crowd = crowd.join(at, F.col("member") == F.col("node"))
    texts = _texts(documents).join(crowd, (F.col("doc_id") == F.col("of_doc")) & (F.col("t") == F.col("of_t")))
    # A row of each set: rows may repeat a doc_id and its text.
    parts = written(_part_keys(texts, threshold, shingle).distinct(), "parts")
    alike = written(_grouped(parts, block_sets), "alike", done=[parts])
    whole = [lists.where("blocks = 1"), sized.where("blocks = 1"), alike]
    kinds = [rows.select("member", F.lit(i).alias("kind"), "key", "blocks") for i, rows in enumerate(whole)]
    dealt = _dealt(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))
    return dealt.select("member", F.xxhash64("kind", "key").alias("key"), "i", "j")


_PART = pa.schema([("member", pa.int64()), ("key", pa.int64())])


def _part_keys(texts: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            member = rows.column(0).to_numpy()
            data, bounds = byte_columns(rows.column(1))
            for i, j in slices(bounds):
                sets = Sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)
                owners, found = sets.part_keys(threshold)
                yield batch(_PART, (member[i:j][owners], found))

    return arrow_map(texts.select("member", "text"), keys, "member long, key long")


def _members(
    documents: DataFrame, classes: DataFrame, boundary: int, threshold: tuple[int, int], block_sets: int, shingle: int
) -> DataFrame:
    """(member, kind, key, i, j): which sets are compared where.

    Short lists give pairs that may be similar by their sizes and by the places of the shared shingle: what stands before
    the first shared shingle of a similar pair is no more than the pair may differ by. Of these, pairs whose sketches
    differ in more bits than similar sets may in shingles are dropped. Long lists are parted by their members' sketches
    in the same way; those with the same members once. Pairs and lists that share members form clusters. A cluster is compared as a whole, once,
    if that sends its sets to fewer places than its pairs and lists would; else it is compared by homes.
    """
    num, den = threshold
    posted = classes.select(F.col("node").alias("member"), "n", F.posexplode("keys").alias("at", "key"))
    posts, lack = den * F.col("n") >= num * (boundary + 1), F.col("n") - F.ceil(num * F.col("n") / den)
    placed = posts & (F.col("at") <= lack)
    sketched = classes.select("node", "n", "sketch")
    posted = posted.withColumns({"at": F.when(placed, F.col("at")).otherwise(0), "placed": placed})
    lists = posted.groupBy(F.col("key").alias("of")).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64("member").cast("decimal(20,0)")).alias("who"),
        F.min("member").alias("hub"),
    )
    lists = lists.where("members > 1")
    listed = written(posted.join(lists, F.col("key") == F.col("of")).drop("of"), "listed")
    short = listed.where(F.col("members") <= SHORT_LIST).select("key", "member", "n", "at")
    other = short.select(*[F.col(c).alias(f"_{c}") for c in short.columns])
    both = F.col("n") + F.col("_n")
    may_match = (
        (F.col("key") == F.col("_key"))
        & (F.col("member") < F.col("_member"))
        & (den * F.least("n", "_n") >= num * F.greatest("n", "_n"))
        & (F.col("at") + F.col("_at") <= both - 2 * F.ceil(num * both / (num + den)))
    )
    pairs = short.join(other, may_match).select(F.col("member").alias("a"), F.col("_member").alias("b")).distinct()
    x, y = (sketched.select(*[F.col(c).alias(f"{side}_{c}") for c in sketched.columns]) for side in ("x", "y"))
    pairs = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    far = (num + den) * _apart(F.col("x_sketch"), F.col("y_sketch")) > (den - num) * (F.col("x_n") + F.col("y_n"))
    pairs = written(pairs.where(~F.coalesce(far, F.lit(False))).select("a", "b"), "pairs")
    long = listed.where(F.col("members") > SHORT_LIST)
    once = long.groupBy("members", "who", "hub").agg(F.min("key").alias("of"))
    long = long.join(once.select("of"), F.col("key") == F.col("of"))
    # The lists of a key's postings and of its subsets are parted in the same way. Only sketches are sent, so that a block
    # is bounded by its sets alone.
    blocks = F.ceil(F.col("members") / block_sets).cast("int").alias("blocks")
    long = long.select("member", "n", F.xxhash64(F.col("placed").cast("int"), "key").alias("key"), blocks)
    long = _uncrowded(long, documents, classes, threshold, block_sets, shingle)
    parts = _sublists(long.join(sketched, F.col("member") == F.col("node")), threshold)
    long = written(parts.select("member", "hub", F.xxhash64("key", "i", "j", "hub").alias("key")), "long", done=[listed])
    ends = pairs.select(F.explode(F.array("a", "b")).alias("member"), F.xxhash64("a", "b").alias("key"))
    places = ends.withColumn("kind", F.lit(2)).unionByName(long.drop("hub").withColumn("kind", F.lit(1)))
    places = places.withColumn("blocks", F.lit(1))
    clusters = components(pairs.unionByName(long.select(F.col("member").alias("a"), F.col("hub").alias("b"))))
    sets = places.groupBy("member").agg(F.sum("blocks").alias("sent"))
    sets = sets.join(clusters, F.col("member") == F.col("node"), "left")
    sets = sets.join(classes.select("node", "n").withColumnRenamed("node", "_node"), F.col("member") == F.col("_node"))
    sets = sets.select("member", "n", "sent", F.coalesce("root", "member").alias("cluster"))
    sizes = sets.groupBy(F.col("cluster").alias("of")).agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"), F.sum("sent").alias("sent")
    )
    sizes = sizes.withColumn("parts", _blocks(F.col("sets"), F.col("shingles"), block_sets))
    sizes = sizes.select("of", "parts", (F.col("parts") * F.col("sets") <= F.col("sent")).alias("whole"))
    sets = written(sets.join(sizes, F.col("cluster") == F.col("of")).select("member", "cluster", "parts", "whole"), "clusters")
    by_cluster = sets.where("whole").select("member", F.lit(0).alias("kind"), F.col("cluster").alias("key"), F.col("parts").alias("blocks"))
    apart = sets.where("not whole").select(F.col("member").alias("_member"))
    by_home = _by_home(places.join(apart, F.col("member") == F.col("_member")).select("member", "key"))
    return _dealt(by_cluster).unionByName(by_home.withColumns({"i": F.lit(0), "j": F.lit(0)})).distinct()


def _by_home(places: DataFrame) -> DataFrame:
    """(member, kind, key): each list or pair of (member, key) covered by few groups that many of them share.

    The home of a set is the longest list it is in. The sets of a list are compared in the groups of each two of their
    homes, so sets that share many lists, as near copies do, are sent once for each two homes and not once a list. A list
    of more than ``HOMES`` homes is a group of its own.
    """
    places = written(places, "places")
    lengths = places.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("length"))
    homes = places.join(lengths, F.col("key") == F.col("of"))
    homes = homes.groupBy("member").agg(F.max(F.struct("length", "key")).getField("key").alias("home"))
    homed = places.join(homes.withColumnRenamed("member", "_member"), F.col("member") == F.col("_member")).select("member", "key", "home")
    homed = written(homed, "homes", done=[places])
    met = homed.select(F.col("key").alias("of"), F.col("home").alias("other")).distinct()
    many = met.groupBy("of").agg(F.count(F.lit(1)).alias("homes"))
    met = met.join(many.withColumnRenamed("of", "_of"), F.col("of") == F.col("_of")).where(F.col("homes") <= HOMES)
    together = homed.join(met, F.col("key") == F.col("of"))
    together = together.select(
        "member", F.lit(2).alias("kind"), F.xxhash64(F.least("home", "other"), F.greatest("home", "other")).alias("key")
    )
    alone = homed.join(many.where(F.col("homes") > HOMES), F.col("key") == F.col("of"))
    return together.distinct().unionByName(alone.select("member", F.lit(1).alias("kind"), "key"))


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: s1, s2, n, keys, sketch, the first of its texts (rep, t) and a node that is its own.

    The node is the doc_id, but where a doc_id is the least of several classes all but one of them have a hash instead.
    """
    first = F.min(F.struct("doc_id", "t"))
    classes = rows.groupBy("s1", "s2", "n").agg(first.alias("first"), *[F.any_value(c).alias(c) for c in ("keys", "sketch")])
    classes = classes.select("s1", "s2", "n", "keys", "sketch", F.col("first.doc_id").alias("rep"), F.col("first.t").alias("t"))
    classes = written(classes, "classes")
    own = F.struct("s1", "s2", "n")
    clashes = classes.groupBy(F.col("rep").alias("of")).agg(F.count(F.lit(1)).alias("classes"), F.min(own).alias("lead"))
    clashes = written(clashes.where("classes > 1"), "clashes")
    if clashes.isEmpty():
        # Nothing to join then, in any of the steps that read the classes.
        forget(clashes)
        return classes.withColumn("node", F.col("rep"))
    classes = classes.join(clashes, F.col("rep") == F.col("of"), "left")
    plain = F.col("lead").isNull() | (own == F.col("lead"))
    node = F.when(plain, F.col("rep")).otherwise(F.xxhash64("rep", "s1", "s2", "n"))
    return classes.withColumn("node", node).drop("of", "classes", "lead")


def _linked(
    documents: DataFrame, threshold: tuple[int, int], boundary: int | None, block_sets: int, shingle: int
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, node, group) per row, and links (a, b) between nodes.

    The node of a row's set is null where it links with nothing. Links connect the nodes of similar sets.
    """
    shingles, counts, repeated = shingle_statistics(documents, shingle)
    if boundary is None:
        boundary = cost_boundary(repeated, threshold)
    sketches = written(_sketches(documents, _Order(shingles, counts), boundary, threshold, shingle), "sketches")
    classes = _classes(sketches.where("n > 0 and doc_id is not null"))
    members = _members(documents, classes, boundary, threshold, block_sets, shingle)
    at = classes.select("node", F.col("rep").alias("of_doc"), F.col("t").alias("of_t"))
    members = members.join(at, F.col("member") == F.col("node")).drop("node")
    texts = _texts(documents).join(members, (F.col("doc_id") == F.col("of_doc")) & (F.col("t") == F.col("of_t")))
    links = written(_scanned(texts.drop("doc_id").withColumnRenamed("member", "doc_id"), threshold, shingle), "links")
    nodes = classes.select("s1", "s2", "n", "node", "rep")
    rows = sketches.select("doc_id", "t", "n", "s1", "s2").join(nodes, ["s1", "s2", "n"], "left")
    apart = (F.col("n") == 0) | F.col("doc_id").isNull()
    rows = rows.select("doc_id", "t", "n", F.when(~apart, F.col("node")).alias("node"))
    return written(rows, "nodes", done=[sketches]), links


def similar_documents(
    documents: DataFrame,
    threshold: tuple[int, int] = THRESHOLD,
    boundary: int | None = None,
    block_sets: int = BLOCK_SETS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, links = _linked(documents, threshold, boundary, block_sets, shingle)
    # Rows of one doc_id are one document, so their sets are linked.
    own = rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    own = own.where("least < most").select(F.col("doc_id").alias("of"), "least")
    own = rows.join(own, F.col("doc_id") == F.col("of")).where("node > least")
    roots = components(links.unionByName(own.select(F.col("least").alias("a"), F.col("node").alias("b"))))
    rows = rows.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    rows = rows.select("doc_id", "n", F.coalesce("root", "node").alias("group"))
    least = rows.where("group is not null").groupBy(F.col("group").alias("of")).agg(F.min("doc_id").alias("component_id"))
    found = rows.join(least, F.col("group") == F.col("of"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of similar texts, that of the smallest doc_id, then of the smallest hash of the text.

    Rows are judged by their texts: of two rows of one doc_id that are not similar both stay, also if other documents are
    similar to one of them. Rows of one doc_id and one text become one. Rows without words or doc_id stay.
    """
    rows, links = _linked(documents, threshold, None, BLOCK_SETS, shingle)
    roots = components(links).withColumnRenamed("node", "_node")
    rows = rows.where("node is not null").groupBy("doc_id", "t", "node").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(roots, F.col("node") == F.col("_node"), "left").withColumn("group", F.coalesce("root", "node"))
    picked = rows.groupBy(F.col("group").alias("of")).agg(F.min(F.struct("doc_id", "t")).alias("pick"))
    rows = rows.join(picked, F.col("group") == F.col("of"))
    judged = rows.select(F.col("doc_id").alias("of_doc"), F.col("t").alias("of_t"), (F.struct("doc_id", "t") == F.col("pick")).alias("stays"), "copies")
    judged = written(judged.where("not stays or copies > 1"), "judged", done=[])
    text = F.xxhash64(F.col("row.text").cast("string"))
    docs = documents.select(F.struct("*").alias("row")).withColumns({"doc": F.col("row.doc_id").cast("long"), "of": text})
    same = (F.col("doc") == F.col("of_doc")) & (F.col("of") == F.col("of_t"))
    single = docs.join(judged, same, "left_anti")
    repeated = docs.join(judged.where("stays"), same).dropDuplicates(["doc", "of"])
    return single.select("row.*").unionByName(repeated.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN sym ON r = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

QUERIES = {"op1_ngram_join": query}
ORACLE = {"op1_ngram_join": SQL}
