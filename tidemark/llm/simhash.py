"""SimHash near-duplicates by a hierarchical index of fingerprints in Gray order.

Method: a fingerprint has a bit for each bit that is set in over half the hashes of a text's shingles. Distinct
fingerprints are sorted by their rank in the Gray code, which brings those of few differing bits together. Runs of eight
become leaves of an upper node that keeps the bits on which all agree, as a mask and a pattern; these nodes are grouped
in the same way up to one root. A query goes down from the root and adds up, node by node, the differences in the bits a
node newly fixes; where the sum passes the limit the whole group below is pruned. Every fingerprint is a query.

Scale: two fingerprints that differ in at most k bits agree on at least one of k + 1 blocks of bits, so each is sent to
k + 1 buckets and an index is built per bucket. A bucket of more than ``BUCKET`` fingerprints is split again by k + 1
blocks of the bits in which its fingerprints vary, as often as needed; as they are distinct, buckets run out of such bits
or become small, and no link is lost. Equal fingerprints are collapsed first by a partial aggregate. A task
returns one link per fingerprint to the least of its group, never all pairs. Components are found by alternating stars in
the shared folder.

Defined results: null, empty and wordless texts have the fingerprint zero and are linked like any other. Rows that share
a doc_id are rows each. Rows of null doc_id link other rows and give no component their id; a component of such rows only
is null. Other columns are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, table, written
from tidemark.llm.components import components

SHINGLE, SEED, BITS = 4, 42, 64
#: Differing bits of linked fingerprints.
LIMIT = 4
#: Fingerprints of a bucket, children of a node, and pairs of a query and a node followed at once.
BUCKET, FANOUT, FRONTIER = 1 << 14, 8, 1 << 21
#: Bytes of text hashed at once.
PIECE = 1 << 20
_WHITE = b" \t\n\r\x0b\x0c"
_U = np.uint64


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        found = text[at:end].lower().split()  # bytes know A-Z and the white characters \x20 and \x09-\x0D only
        if found:
            yield found
        at = end


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles of consecutive words; all words are one if they are fewer."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [*[s - 1 for s in starts[shingle:]], len(joined)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends, strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of a text's shingles."""
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for found in _pieces(text):
        found = tail + found
        if len(found) < shingle:
            tail = found
            continue
        hashes = _hashes(found, shingle)
        tail = found[len(found) - shingle + 1 :]
        for a in range(0, len(hashes), 1 << 15):
            part = hashes[a : a + (1 << 15)].astype("<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total and tail:
        (value,) = _hashes(tail, shingle).tolist()
        return value
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


_PRINT = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print) per row; a print is the fingerprint's bits as a signed integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = [fingerprint(rows.column(1)[i].as_py() or b"", shingle) for i in range(rows.num_rows)]
            yield batch(_PRINT, (rows.column(0), np.array(prints, np.uint64).view(np.int64)))

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return arrow_map(rows, work, "doc_id long, print long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of 64-bit words in the order of the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(shift))
    return x


class GrayIndex:
    """Hierarchical indexes over fingerprints, one per bucket; those of a bucket stand together.

    ``levels`` goes from the leaves up; a level has the pattern of the bits all below agree on, those bits, the bits its
    parent leaves open (on which the difference is still to be counted), and where the children begin.
    """

    def __init__(self, prints: np.ndarray, bucket: np.ndarray) -> None:
        order = np.lexsort((gray_rank(prints), bucket))
        self.prints, self.bucket = prints[order], bucket[order]
        pattern, mask, owner = self.prints, np.full(len(prints), ~_U(0)), self.bucket
        self.patterns, self.fresh, self.children, self.lasts = [pattern], [], [], [np.arange(len(prints))]
        while len(pattern) > 1 and (owner[1:] == owner[:-1]).any():
            begins = np.append(True, owner[1:] != owner[:-1])
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(begins, np.arange(len(owner)), 0))
            starts = np.flatnonzero(place % FANOUT == 0)
            parent = np.cumsum(place % FANOUT == 0) - 1
            agree = mask & ~(pattern ^ pattern[starts][parent])
            upper = np.bitwise_and.reduceat(agree, starts)
            self.fresh.append(mask & ~upper[parent])
            self.children.append(np.append(starts, len(owner)))
            self.lasts.append(self.lasts[-1][np.append(starts[1:], len(owner)) - 1])
            pattern, mask, owner = pattern[starts] & upper, upper, owner[starts]
            self.patterns.append(pattern)
        self.roots = owner

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, in Gray order of the fingerprints of a bucket that differ in at most so many bits."""
        n = len(self.prints)
        root = np.searchsorted(self.roots, self.bucket)
        width = np.bincount(root)[root]
        cuts = [0]
        total = np.cumsum(width)
        while cuts[-1] < n:
            spent = total[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, spent + FRONTIER, side="right"))))
        for a, b in zip(cuts, cuts[1:]):
            query, node = np.arange(a, min(b, n)), root[a:b]
            differ = np.zeros(len(query), np.uint8)
            for level in range(len(self.children) - 1, -1, -1):
                first, after = self.children[level][node], self.children[level][node + 1]
                size = after - first
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                query, differ = np.repeat(query, size), np.repeat(differ, size)
                open_ = (self.prints[query] ^ self.patterns[level][at]) & self.fresh[level][at]
                differ = differ + np.bitwise_count(open_)
                near = (differ <= limit) & (self.lasts[level][at] > query)
                query, node, differ = query[near], at[near], differ[near]
            apart = node > query
            yield query[apart], node[apart]


def least_connected(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n the least it is connected to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    return root


def blocks_of(bits: list[int], parts: int) -> list[int]:
    """Bits dealt out to blocks, as masks."""
    return [sum(1 << b for b in bits[k::parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _indexed(limit: int):
    """Links within each bucket (mask, value), whose rows come together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for rows in batches:
            held = np.concatenate([held, np.stack([rows.column(k).to_numpy() for k in range(3)])], axis=1)
            last = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0))
            if len(last) and held.shape[1] >= BUCKET:
                yield from links(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
        yield from links(held)

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))[: rows.shape[1]]
        bucket = np.cumsum(begins)
        several = np.bincount(bucket)[bucket] > 1
        if not several.any():
            return
        index = GrayIndex(rows[2][several].view(np.uint64), bucket[several])
        root = least_connected(len(index.prints), index.pairs(limit))
        other = np.flatnonzero(root != np.arange(len(root)))
        prints = index.prints.view(np.int64)
        yield batch(_LINK, (prints[other], prints[root[other]]))

    return work


_WIDER = pa.schema([(c, pa.int64()) for c in ("of_mask", "of_value", "wider")])


def _split(limit: int):
    """Buckets (mask, value, n, counts of set bits) once for each block of the varying bits, with the mask widened by it.

    Bits are dealt out from the most balanced on, so that every block parts the bucket.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for mask, value, n, ones in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
                varying = sorted((b for b in range(BITS) if 0 < ones[b] < n), key=lambda b: (abs(2 * ones[b] - n), b))
                for block in blocks_of(varying, limit + 1):
                    out.append((mask, value, _signed(mask % (1 << BITS) | block)))
            if out:
                yield batch(_WIDER, zip(*out, strict=True))

    return work


def near_prints(prints: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct prints of at most so many differing bits."""
    bucket = max(bucket, 1 << (limit + 1))  # so that a larger one has a varying bit for each block
    blocks = F.array(*[F.lit(_signed(b)).cast("long") for b in blocks_of(list(range(BITS)), limit + 1)])
    ones = F.array(*[F.sum(F.shiftrightunsigned("print", b).bitwiseAND(1)) for b in range(BITS)])
    same = (F.col("mask") == F.col("of_mask")) & (F.col("value") == F.col("of_value"))
    rows = prints.select("print", F.explode(blocks).alias("mask"))
    links = []
    while True:
        rows = written(rows.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print"), "buckets")
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
        large = written(sizes.select(F.col("mask").alias("of_mask"), F.col("value").alias("of_value")), "large")
        split = not large.isEmpty()
        small = rows.join(large, same, "left_anti") if split else rows
        small = small.repartition("mask", "value").sortWithinPartitions("mask", "value")
        links.append(arrow_map(small.select("mask", "value", "print"), _indexed(limit), "a long, b long"))
        if not split:
            break
        counted = rows.join(large, same).groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))
        wider = arrow_map(counted, _split(limit), "of_mask long, of_value long, wider long")
        # Widened in another order, two buckets may become one.
        rows = rows.join(wider, same).select("print", F.col("wider").alias("mask")).distinct()
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(documents: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    found = written(fingerprints(documents, shingle), "prints")
    prints = written(found.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_prints(prints.select("print"), limit, bucket))
    prints = prints.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    least = prints.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    prints = prints.join(least, F.col("root") == F.col("of")).select(F.col("print").alias("same"), "component_id")
    found = found.join(prints, F.col("print") == F.col("same"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash": query}
#: SQL has no XXH64; tests/llm compares with brute force.
ORACLE = {"op13_simhash": None}
