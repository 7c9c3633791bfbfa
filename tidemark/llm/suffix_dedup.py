"""Suffix-array dedup of repeated byte strings.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller doc_id, or
further up in the same one. Strings are judged on the input, may overlap, and never cross documents.

Method, on Spark:

1. Every string has an anchor: the least hash of the 20-byte grams inside it. Consecutive strings with one anchor value
   make a unit. Equal strings have equal anchors, so they stand in units of one anchor value; a unit alone at its value
   and not repeating itself holds no repeat and is done.
2. Units of one value are compared by a hash of all their bytes. Every unit but the first of its class repeats whole.
3. The first units of the classes of one value may still share strings. Their bytes are brought together by anchor value
   and suffix-sorted in two stages (suffix_sort.py): suffixes smaller than their successors are sorted directly, the
   others are induced by bucket scans. Where adjacent common prefixes reach ``LENGTH``, suffixes form an interval, and
   all but its first string are later copies.

Scale: a unit is about 40 bytes apart from the next and is shuffled as four numbers. Copies inside a task's batch are
settled there, so a group of copies sends one unit a batch. A task walks along sorted units holding at most ``CROWD``. An
anchor value with more classes than that (the edge of a passage that very many documents share) is not sorted in one
task: its units are cut anew by anchors of 92-byte grams, which few of them share, and go through the same steps; should
one of those be crowded too, its strings are told apart by 128 bits of hash, and the first of each is a partial
aggregate. The results are the same. Texts are shuffled once by document, for fetching bytes in step 3 and for the final cut.

Defined results: null and empty texts have no bytes. Rows of one doc_id with different texts are told apart by 24 bits of
a hash of the text and stand in its order; fully equal rows are one document, and each is returned cut the same way. A
null doc_id comes first. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _BYTES, arrow_map, batch, byte_columns, mixed, range_hashes, slices, table, written
from tidemark.llm.suffix_sort import later_copies

LENGTH = 100
#: Bytes of the grams that anchors are chosen from; the longer one tells the units of a crowded anchor apart.
GRAMS = (20, 92)
#: Strings of one unit at most; longer runs of one anchor are cut.
UNIT = 128
#: Classes of one anchor value that one task sorts.
CROWD = 4096
#: Bytes whose copies a task settles among themselves.
FIND_BYTES = 8 << 20
#: Bytes a task suffix-sorts on average.
SORT_BYTES = 1 << 19


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on: of two overlapping halves."""
    h, step, width = _BYTES[data], 0x9E3779B97F4A7C15, 1
    while 2 * width <= gram:
        h = h[:-width] * np.uint64(step) + h[width:]
        step = step * step % (1 << 64)
        width *= 2
    return mixed(h[: len(h) - (gram - width)] * np.uint64(0xD6E8FEB86659FD93) + h[gram - width :])


def _slid(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    y, w = x, 1
    while 2 * w <= width:
        y = pick(y[:-w], y[w:])
        w *= 2
    return pick(y[: len(x) - width + 1], y[width - w : width - w + len(x) - width + 1])


def units(data: np.ndarray, bounds: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Units of texts laid end to end: owner, first and last start of their strings, anchor value, hash of all their
    bytes, and whether the anchor stands in them more than once."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    span = LENGTH - gram + 1
    grams = _grams(data, gram)
    least = _slid(grams, span, np.minimum)
    n = len(least)
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(bounds)
    long = lengths >= LENGTH
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    last = np.flatnonzero(stops)
    pieces = (last - first) // UNIT + 1
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = first[which] + nth * UNIT
        last = np.minimum(last[which], first + UNIT - 1)
    held = np.concatenate((np.zeros(span - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(span - 1, np.uint64)))
    anchors = np.flatnonzero(_slid(held, span, np.maximum) == grams)
    equal = np.append(0, np.cumsum(grams[anchors[1:]] == grams[anchors[:-1]])) if len(anchors) else np.zeros(1, np.int64)
    a = np.searchsorted(anchors, first)
    b = np.searchsorted(anchors, last + span - 1, side="right") - 1
    again = equal[b] > equal[a]
    owner = np.searchsorted(bounds, first, side="right") - 1
    return owner, first - bounds[owner], last - bounds[owner], least[first], range_hashes(data, first, last + LENGTH), again


# A place packs the text's hash, the first start, the number of strings less one and whether the anchor repeats.
def _packed(sub: np.ndarray, first: np.ndarray, last: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (sub << 39) | (first << 8) | ((last - first) << 1) | again


def _sub(place: np.ndarray) -> np.ndarray:
    return place >> 39


def _first(place: np.ndarray) -> np.ndarray:
    return (place >> 8) & 0x7FFFFFFF


def _last(place: np.ndarray) -> np.ndarray:
    return _first(place) + ((place >> 1) & 0x7F)


_UNIT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_SUB = "cast(xxhash64(cast(text as string)) & 16777215 as long)"


def _by_order(doc: np.ndarray, null: np.ndarray, place: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    return np.lexsort((place >> 8, doc, ~null, *keys))


def _found_units(stretches: DataFrame, gram: int) -> DataFrame:
    """Units of (doc, place, bytes), where the place says what starts the bytes hold: those that are the first of their
    class in a batch and, with null anchor and content, those that repeat one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(byte_columns(whole.column(2))[1], FIND_BYTES):
                yield from found(whole.slice(a, b - a))

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, bounds = byte_columns(rows.column(2))
        places = rows.column(1).to_numpy()
        subs, bases = _sub(places), _first(places)
        null = rows.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = rows.column(0).fill_null(0).to_numpy()
        parts = []
        for i, j in slices(bounds, 1 << 18):
            owner, first, last, anchor, content, again = units(
                data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], gram
            )
            owner = owner + i
            place = _packed(subs[owner], first + bases[owner], last + bases[owner], again)
            parts.append((anchor.view(np.int64), content.view(np.int64), ids[owner], null[owner], place))
        anchor, content, doc, no_id, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = _by_order(doc, no_id, place, content, anchor)
        anchor, content, doc, no_id, place = anchor[by], content[by], doc[by], no_id[by], place[by]
        copy = np.zeros(len(by), bool)
        copy[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        same = np.zeros(len(by), bool)  # the same place again: a row that occurs twice
        same[1:] = copy[1:] & (doc[1:] == doc[:-1]) & (no_id[1:] == no_id[:-1]) & (place[1:] == place[:-1])
        keep = ~same
        keys = (pa.array(anchor[keep], mask=copy[keep]), pa.array(content[keep], mask=copy[keep]))
        yield batch(_UNIT, (*keys, pa.array(doc[keep], mask=no_id[keep]), place[keep]))

    return arrow_map(stretches.select("doc", "place", "bytes"), find, "anchor long, content long, doc long, place long")


#: What a settled unit is: a whole repeat, one to be sorted with others of its anchor, or one of a crowded anchor.
REPEAT, SORT, CROWDED = 0, 1, 2
_SETTLED = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])


class _Walk:
    """Walks along units in order of anchor, content, document and place."""

    def __init__(self, crowd: int) -> None:
        self.crowd = crowd
        self.last: tuple | None = None
        self.anchor, self.crowded = None, False
        self.held: list[np.ndarray] = []  # first units of the classes of the open anchor

    def rows(self, anchor, content, doc, null, place) -> Iterator[pa.RecordBatch]:
        n = len(anchor)
        fresh = np.ones(n, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        if self.last:
            fresh[0] = (anchor[0], content[0]) != self.last[:2]
        # the place of the first of each class, to leave out rows that occur twice
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        first = np.stack((doc, null.astype(np.int64), place))
        of = first[:, np.maximum(at, 0)]
        if self.last:
            of[:, at < 0] = np.array(self.last[2]).reshape(3, 1)
        self.last = (anchor[-1], content[-1], of[:, -1].tolist())
        repeat = ~fresh & (first != of).any(axis=0)
        yield _settled(REPEAT, anchor[repeat], first[:, repeat])
        heads, firsts = anchor[fresh], first[:, fresh]
        cuts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(heads)) if len(heads) else cuts
        if not len(heads):
            return
        # only the first and the last anchor of a batch can be open; those between are whole
        if heads[0] == self.anchor:
            yield from self._add(firsts[:, : ends[0]])
            cuts, ends = cuts[1:], ends[1:]
        if len(cuts):
            yield from self.done()
            whole = slice(cuts[0], cuts[-1])
            sizes = (ends - cuts)[:-1]
            again = np.add.reduceat(firsts[2, whole] & 1, cuts[:-1] - cuts[0]) if len(sizes) else np.zeros(0, np.int64)
            kind = np.where(sizes > self.crowd, CROWDED, SORT)
            wanted = np.repeat((sizes > 1) | (again > 0), sizes)
            for k in (SORT, CROWDED):
                chosen = wanted & (np.repeat(kind, sizes) == k)
                yield _settled(k, heads[whole][chosen], firsts[:, whole][:, chosen])
            self.anchor = heads[cuts[-1]]
            yield from self._add(firsts[:, cuts[-1] :])

    def _add(self, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(firsts)
        if self.crowded or sum(h.shape[1] for h in self.held) > self.crowd:
            self.crowded = True
            for h in self.held:
                yield _settled(CROWDED, np.full(h.shape[1], self.anchor), h)
            self.held = []

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            firsts = np.concatenate(self.held, axis=1)
            if firsts.shape[1] > 1 or firsts[2, 0] & 1:
                yield _settled(SORT, np.full(firsts.shape[1], self.anchor), firsts)
        self.held, self.crowded = [], False


def _settled(kind: int, anchor: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
    doc = pa.array(firsts[0], mask=firsts[1].astype(bool))
    return batch(_SETTLED, (np.full(len(anchor), kind, np.int32), anchor, doc, firsts[2]))


def _settle(found: DataFrame, crowd: int) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Walk(crowd)
        for rows in batches:
            null = rows.column(2).is_null().to_numpy(zero_copy_only=False)
            doc = rows.column(2).fill_null(0).to_numpy()
            place = rows.column(3).to_numpy()
            done = rows.column(0).is_null().to_numpy(zero_copy_only=False)
            if done.any():
                yield _settled(REPEAT, np.zeros(done.sum(), np.int64), np.stack((doc, null, place))[:, done])
            if not done.all():
                anchor = rows.column(0).fill_null(0).to_numpy()[~done]
                content = rows.column(1).fill_null(0).to_numpy()[~done]
                yield from state.rows(anchor, content, doc[~done], null[~done], place[~done])
        yield from state.done()

    to = F.coalesce("anchor", F.xxhash64("doc", "place"))
    order = found.repartition(to).sortWithinPartitions("anchor", "content", "doc", "place")
    return arrow_map(order, walk, "kind int, anchor long, doc long, place long")


def _key() -> Column:
    """One number per document, to join on."""
    return F.xxhash64("doc", "sub")


_STRETCH = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _fetched(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """(kind, anchor, doc, place, bytes): the bytes of units to be compared."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_SETTLED, ("bytes", pa.binary())])
        for rows in batches:
            data, bounds = byte_columns(rows.column(1))
            lists = rows.column(2)
            owner = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            kind, anchor, place = (lists.flatten().field(k).to_numpy() for k in range(3))
            a = bounds[owner] + _first(place)
            b = bounds[owner] + _last(place) + LENGTH
            raw, base = data.tobytes(), 0
            for i in range(0, len(owner), 4096):
                pieces = [raw[x - base : y - base] for x, y in zip(a[i : i + 4096].tolist(), b[i : i + 4096].tolist(), strict=True)]
                part = slice(i, i + 4096)
                yield batch(schema, (kind[part], anchor[part], rows.column(0).take(pa.array(owner[part])), place[part], pieces))

    asked = settled.select("doc", F.shiftright("place", 39).alias("sub"), "kind", "anchor", "place")
    asked = asked.groupBy(_key().alias("_key")).agg(F.collect_list(F.struct("kind", "anchor", "place")).alias("asked"))
    rows = texts.join(asked, F.col("key") == F.col("_key")).select("doc", "text", "asked")
    return arrow_map(rows, cut, "kind int, anchor long, doc long, place long, bytes binary")


def _stretches(doc, null, place, firsts: np.ndarray, later: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Runs of later strings of each unit as stretches of starts."""
    begins = later.copy()
    begins[1:] &= ~later[:-1] | (owner[1:] != owner[:-1])
    stops = later.copy()
    stops[:-1] &= ~later[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    of = owner[a]
    start, stop = firsts[of] + offset[a], firsts[of] + offset[b]
    return batch(_STRETCH, (pa.array(doc[of], mask=null[of]), _sub(place[of]), start.astype(np.int32), stop.astype(np.int32)))


def _sorted_units(pieces: DataFrame, tasks: int) -> DataFrame:
    """Later strings among units of one anchor, by suffix sorting of what a task was dealt."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        null = rows["doc"].is_null().to_numpy()
        doc, place = rows["doc"].fill_null(0).to_numpy(), rows["place"].to_numpy()
        by = _by_order(doc, null, place)
        doc, null, place = doc[by], null[by], place[by]
        data, bounds = byte_columns(rows["bytes"].take(pa.array(by)))
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(by)), sizes)
        offset = np.arange(len(data)) - bounds[owner]
        wanted = offset <= (sizes - LENGTH)[owner]
        later = later_copies(data, wanted, LENGTH)
        yield _stretches(doc, null, place, _first(place), later, owner, offset)

    order = pieces.repartition(tasks, "anchor").select("doc", "place", "bytes")
    return arrow_map(order, sort, "doc long, sub long, start int, stop int")


def _crowded_units(pieces: DataFrame) -> DataFrame:
    """Later strings of crowded anchors: the first of each string is an aggregate over 128 bits of hash."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = rows.column(1).to_numpy()
            data, bounds = byte_columns(rows.column(2))
            for i, j in slices(bounds):
                part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                n = np.diff(at) - LENGTH + 1
                owner = np.repeat(np.arange(j - i), n)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                a = at[owner] + offset
                h = range_hashes(part, a, a + LENGTH)
                g = mixed(range_hashes(part, a, a + LENGTH // 2) * np.uint64(3) + range_hashes(part, a + LENGTH // 3, a + LENGTH))
                take = pa.array(owner + i)
                starts = (_first(place[i:j])[owner] + offset).astype(np.int32)
                yield batch(schema, (h.view(np.int64), g.view(np.int64), rows.column(0).take(take), _sub(place[i:j])[owner], starts))

    strings = arrow_map(pieces.select("doc", "place", "bytes"), spell, "h long, g long, doc long, sub long, start int")
    place = F.struct("doc", "sub", "start")
    first = strings.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min(place).alias("first"))
    later = strings.join(first, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).where(place != F.col("first"))
    return later.select("doc", "sub", "start", F.col("start").alias("stop"))


_CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    + [("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def _cut(rows: DataFrame, with_kept: bool) -> DataFrame:
    schema = _CUT if with_kept else pa.schema(list(_CUT)[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                rows = whole.slice(k, 256)
                data, bounds = byte_columns(rows.column(1))
                sizes, removed, spans, digests, left = np.diff(bounds), [], [], [], []
                for i, found in enumerate(rows.column(2).to_pylist()):
                    text = data[bounds[i] : bounds[i + 1]]
                    if found:
                        marks = np.zeros(len(text) + 1, np.int32)
                        ends = np.array([(s["start"], s["stop"] + LENGTH) for s in found])
                        np.add.at(marks, ends[:, 0], 1)
                        np.add.at(marks, ends[:, 1], -1)
                        gone = np.cumsum(marks[:-1]) > 0
                        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        removed.append(int(gone.sum()))
                        text = text[~gone]
                    else:
                        spans.append(0)
                        removed.append(0)
                    raw = text.tobytes()
                    digests.append(hashlib.sha256(raw).hexdigest())
                    left += [raw] * with_kept
                yield batch(schema, [rows.column(0), sizes, removed, spans, digests, *[left] * with_kept])

    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return arrow_map(rows, cut, columns + ", kept binary" * with_kept)


def _later(settled: DataFrame, texts: DataFrame, tasks: int, grams: tuple[int, ...], crowd: int) -> DataFrame:
    """(doc, sub, start, stop): the starts of all later strings among settled units.

    One plan for all levels, so that the texts are shuffled once for all fetching of bytes and for the final cut.
    """
    first, count = F.shiftright("place", 8).bitwiseAND(0x7FFFFFFF), F.shiftright("place", 1).bitwiseAND(127)
    out = settled.where(F.col("kind") == REPEAT).select(
        "doc",
        F.shiftright("place", 39).alias("sub"),
        first.cast("int").alias("start"),
        (first + count).cast("int").alias("stop"),
    )
    out = out.unionByName(_sorted_units(_fetched(texts, settled.where(F.col("kind") == SORT)), tasks))
    pieces = _fetched(texts, settled.where(F.col("kind") == CROWDED))
    if grams:
        again = _settle(_found_units(pieces, grams[0]), crowd)
        return out.unionByName(_later(again, texts, tasks, grams[1:], crowd))
    return out.unionByName(_crowded_units(pieces))


def remove_repeats(documents: DataFrame, with_kept: bool = True, crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if wanted, kept."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.expr(_SUB).alias("sub"), F.col("text").cast("string"))
    whole = texts.select("doc", F.shiftleft("sub", 39).alias("place"), F.col("text").alias("bytes"))
    texts = texts.withColumn("key", _key())
    settled = written(_settle(_found_units(whole, GRAMS[0]), crowd), "settled")
    count = F.shiftright("place", 1).bitwiseAND(127)
    size = settled.where(F.col("kind") != REPEAT).agg(F.sum(count + LENGTH)).first()[0] or 0
    stretches = _later(settled, texts, int(size // SORT_BYTES + 1), GRAMS[1:], crowd)
    own = stretches.groupBy(_key().alias("_key")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    rows = texts.join(own, F.col("key") == F.col("_key"), "left").select("doc", "text", "found")
    return _cut(rows, with_kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS s
  FROM d, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS t(i) WHERE length(x) >= {2 * LENGTH}),
late AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
spans AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS run FROM spans),
cut AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY ALL),
edges AS (
  SELECT doc_id, x, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM cut JOIN d USING (doc_id)),
left_over AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y
  FROM edges GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

QUERIES = {"op2_suffix_dedup": query}
ORACLE = {"op2_suffix_dedup": SQL}
