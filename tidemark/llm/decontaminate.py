"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark texts.

Method: the 13-word windows of all questions and answers, normalised to lower-case words with one space on either
side, are the keys of one automaton. Every document is normalised the same way and scanned once; matches are mapped
back to word numbers and to code point offsets of the original text.

Scale: the documents are never shuffled. Only distinct windows are broadcast, in blocks of at most ``block_bytes`` of
key text; a benchmark of more blocks is scanned block by block with a written table between, so memory does not depend
on its size. A document carries its own hits, which its own length bounds.

Defined results: null, empty and wordless texts have no words and no hits. An item of fewer words than the window, but
not none, is one window; a wordless or null item has none. Repeated items and documents count each on their own;
repeated rows of one item count once. An empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, byte_columns, kept_in_worker, table, written

WINDOW = 13
#: Key text of one automaton. A node of the trie takes about 50 bytes.
BLOCK_BYTES = 2 << 20

#: Letters and digits of ASCII in lower case and all bytes of other characters stay; the rest becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_RUN = re.compile(rb"[^ ]+")


def folded(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.translate(_FOLD).split()


_WINDOWS = pa.schema([("window", pa.binary()), ("item_id", pa.int64())])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item and distinct window: (window, item_id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, bounds = byte_columns(rows.column(1))
            raw, keys, owners = data.tobytes(), [], []
            for i, item in enumerate(rows.column(0).to_pylist()):
                w = folded(raw[bounds[i] : bounds[i + 1]])
                spans = range(max(1, len(w) - window + 1)) if w else ()
                own = {b" " + b" ".join(w[k : k + window]) + b" " for k in spans}
                keys += own
                owners += [item] * len(own)
            yield batch(_WINDOWS, (keys, owners))

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, cut, "window binary, item_id long").dropDuplicates()


def _automaton(keys: list[bytes], owners: list[list[int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, own in zip(keys, owners, strict=True):
        found.add_word(key.decode("latin-1"), (key.count(b" ") - 1, own))
    found.make_automaton()
    return found


def _scanned(documents: DataFrame, keys: list[bytes], owners: list[list[int]]) -> DataFrame:
    """Adds hit word numbers and items of one block to those found before."""
    spread = documents.sparkSession.sparkContext.broadcast((keys, owners))
    block = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker("automaton", block, lambda: _automaton(*spread.value))
        for rows in batches:
            data, bounds = byte_columns(rows.column(1))
            raw = data.tobytes()
            n_words, hits, items = [], [], []
            before = zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)
            for i, (old_hits, old_items) in enumerate(before):
                w = folded(raw[bounds[i] : bounds[i + 1]])
                n_words.append(len(w))
                own, marks = set(old_items), None
                if w and len(automaton):
                    flat = b" " + b" ".join(w) + b" "
                    for end, (length, found) in automaton.iter(flat.decode("latin-1")):
                        if marks is None:
                            gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                            marks = np.zeros(len(w) + 1, np.int32)
                        last = int(np.searchsorted(gaps, end))
                        marks[last - length] += 1
                        marks[last] -= 1
                        own.update(found)
                now = [] if marks is None else np.flatnonzero(np.cumsum(marks[:-1]))
                hits.append(np.union1d(np.asarray(old_hits, np.int32), np.asarray(now, np.int32)).astype(np.int32))
                items.append(sorted(own))
            schema = pa.schema(
                [rows.schema.field(0), rows.schema.field(1), ("n_words", pa.int64())]
                + [("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]
            )
            yield batch(schema, (rows.column(0), rows.column(1), n_words, hits, items))

    return arrow_map(documents, scan, documents.schema)


def _spans(raw: bytes, hit: list[int]) -> list[dict]:
    """Runs of hit words as code point offsets of the original text."""
    at = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
    heads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    runs = np.split(np.asarray(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
    points = [(at[r[0]][0], at[r[-1]][1]) for r in runs]
    return [{"start": int(heads[s]) - 1, "end": int(heads[e - 1])} for s, e in points]


_FOUND = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64()))]
_FOUND += [("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        data, bounds = byte_columns(rows.column(1))
        hits = rows.column(3).to_pylist()
        spans = [
            _spans(data[bounds[i] : bounds[i + 1]].tobytes(), h) if h else [] for i, h in enumerate(hits)
        ]
        schema = pa.schema([rows.schema.field(0), *_FOUND])
        yield batch(schema, (rows.column(0), rows.column(2), [len(h) for h in hits], rows.column(4), spans))


def _scanned_by_all(documents: DataFrame, row: Column, items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(row, text, n_words, hit, items): hit word numbers and items of all blocks, next to a column of the caller's."""
    cut = item_windows(items, window).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("owners"))
    cut = written(cut.withColumn("size", F.length("window") + 8 * F.size("owners")), "windows")
    total = cut.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = documents.select(
        row.alias("row"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit"),
        F.array().cast("array<long>").alias("items"),
    )
    last = None
    for k in range(blocks):
        own = cut.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select("window", "owners").toArrow()
        rows = _scanned(rows, own["window"].to_pylist(), own["owners"].to_pylist())
        if k + 1 < blocks:
            rows = last = written(rows, "scanned", done=[last] if last else [])
    return rows


def find_contamination(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted), hit_spans (code point offsets, end exclusive)."""
    rows = _scanned_by_all(documents, F.col("doc_id").cast("long"), items, window, block_bytes)
    spans = "array<struct<start:int,end:int>>"
    found = arrow_map(rows, _mapped, f"row long, n_words long, n_hit long, item_ids array<long>, hit_spans {spans}")
    return found.withColumnRenamed("row", "doc_id")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without contaminated ones; the columns stay.

    Every row is judged by its own text, whatever its doc_id: of rows of one id, or of none, only those that are
    contaminated go.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = _scanned_by_all(documents, F.struct(F.lit(0).alias("_"), *others), items, WINDOW, block_bytes)
    kept = rows.where(~contaminated(F.size("hit"), F.col("n_words")))
    text = F.col("text").cast(documents.schema["text"].dataType)
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_WORDS}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_WORDS}') AS w FROM benchmark),
keys AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS k
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM keys),
places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS k
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
met AS (SELECT doc_id, item_id, i, places.n FROM places JOIN keys ON places.n = keys.n AND places.k = keys.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM met, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

QUERIES = {"op8_decontaminate": query}
ORACLE = {"op8_decontaminate": SQL}
