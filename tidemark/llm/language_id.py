"""Language identification with hyperdimensional profiles.

Method: every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, the first
rotated by two places and the second by one. A text is the sum of the vectors of its trigrams, a language the sum over
its learning documents. A document gets the language of the largest cosine.

Scale: learning sends one vector of ``DIMENSIONS`` whole numbers per language and task; prototypes are that size per
language and go to every task. Texts stay where they are read. Vectors of trigrams are made from the letters when
needed and kept in a bounded cache.

Defined results: text that is null or has no letters is ``und`` with score 0, as is everything if no language was
learned. Letters are compared in lower case; everything between letters is one gap. Equal cosines go to the smaller
language name. A null doc_id is neither held out nor learned from. Repeated rows are learned and predicted each. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, byte_columns, kept_in_worker, slices, table

DIMENSIONS = 512
SEED = 97
#: Documents with this remainder of crc32(doc_id) modulo FOLDS are held out.
FOLDS = 5
TRIGRAMS_KEPT = 1 << 16
_SLICE = 1 << 18


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Space:
    """Vectors of letters and trigrams, and the trigrams of texts."""

    def __init__(self) -> None:
        self.letter_of = _letter_table()
        self.letters: dict[int, np.ndarray] = {}
        self.slots: dict[int, int] = {}
        self.vectors = np.zeros((TRIGRAMS_KEPT, DIMENSIONS), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
            if len(self.letters) >= TRIGRAMS_KEPT // 8:
                self.letters.clear()
            self.letters[code] = v = 2 * bits - 1
        return v

    def trigram_vectors(self, keys: np.ndarray) -> np.ndarray:
        """One row per trigram, as 32-bit floats."""
        slots = [self.slots.get(k) for k in keys.tolist()]
        if None in slots:
            if len(self.slots) + slots.count(None) > TRIGRAMS_KEPT:
                self.slots.clear()
                slots = [None] * len(keys)
            if len(keys) > TRIGRAMS_KEPT:
                return np.stack([self._bound(k) for k in keys.tolist()]).astype(np.float32)
            for i, k in enumerate(keys.tolist()):
                if slots[i] is None:
                    slots[i] = self.slots[k] = len(self.slots)
                    self.vectors[slots[i]] = self._bound(k)
        return self.vectors[slots].astype(np.float32)

    def _bound(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and owners of the trigrams of texts laid end to end; each has a letter in the middle."""
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        ends = heads[bounds]
        n = len(ends) - 1
        owner = np.repeat(np.arange(n), np.diff(ends) + 2)
        at = np.arange(len(codes)) + 2 * np.repeat(np.arange(n), np.diff(ends)) + 1
        flat = np.zeros(len(codes) + 2 * n, np.uint32)
        flat[at] = self.letter_of[codes]
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
        flat, owner = flat[keep].astype(np.int64), owner[keep]
        if len(flat) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = (flat[:-2] << 42) | (flat[1:-1] << 21) | flat[2:]
        middle = flat[1:-1] != 0
        return keys[middle], owner[1:-1][middle]

    def sums(self, keys: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """The sum of trigram vectors of each of n owners."""
        out = np.zeros((n, DIMENSIONS), np.float64)
        if not len(keys):
            return out
        distinct, which = np.unique(keys, return_inverse=True)
        for a in range(0, len(distinct), 1 << 13):
            near = (which >= a) & (which < a + (1 << 13)) if len(distinct) > 1 << 13 else slice(None)
            width = min(1 << 13, len(distinct) - a)
            counts = np.bincount(owners[near] * width + which[near] - a, minlength=n * width).reshape(n, width)
            out += counts.astype(np.float32) @ self.trigram_vectors(distinct[a : a + width])
        return out


_LEARNED = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("v", pa.int64())])


def learn(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their prototypes, from documents that are not held out."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = kept_in_worker("space", "", Space)
        found: dict[str, np.ndarray] = {}
        for rows in batches:
            names, which = np.unique(np.array(rows.column(1).to_pylist(), object), return_inverse=True)
            data, bounds = byte_columns(rows.column(0))
            total = np.zeros((len(names), DIMENSIONS))
            for i, j in slices(bounds, _SLICE):
                keys, owners = space.trigrams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                total += space.sums(keys, which[i:j][owners], len(names))
            for name, v in zip(names.tolist(), total, strict=True):
                found[name] = found.get(name, 0) + v
        for name, v in found.items():
            yield batch(_LEARNED, ([name] * DIMENSIONS, range(DIMENSIONS), np.rint(v).astype(np.int64)))

    rows = documents.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = arrow_map(rows, bundle, "lang string, place int, v long").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    got = sums.toPandas()
    names = sorted(got["lang"].unique())
    prototypes = np.zeros((len(names), DIMENSIONS))
    for lang, place, v in got.itertuples(index=False):
        prototypes[names.index(lang), place] = v
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return names, prototypes / np.maximum(lengths, 1e-9)


_PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def predict(documents: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the cosine, 0 if below)."""
    spread = documents.sparkSession.sparkContext.broadcast((names, prototypes))
    run = uuid.uuid4().hex

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = kept_in_worker("space", "", Space)
        names, prototypes = kept_in_worker("prototypes", run, lambda: spread.value)
        for rows in batches:
            data, bounds = byte_columns(rows.column(2))
            langs, scores = [], []
            for i, j in slices(bounds, _SLICE):
                keys, owners = space.trigrams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                sums = space.sums(keys, owners, j - i)
                lettered = np.bincount(owners, minlength=j - i) > 0
                if not names:
                    langs += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                cosines = sums @ prototypes.T / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                langs += [names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores += np.where(lettered, cosines[np.arange(j - i), best].clip(0, 1), 0.0).tolist()
            yield batch(_PREDICTED, (rows.column(0), rows.column(1), langs, scores))

    wanted = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return arrow_map(wanted, compare, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, *learn(documents))


QUERIES = {"op4_language_id": query}
ORACLE: dict[str, str] = {}
