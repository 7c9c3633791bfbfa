"""Quality classifier by co-training of a text view and a metadata view.

Method: each view is a naive Bayes model over hashed features: the distinct words of the text, how large a share of
them ends in each kind of sign and how many repeat, and the metadata columns of the page. Both start from labelled documents. In every round each view labels the unlabelled documents it is sure
about (calibrated probability over ``SURE`` or under 1 - ``SURE``), and these pseudo-labels train the other view anew.
Scores of a view are calibrated on labelled documents kept out of training, by pooled adjacent bins; the two calibrated
views are then added as log odds and score every document.

A document is good if its quality is 1 and it is not toxic.

Scale: a round is one scan; each task sends at most 2 * (``WORDS`` + ``METAS``) counts, summed in partial aggregates, so
a model has a fixed size whatever the corpus. Only ids of at most ``LABELLED`` labelled documents are broadcast: the
documented bound of the labelled sample (smallest hashes first). Pseudo-labels come from all documents.

Defined results: null and empty texts have no words and are scored by their metadata and the base rate; a null column is
a value of its own. Without labels of both kinds every score is 0.5. Several labels of one document: one bad one decides.
Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, byte_columns, kept_in_worker, mixed, range_hashes, slices, table, words

WORDS = 1 << 15
METAS = 1 << 12
LABELLED = 50_000
ROUNDS = 2
SURE = 0.95
#: Documents that every feature is thought to have been seen in besides, at the base rate.
SMOOTH = 2.0
METADATA = ("lang", "source", "n_chars")
BINS, REACH = 96, 12.0


@dataclass
class View:
    """Weights per feature and the calibrated probability of being good per score bin."""

    weights: np.ndarray
    good: np.ndarray | None = None

    def bins(self, scores: np.ndarray) -> np.ndarray:
        return ((scores.clip(-REACH, REACH - 1e-9) + REACH) * (BINS / (2 * REACH))).astype(np.int64)


def _weights(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log odds of each feature; one never seen is neutral, a rare one nearly so."""
    share = n_good / (n_good + n_bad)
    return np.log((good + SMOOTH * share) / n_good) - np.log((bad + SMOOTH * (1 - share)) / n_bad)


def calibrated(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Share of good ones per bin, not falling with the bin: neighbours out of order are pooled. A pool counts one more
    document at the base rate, a bin a trace of one."""
    rate, trace = (good.sum() + 1) / (good.sum() + bad.sum() + 2), 0.01
    pools: list[list[float]] = []
    for g, b in zip(good, bad, strict=True):
        pools.append([g + trace * rate, g + b + trace, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            g2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2] + k2]
    shares = np.concatenate([np.full(int(k), (g + rate) / (n + 1)) for g, n, k in pools])
    return np.maximum.accumulate(shares).clip(0.001, 0.999)


def labelled_ids(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(_labelled, good, for_calibration) of at most so many labelled documents."""
    good = F.min(F.col("quality") * (1 - F.coalesce(F.col("toxic"), F.lit(0)))).cast("int")
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    ids = rows.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(good.alias("good"))
    ids = ids.orderBy(F.xxhash64("_labelled"), "_labelled").limit(most)
    return ids.withColumn("for_calibration", F.crc32(F.col("_labelled").cast("string")) % 5 == 0)


def _meta(documents: DataFrame, columns: tuple[str, ...]) -> Column:
    """Hashed features of the metadata columns; numbers count by their order of magnitude."""
    kinds = dict(documents.dtypes)
    values = [
        F.floor(F.log2(F.abs(F.col(c)) + 1)) if kinds[c] in ("int", "bigint", "double", "float", "smallint") else F.col(c)
        for c in columns
        if c in kinds
    ]
    cells = [F.pmod(F.xxhash64(F.lit(i), v), F.lit(METAS)).cast("int") for i, v in enumerate(values)]
    cells += [F.pmod(F.xxhash64(F.lit(-1), *values), F.lit(METAS)).cast("int")] if len(values) > 1 else []
    return F.array(*cells).cast("array<int>")


def _inputs(documents: DataFrame, labelled: DataFrame, metadata: tuple[str, ...], only_labelled: bool) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _meta(documents, metadata).alias("meta"))
    how = "inner" if only_labelled else "left"
    rows = rows.join(F.broadcast(labelled), F.col("doc_id") == F.col("_labelled"), how)
    return rows.select("doc_id", "text", "meta", F.coalesce("good", F.lit(-1)).alias("good"), "for_calibration")


#: The kind of sign a word ends in: capital, digit, the sign itself, or 0 for other letters.
_ENDING = np.array([65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b < 97 or 122 < b < 128 else 0 for b in range(256)])
_SHARES = np.array([0.01, 0.03, 0.1, 0.3, 0.6])
#: Steps of the share of words that are the first of their kind in a text.
_FRESH = np.array([0.1, 0.2, 0.35, 0.5])


def _endings(last: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and buckets: per text and kind of ending, the step of its share."""
    counts = np.bincount(owner * 128 + _ENDING[last], minlength=n * 128).reshape(n, 128)
    own, kind = np.nonzero(counts)
    share = np.digitize(counts[own, kind] / counts.sum(axis=1)[own], _SHARES)
    return own, (mixed((kind * 8 + share).astype(np.uint64)) % np.uint64(WORDS)).astype(np.int64)


class _Features:
    """Features of the rows of a batch: owners and buckets of distinct words, of endings and of metadata."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        n = self.n = rows.num_rows
        data, bounds = byte_columns(rows.column(1))
        keys, shapes, totals = [], [], np.zeros(n, np.int64)
        for i, j in slices(bounds):
            part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            starts, ends, count = words(part, at)
            buckets = (range_hashes(part, starts, ends, lower=True) % np.uint64(WORDS)).astype(np.int64)
            totals[i:j] = count
            owner = np.repeat(np.arange(j - i), count)
            keys.append(np.unique(((owner + i) << 15) | buckets))
            own, shape = _endings(part[ends - 1], owner, j - i)
            shapes.append(((own + i) << 15) | shape)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        shapes = np.concatenate(shapes) if shapes else np.zeros(0, np.int64)
        self.n_words = np.bincount(keys >> 15, minlength=n)
        fresh = np.digitize(self.n_words / np.maximum(totals, 1), _FRESH)
        whole = (mixed((1024 + fresh).astype(np.uint64)) % np.uint64(WORDS)).astype(np.int64)
        shapes = np.concatenate((shapes, ((np.arange(n) << 15) | whole)[totals > 0]))
        self.shape_owner, self.shape = shapes >> 15, shapes & (WORDS - 1)
        keys = np.union1d(keys, shapes)
        self.word_owner, self.word = keys >> 15, keys & (WORDS - 1)
        lists = rows.column(2)
        self.meta = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.meta_owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))

    def binned(self, view: View, text: bool) -> np.ndarray:
        owner, key = (self.word_owner, self.word) if text else (self.meta_owner, self.meta)
        sums = np.bincount(owner, view.weights[key], minlength=self.n)
        if not text:
            return view.bins(sums)
        shapes = np.bincount(self.shape_owner, view.weights[self.shape], minlength=self.n)
        return view.bins((sums - shapes) / np.sqrt(np.maximum(self.n_words, 1)) + shapes)


_TALLY = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("key", pa.int32()), ("n", pa.int64())])
#: What a tally counts: features and documents that train a view, or scores of labelled documents by bin.
TEXT, META, TEXT_BINS, META_BINS = range(4)
_SIZES = {TEXT: WORDS + 1, META: METAS + 1, TEXT_BINS: BINS, META_BINS: BINS}


def _tallied(inputs: DataFrame, views: tuple[View, View] | None) -> dict[int, np.ndarray]:
    """Counts per label over all rows; the last place of TEXT and META counts documents.

    Without views labelled training rows are counted. With views but no calibration, scores of the rows for calibration
    are. With calibrated views pseudo-labels join the training counts.
    """
    spread = inputs.sparkSession.sparkContext.broadcast(views)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = spread.value
        found = {kind: np.zeros((2, size), np.int64) for kind, size in _SIZES.items()}
        for rows in batches:
            f = _Features(rows)
            good = rows.column(3).to_numpy(zero_copy_only=False)
            aside = np.array([bool(x) for x in rows.column(4).to_pylist()])
            if views and views[0].good is None:
                for kind, view in ((TEXT_BINS, views[0]), (META_BINS, views[1])):
                    bins = f.binned(view, kind == TEXT_BINS)
                    for label in (0, 1):
                        found[kind][label] += np.bincount(bins[aside & (good == label)], minlength=BINS)
                continue
            label_of = {TEXT: np.where(aside, -1, good), META: np.where(aside, -1, good)}
            if views:
                for learner, teacher in ((TEXT, 1), (META, 0)):
                    p = views[teacher].good[f.binned(views[teacher], teacher == 0)]
                    sure = np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))
                    label_of[learner] = np.where((good < 0) & ~aside, sure, label_of[learner])
            for kind, owner, key in ((TEXT, f.word_owner, f.word), (META, f.meta_owner, f.meta)):
                for label in (0, 1):
                    own = label_of[kind] == label
                    found[kind][label, :-1] += np.bincount(key[own[owner]], minlength=_SIZES[kind] - 1)
                    found[kind][label, -1] += own.sum()
        for kind, counts in found.items():
            for label in (0, 1):
                at = np.flatnonzero(counts[label])
                if len(at):
                    yield batch(_TALLY, (np.full(len(at), kind), np.full(len(at), label), at, counts[label][at]))

    rows = arrow_map(inputs, tally, "kind int, label int, key int, n long")
    rows = rows.groupBy("kind", "label", "key").agg(F.sum("n").alias("n")).toPandas()
    out = {kind: np.zeros((2, size)) for kind, size in _SIZES.items()}
    for kind, part in rows.groupby("kind"):
        out[kind][part["label"], part["key"]] = part["n"]
    return out


def _learned(counts: dict[int, np.ndarray]) -> tuple[View, View]:
    return tuple(View(_weights(c[1, :-1], c[0, :-1], c[1, -1], c[0, -1])) for c in (counts[TEXT], counts[META]))


def co_train(
    documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, metadata: tuple[str, ...] = METADATA
) -> tuple[tuple[View, View], float] | None:
    """The calibrated text and metadata views and the base rate of good documents; None without labels of both kinds."""
    labelled = labelled_ids(labels)
    known = _inputs(documents, labelled, metadata, only_labelled=True)
    every = _inputs(documents, labelled, metadata, only_labelled=False)
    counts = _tallied(known, None)
    n_bad, n_good = counts[TEXT][:, -1]
    if not n_bad or not n_good:
        return None
    for k in range(rounds + 1):
        views = _learned(counts)
        bins = _tallied(known, views)
        for view, kind in zip(views, (TEXT_BINS, META_BINS), strict=True):
            view.good = calibrated(bins[kind][1], bins[kind][0])
        if k < rounds:
            counts = _tallied(every, views)
    return views, n_good / (n_good + n_bad)


_SCORED = pa.schema([("doc_id", pa.int64()), ("p_text", pa.float64()), ("p_meta", pa.float64()), ("score", pa.float64())])


def score(
    documents: DataFrame, model: tuple[tuple[View, View], float] | None, metadata: tuple[str, ...] = METADATA
) -> DataFrame:
    """Per document: doc_id, p_text, p_meta, score (probability of being good)."""
    spread = documents.sparkSession.sparkContext.broadcast(model)
    run = uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_in_worker("co-training", run, lambda: spread.value)
        for rows in batches:
            if model is None:
                half = np.full(rows.num_rows, 0.5)
                yield batch(_SCORED, (rows.column(0), half, half, half))
                continue
            (text, meta), rate = model
            f = _Features(rows)
            p, q = text.good[f.binned(text, True)], meta.good[f.binned(meta, False)]
            odds = p / (1 - p) * q / (1 - q) * (1 - rate) / rate
            yield batch(_SCORED, (rows.column(0), p, q, odds / (1 + odds)))

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _meta(documents, metadata).alias("meta"))
    return arrow_map(rows, judge, "doc_id long, p_text double, p_meta double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(documents, co_train(documents, labels)).withColumn("kept", F.col("score") >= 0.5)


QUERIES = {"op3_quality_classifier": query}
ORACLE: dict[str, str] = {}
