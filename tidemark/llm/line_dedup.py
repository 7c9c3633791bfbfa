"""Line dedup with a suffix array over line-ID sequences.

Method: every line with a word gets a hash of its bytes as its ID; a text is the sequence of its IDs. Suffixes of all
sequences are ranked by distributed prefix doubling: the rank by 2h lines is that of the pair (rank by h lines here, rank
by h lines h further on). A suffix that is alone at its rank drops out. Suffixes of one rank are the interval of the
suffix array whose longest common prefix reaches h lines; an interval of any length in between is that of two ranks that
overlap. The first suffix of an interval in document order stays, the others are later copies and their lines go.
Deleted lines side by side make the maximal repeated runs.

Rule: a run of lines repeats if it has ``MIN_WORDS`` words or more and the same run stands earlier (smaller doc_id, or
further up in the document); all judged on the input. It is enough to look at the shortest such run from each line and
the shortest such run up to each line: a repeated run is covered by those within it. Neither has more than ``MIN_WORDS``
lines, so ranks are needed up to that many lines only. Lines without a word take no part; those inside a deleted run go
with it. Two lines that repeat together are covered together by a shortest run, unless each has words enough by itself;
such pairs are looked up too where wordless lines stand between them.

Scale: a round shuffles only suffixes that are not alone, a few numbers each. Ranks come from a range-partitioned sort of
distinct pairs with counts and a running sum over partitions, so a line that a third of all documents share is one row
there. The first of an interval is a partial aggregate. Texts are shuffled once, to meet the runs to delete.

Defined results: null texts stay null, empty texts stay empty. Rows of one doc_id with different texts stand in order of
the hash of the text; fully equal rows are one document, and each is returned cut the same way. A null doc_id comes
first. Lines end at \\n; what is left is joined by \\n. The input row is kept as one column, so its other columns stay
and may have any name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, byte_columns, forget, let, range_hashes, slices, table, words, written

MIN_WORDS = 20
_LINES = pa.schema(
    [("doc", pa.int64()), ("sub", pa.int64()), ("k", pa.int32()), ("line", pa.int32()), ("id", pa.int64())]
    + [("need", pa.int32()), ("ends", pa.list_(pa.int32()))]
)


def _line_rows(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, min_words: int) -> pa.RecordBatch:
    starts, _, _ = words(data, bounds)
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    heads = heads[heads < len(data)]
    tails = np.append(heads[1:], len(data))
    broken = data[np.maximum(tails, 1) - 1] == 10
    tails = tails - broken
    n_words = np.searchsorted(starts, tails) - np.searchsorted(starts, heads)
    owner = np.searchsorted(bounds, heads, side="right") - 1
    number = np.searchsorted(breaks, heads) - np.searchsorted(breaks, bounds[owner])
    full = n_words > 0
    heads, tails, owner, number, n_words = heads[full], tails[full], owner[full], number[full], n_words[full]
    at = np.arange(len(heads))
    total = np.append(0, np.cumsum(n_words))
    need = np.searchsorted(total, total[:-1] + min_words) - at
    after = np.searchsorted(owner, owner, side="right")
    need = np.where(at + need <= after, need, 0)
    # Runs of need lines are the shortest from here. Longer ones of up to most lines are the shortest up to their last line.
    most = np.searchsorted(total, total[1:] + min_words) - 1 - at
    parted = np.append(number[1:] > number[:-1] + 1, False)
    most = np.where(parted, np.maximum(most, 2), most)
    most = np.maximum(np.minimum(most, after - at), need)
    several = np.where(need > 0, most - need + 1, 0)
    offsets = np.append(0, np.cumsum(several))
    ends = number[np.repeat(at + need - 1 - offsets[:-1], several) + np.arange(offsets[-1])]
    ends = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ends.astype(np.int32)))
    place = at - np.searchsorted(owner, owner)
    take = pa.array(owner)
    docs, subs = rows.column(0).take(take), rows.column(1).take(take)
    numbers = (place, number, range_hashes(data, heads, tails).view(np.int64), need)
    return batch(_LINES, (docs, subs, *(pa.array(x).cast(f.type) for x, f in zip(numbers, list(_LINES)[2:-1], strict=True)), ends))


def line_sequences(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines with a word: doc, sub, k (place in the sequence), line (number in the text), id, need (how many lines from
    here make ``min_words``, 0 if too few follow) and ends (numbers of the last lines of the runs of need, need + 1 and so
    on lines from here that are to be looked up)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, bounds = byte_columns(rows.column(2))
            for i, j in slices(bounds):
                if bounds[j] > bounds[i]:
                    part = data[bounds[i] : bounds[j]]
                    yield _line_rows(rows.slice(i, j - i), part, bounds[i : j + 1] - bounds[i], min_words)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), _sub(), F.col("text").cast("string"))
    return arrow_map(rows, cut, "doc long, sub long, k int, line int, id long, need int, ends array<int>")


def _sub():
    return F.xxhash64(F.col("text").cast("string")).alias("sub")


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with a count n: adds the rank, the number of suffixes with smaller keys over all partitions."""
    ranged = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("n").alias("size"))  # one row a partition
    starts = starts.select(F.col("part").alias("of"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ranged.join(starts, F.col("part") == F.col("of")).select(*keys, (F.col("before") + F.col("start")).alias("rank"))


_POSITION = ["doc", "sub", "k"]


def _doubled(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes that share their keys with others, with the rank of the keys."""
    groups = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = _ranked(groups, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "rank")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return lines.drop("rank").join(ranks, same).select(*_POSITION, "line", "need", "ends", "rank")


def _ahead(suffixes: DataFrame, all_suffixes: DataFrame, by: Column) -> DataFrame:
    """Each suffix with the rank of the suffix so many lines further on."""
    far = all_suffixes.select(F.col("doc").alias("_doc"), F.col("sub").alias("_sub"), F.col("k").alias("_k"), F.col("rank").alias("next"))
    there = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("sub") == F.col("_sub")) & (F.col("k") + by == F.col("_k"))
    return suffixes.join(far, there).drop("_doc", "_sub", "_k")


def _later(suffixes: DataFrame, h: int) -> DataFrame:
    """Spans of lines of runs of h to 2h - 1 lines that are not the first of their interval."""
    wanted = suffixes.where((F.col("need") < 2 * h) & (F.col("need") + F.size("ends") > h))
    wanted = wanted.select(*_POSITION, "line", "rank", "need", F.posexplode("ends").alias("more", "end"))
    wanted = wanted.withColumn("lines", F.col("need") + F.col("more")).drop("need", "more")
    wanted = wanted.where((F.col("lines") >= h) & (F.col("lines") < 2 * h))
    if h > 1:
        wanted = _ahead(wanted, suffixes, F.col("lines") - h)
    else:
        wanted = wanted.withColumn("next", F.col("rank"))
    place = F.struct("doc", "sub", "k")
    first = wanted.groupBy("rank", "next", "lines").agg(F.min(place).alias("first"))
    first = first.select(F.col("rank").alias("_rank"), F.col("next").alias("_next"), F.col("lines").alias("_lines"), "first")
    same = (F.col("rank") == F.col("_rank")) & (F.col("next") == F.col("_next")) & (F.col("lines") == F.col("_lines"))
    return wanted.join(first, same).where(place != F.col("first")).select("doc", "sub", "line", "end")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, sub, runs): the maximal runs of later copies in each text that has any, as line numbers, end included."""
    lines = written(line_sequences(documents, min_words), "lines")
    suffixes = written(_doubled(lines, ["id"]).distinct(), "suffixes", done=[lines])
    found, h = [written(_later(suffixes, 1), "spans")], 1
    longest = F.max(F.col("need") + F.size("ends") - 1)
    while (suffixes.agg(longest).first()[0] or 0) >= 2 * h:
        pairs = _ahead(suffixes, suffixes, F.lit(h)).withColumnRenamed("rank", "here")
        h *= 2
        suffixes = written(_doubled(pairs, ["here", "next"]), "suffixes", done=[suffixes])
        found.append(written(_later(suffixes, h), "spans"))
    forget(suffixes)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    own = Window.partitionBy("doc", "sub").orderBy("line", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (F.col("line") > F.coalesce(reached, F.lit(-2)) + 1).cast("int"))
    spans = spans.withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("doc", "sub", "run").agg(F.min("line").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc", "sub").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, runs, n_lines): each document as it was, its text without later copies, what was cut (numbers of the
    first and last lines) and how many lines there were (0 for null)."""
    runs = repeated_runs(documents, min_words).select(F.col("doc").alias("of_doc"), F.col("sub").alias("of_sub"), "runs")
    rows = documents.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    rows = rows.withColumns({"doc": F.col("row.doc_id").cast("long"), "sub": F.xxhash64(text)})
    rows = rows.join(runs, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("sub") == F.col("of_sub")), "left")
    parts = F.split(text, "\n", -1)

    def between(lines: Column) -> Column:
        """What stands before each run and after the last."""

        def piece(k: Column) -> Column:
            begin = F.coalesce(F.get(F.col("runs"), k - 1)["end"] + 1, F.lit(0))
            end = F.coalesce(F.get(F.col("runs"), k)["start"], F.size(lines))
            return F.slice(lines, begin + 1, end - begin)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), piece))

    cut = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(let(parts, between), "\n"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    n_lines = F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0))
    return rows.select("row", cut.alias("text"), F.coalesce("runs", none).alias("runs"), n_lines.alias("n_lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    return found.select(
        "row.doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: A run from a to z is looked up if it has words enough, and z or a cannot go without it having too few, or z is next to a.
SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line, x[i] AS s, len(regexp_extract_all(x[i], '[^\\x20\\x09-\\x0D]+')) AS w
  FROM d, unnest(range(1, len(x) + 1)) AS t(i)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k,
    sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM l WHERE w > 0),
e AS (
  SELECT a.doc_id, a.k, a.line, b.k AS z
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + {MIN_WORDS} AND b.upto - a.upto + a.w >= {MIN_WORDS}
    AND (b.upto - b.w - a.upto + a.w < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS} OR b.k = a.k + 1)),
r AS (
  SELECT e.doc_id, e.k, e.z, e.line, max(f.line) AS final, list(f.s ORDER BY f.k) AS run
  FROM e JOIN f ON e.doc_id = f.doc_id AND f.k BETWEEN e.k AND e.z GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS copy FROM r),
gone AS (SELECT DISTINCT doc_id, line + j AS line FROM c, unnest(range(0, final - line + 1)) AS t(j) WHERE copy > 1),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(DISTINCT line - nth) AS n_runs
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS t FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(x), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_runs, 0) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op7_line_dedup": query}
ORACLE = {"op7_line_dedup": SQL}
