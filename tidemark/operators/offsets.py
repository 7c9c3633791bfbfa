"""Sets of committed offsets per topic partition: whole blocks as ranges, the others as bits.

A row is a range of offsets, all of them where ``bits`` is null, else those of one block
whose bit is set. A log that arrives whole is one range per partition, whatever its length;
late and missing offsets cost one row a block, however many they are. Blocks are counted
and joined by (topic, partition, block), so a topic partition with most rows is spread;
only whole blocks are put in order per topic partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = ("topic", "partition")
OFFSET = (*LOG, "offset")
DONE = "topic STRING, partition INT, min_offset BIGINT, max_offset BIGINT, bits ARRAY<BIGINT>"
#: Offsets of a block, a power of two.
BLOCK = 256
#: Blocks of a short interval.
REACH = 64
_WORD = 64


def _block(offset: Column) -> Column:
    return F.shiftright(offset, BLOCK.bit_length() - 1)


def _words() -> range:
    return range(-(-BLOCK // _WORD))


def _holds(bits: Column, place: Column) -> Column:
    """Whether the bit of a place in the block is set; null without bits."""
    return F.getbit(F.get(bits, F.shiftright(place, 6)), place.bitwiseAND(_WORD - 1)) == 1


def _size(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, word: n + F.bit_count(word))


def _joined(words: list[Column]) -> Column:
    """The union of words of bits over a group."""
    return F.array(*[F.coalesce(F.bit_or(w), F.lit(0).cast("bigint")) for w in words])


def blocks(messages: DataFrame) -> DataFrame:
    """The offsets of each block: topic, partition, _block, bits, and _n messages. Null offsets are in none."""
    offset = F.col("offset")
    place = offset.bitwiseAND(BLOCK - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(_WORD - 1).cast("int"))
    words = [F.when(F.shiftright(place, 6) == w, bit) for w in _words()]
    rows = messages.filter(offset.isNotNull())
    return rows.groupBy(*LOG, _block(offset).alias("_block")).agg(_joined(words).alias("bits"), F.count("*").alias("_n"))


def islands(messages: DataFrame) -> DataFrame:
    """The maximal runs of consecutive offsets within blocks: topic, partition, min_offset, max_offset."""
    return _runs(_of_blocks(blocks(messages)))


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals with those that overlap or touch made one."""
    by_start = Window.partitionBy(*LOG).orderBy("min_offset", "max_offset")
    reached = F.max("max_offset").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("min_offset") > reached + 1, F.lit(True)).cast("bigint")
    rows = intervals.select(*LOG, "min_offset", "max_offset").withColumn("_opens", opens)
    number = F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_set", number).groupBy(*LOG, "_set").agg(
        F.min("min_offset").alias("min_offset"), F.max("max_offset").alias("max_offset")
    ).drop("_set")


def added(done: DataFrame, messages: DataFrame) -> DataFrame:
    """The set with the offsets of these messages."""
    some, whole = _parts(done)
    columns = [*LOG, "_block", "bits"]
    old = some.withColumn("_block", _block(F.col("min_offset"))).select(*columns)
    words = [F.get("bits", F.lit(w)) for w in _words()]
    both = old.unionByName(blocks(messages).select(*columns)).groupBy(*LOG, "_block").agg(_joined(words).alias("bits"))
    now = _of_blocks(both).withColumn("_full", _size(F.col("bits")) == BLOCK)
    ranges = merged(whole.unionByName(now.filter("_full").select(*whole.columns)))
    return now.filter("NOT _full").drop("_full").unionByName(ranges.withColumn("bits", _none()))


def intervals(done: DataFrame) -> DataFrame:
    """The set as intervals that neither overlap nor touch. Only those at the edge of a block are put in order."""
    some, whole = _parts(done)
    runs = _runs(some)
    first, last = F.col("min_offset").bitwiseAND(BLOCK - 1), F.col("max_offset").bitwiseAND(BLOCK - 1)
    inner = (first > 0) & (last < BLOCK - 1)
    return runs.filter(inner).unionByName(merged(runs.filter(~inner).unionByName(whole)))


def fresh(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Each message once whose offset is not done in its topic partition.

    A join by blocks of offsets: a block of the messages gets the bits done in it, and a
    mark if an offset occurs twice in it. Offsets are counted into blocks for that;
    payloads move only if blocks are many, and those of marked blocks to be told apart.
    ``done`` may be plain intervals, without bits.
    """
    on = [*LOG, "_block"]
    seen = blocks(messages).withColumn("_again", F.col("_n") > _size(F.col("bits"))).drop("bits", "_n")
    known = seen.join(_done(seen.select(*on), done), on, "left")
    offset = F.col("offset")
    covered = F.coalesce(_holds(F.col("_done"), offset.bitwiseAND(BLOCK - 1)), F.lit(False))
    rows = messages.withColumn("_block", _block(offset))
    single = rows.join(known, on, "left").filter(~F.coalesce("_again", F.lit(False)) & ~covered)
    several = rows.join(known.filter("_again"), on).filter(~covered).dropDuplicates(list(OFFSET))
    return single.select(*messages.columns).unionByName(several.select(*messages.columns))


def _none() -> Column:
    return F.lit(None).cast("array<bigint>")


def _parts(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with bits, and ranges without the column."""
    return done.filter("bits IS NOT NULL"), done.filter("bits IS NULL").drop("bits")


def _of_blocks(found: DataFrame) -> DataFrame:
    first = F.col("_block") * BLOCK
    return found.select(*LOG, first.alias("min_offset"), (first + (BLOCK - 1)).alias("max_offset"), "bits")


def _runs(some: DataFrame) -> DataFrame:
    """The maximal runs of set bits of each block."""
    places = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    held = lambda p: F.coalesce(_holds(F.col("bits"), p), F.lit(False))
    first = F.filter(places, lambda p: held(p) & ((p == 0) | ~held(F.greatest(p - 1, F.lit(0)))))
    last = F.filter(places, lambda p: held(p) & ((p == BLOCK - 1) | ~held(F.least(p + 1, F.lit(BLOCK - 1)))))
    pairs = F.arrays_zip(first.alias("first"), last.alias("last"))
    rows = some.select(*LOG, F.col("min_offset").alias("_start"), F.explode(pairs).alias("_run"))
    return rows.select(
        *LOG,
        (F.col("_start") + F.col("_run")["first"]).alias("min_offset"),
        (F.col("_start") + F.col("_run")["last"]).alias("max_offset"),
    )


def _done(seen: DataFrame, done: DataFrame) -> DataFrame:
    """The bits done in each block, where there are any."""
    if "bits" not in done.columns:
        done = done.withColumn("bits", _none())
    first, last = _block(F.col("min_offset")), _block(F.col("max_offset"))
    # A short one is looked up by its blocks; long ones are few and compared by range.
    long = last - first > REACH
    short = done.filter(~long).withColumn("_block", F.explode(F.sequence(first, last)))
    wide = done.filter(long).select(
        *[F.col(c).alias(f"_{c}") for c in LOG], "min_offset", "max_offset", "bits"
    )
    reaches = F.col("_block").between(first, last)
    same = (F.col("topic") == F.col("_topic")) & (F.col("partition") == F.col("_partition")) & reaches
    columns = [*LOG, "_block", "min_offset", "max_offset", "bits"]
    near = seen.join(wide, same).select(*columns)
    reached = short.select(*columns).unionByName(near)
    return reached.groupBy(*LOG, "_block").agg(_joined([_covered(w) for w in _words()]).alias("_done"))


def _covered(word: int) -> Column:
    """The bits of a word of the block that a row covers."""
    start, everything = F.col("_block") * BLOCK + word * _WORD, F.lit(-1).cast("bigint")
    low, high = F.col("min_offset"), F.col("max_offset")
    # Offsets are compared before they are subtracted: an end may be that of all numbers.
    skipped = F.when(low <= start, 0).otherwise(low - start).cast("int")
    top = F.when(high >= start + (_WORD - 1), _WORD - 1).otherwise(high - start).cast("int")
    above = F.call_function("shiftleft", everything, skipped)
    below = F.call_function("shiftrightunsigned", everything, F.lit(_WORD - 1) - top)
    covered = F.when((skipped < _WORD) & (top >= 0), above.bitwiseAND(below))
    return F.when(F.col("bits").isNotNull(), F.get("bits", F.lit(word))).otherwise(covered)
