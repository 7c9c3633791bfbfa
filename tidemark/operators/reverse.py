"""Lake-to-operational sync under a conflict policy, many changes per key.

Each change must be judged after the effect of the earlier ones of its key: an
applied change moves both the row's version and the last applied version of the
ledger. Instead of stepping through them, the state before a change is written as
running values over the earlier rows; see ``decide``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import conflict as cf
from tidemark.operators.collapse import latest_per_key
from tidemark.operators.merge import UPSERT, apply_changes
from tidemark.operators.running import PART, Measure, find_cuts, running_before

# Action names and the texts of the audit log.
APPLY = "apply"
APPLY_MERGE = "apply_merge"
SKIP_DUPLICATE = "skip_duplicate"
SKIP_PG_WINS = "skip_pg_wins"
FAILED = "error"
INSERT_TEXT = "no existing Postgres row; inserting"

# Merge rules that can be folded over many changes of one key.
FOLDABLE = (cf.POSTGRES, cf.LAKEHOUSE, "greatest", "least", "coalesce")


def decide(
    changes: DataFrame,
    target: DataFrame,
    ledger: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    version: str | None,
    policy: str = cf.LAST_WRITE_WINS,
    source_of_truth: str = cf.POSTGRES,
    ledger_version: str = "lake_version",
    cuts: int | None = None,
) -> DataFrame:
    """Add ``action`` and ``reason`` to every change.

    ``target`` is the operational table, ``ledger`` the last applied version of
    each key; ``seq`` orders the changes of a key, and where it ties a hash of the
    whole change does. ``version`` is the column both sides carry their version in,
    or None. ``cuts`` is into how many ranges all changes are cut for the scan.

    With v the version of a change, p that of the row and l that of the ledger at
    the start: an absent row takes the first change not covered by l; after that
    last_write_wins applies exactly the changes above every earlier applied one,
    and an unversioned row is never overwritten. When the lake always wins, every
    change applies that is above those applied since the last unversioned one.
    """
    cf.check_policy(policy, source_of_truth)
    v = F.col(version) if version else F.lit(None).cast("bigint")
    p = F.col(version) if version and version in target.columns else F.lit(None).cast("bigint")
    key_types = {f.name: f.dataType for f in changes.schema.fields}
    same_keys = [F.col(k).cast(key_types[k]).alias(k) for k in keys]
    row_state = target.select(*same_keys, F.lit(True).alias("_ex"), p.cast("bigint").alias("_p"))
    applied = ledger.select(*same_keys, F.col(ledger_version).cast("bigint").alias("_l"))

    ranges = find_cuts(changes, keys, seq, cuts)
    rows = ranges.assign(changes.withColumn("_v", v.cast("bigint")))
    on = [*keys, PART]
    rows = rows.join(ranges.replicate(row_state), on, "left").join(ranges.replicate(applied), on, "left")
    rows = rows.withColumn("_ex", F.coalesce("_ex", F.lit(False)))

    def running(frame: DataFrame, **measures: Measure) -> DataFrame:
        return running_before(frame, ranges, measures)

    lake_wins = policy == cf.MERGE or (
        policy == cf.SOURCE_OF_TRUTH and source_of_truth == cf.LAKEHOUSE
    )
    if policy == cf.LAST_WRITE_WINS:
        judged = _last_write_wins(rows, running, source_of_truth)
    elif lake_wins:
        judged = _lake_wins(rows, running, policy)
    else:
        judged = _row_stays(rows, running, policy, source_of_truth, cf.conflict_text(changes, keys))
    return judged.select(*changes.columns, "action", "reason")


def _not_covered() -> Column:
    """Not a duplicate by the ledger as it was at the start."""
    v, l = F.col("_v"), F.col("_l")
    return v.isNull() | l.isNull() | (v > l)


def _covered_by(l: Column) -> Column:
    return F.coalesce(F.col("_v") <= l, F.lit(False))


def _duplicate_text(l: Column) -> Column:
    v = F.col("_v").cast("string")
    return F.concat(F.lit("lake version "), v, F.lit(" <= last applied "), l.cast("string"))


def _first_insert() -> Measure:
    """The version of the change that created an absent row, as a struct."""
    created = ~F.col("_ex") & _not_covered()
    return Measure("first", F.when(created, F.struct(F.col("_v").alias("v"))))


def _last_write_wins(rows: DataFrame, running, source_of_truth: str) -> DataFrame:
    v, p, ex = F.col("_v"), F.col("_p"), F.col("_ex")
    tie = F.lit(source_of_truth == cf.LAKEHOUSE)
    beats_start = ~ex | (v > p) | (tie & (v == p))
    eligible = F.coalesce(v.isNotNull() & _not_covered() & beats_start, F.lit(False))
    state = running(rows, _top=Measure("max", F.when(eligible, v)), _created=_first_insert())

    top, created = F.col("_top"), F.col("_created")
    l = F.coalesce(top, F.col("_l"))
    row_version = F.coalesce(top, p)
    absent = ~ex & created.isNull()
    unversioned_row = (created.isNotNull() & created["v"].isNull()) | (ex & p.isNull())
    created_unversioned = created.isNotNull() & created["v"].isNull()
    covered = ~created_unversioned & _covered_by(l)
    refused = v.isNull() | unversioned_row
    action = (
        F.when(covered, SKIP_DUPLICATE)
        .when(absent, APPLY)
        .when(refused, FAILED)
        .when(eligible, APPLY)
        .otherwise(SKIP_PG_WINS)
    )
    reason = (
        F.when(covered, _duplicate_text(l))
        .when(absent, INSERT_TEXT)
        .when(refused, cf.NO_VERSION_TEXT)
        .when(v == row_version, cf.tie_text(v, source_of_truth))
        .when(v > row_version, cf.newer_text(cf.LAKEHOUSE, v, row_version))
        .otherwise(cf.newer_text(cf.POSTGRES, row_version, v))
    )
    return state.withColumns({"action": action, "reason": reason})


def _lake_wins(rows: DataFrame, running, policy: str) -> DataFrame:
    v = F.col("_v")
    # An unversioned change resets the ledger, so versions count from the last one.
    state = running(
        rows,
        _resets=Measure("count", v.isNull()),
        _any=Measure("first", F.when(_not_covered(), F.lit(1))),
    )
    since = F.coalesce("_resets", F.lit(0))
    state = state.withColumn("_resets", since.cast("bigint"))
    seen = F.when(v.isNotNull(), F.struct(F.col("_resets").alias("r"), v.alias("v")))
    state = running(state, _seen=Measure("max", seen))

    at_start = F.when(F.col("_resets") == 0, F.col("_l"))
    recent = F.when(F.col("_seen.r") == F.col("_resets"), F.col("_seen.v"))
    l = F.greatest(recent, at_start)
    covered = _covered_by(l)
    exists = F.col("_ex") | F.col("_any").isNotNull()
    conflict = APPLY_MERGE if policy == cf.MERGE else APPLY
    text = cf.MERGE_TEXT if policy == cf.MERGE else cf.always_text(cf.LAKEHOUSE)
    action = F.when(covered, SKIP_DUPLICATE).when(~exists, APPLY).otherwise(conflict)
    reason = F.when(covered, _duplicate_text(l)).when(~exists, INSERT_TEXT).otherwise(text)
    return state.withColumns({"action": action, "reason": reason})


def _row_stays(
    rows: DataFrame, running, policy: str, source_of_truth: str, refusal: Column
) -> DataFrame:
    state = running(rows, _created=_first_insert())
    created = F.col("_created")
    l = F.when(created.isNotNull(), created["v"]).otherwise(F.col("_l"))
    absent = ~F.col("_ex") & created.isNull()
    covered = _covered_by(l)
    kept = FAILED if policy == cf.ERROR else SKIP_PG_WINS
    text = refusal if policy == cf.ERROR else F.lit(cf.always_text(source_of_truth))
    action = F.when(covered, SKIP_DUPLICATE).when(absent, APPLY).otherwise(kept)
    reason = F.when(covered, _duplicate_text(l)).when(absent, INSERT_TEXT).otherwise(text)
    return state.withColumns({"action": action, "reason": reason})


def applied(decided: DataFrame) -> DataFrame:
    return decided.filter(F.startswith("action", F.lit("apply")))


def apply_decided(
    target: DataFrame,
    decided: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    rules: Mapping[str, str] | None = None,
) -> DataFrame:
    """The target after the applied changes; under merge, ``rules`` per column.

    Columns without a rule keep the value the row has.
    """
    changes = applied(decided)
    if rules is None:
        last = latest_per_key(changes, keys, seq)
    else:
        last = _fold_rules(target, changes, keys, seq, rules)
    return apply_changes(target, last.withColumn("op", F.lit(UPSERT)), keys)


def _fold_rules(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    rules: Mapping[str, str],
) -> DataFrame:
    unknown = {c: r for c, r in rules.items() if r not in FOLDABLE}
    if unknown:
        raise ValueError(f"rules must be one of {FOLDABLE}: {unknown}")
    columns = [c for c in target.columns if c in changes.columns and c not in keys]
    at = F.struct(*seq)
    folded = []
    for c in columns:
        rule = rules.get(c, cf.POSTGRES)
        if rule == cf.LAKEHOUSE:
            value = F.max_by(c, at)
        elif rule == "greatest":
            value = F.max(c)
        elif rule == "least":
            value = F.min(c)
        elif rule == "coalesce":
            value = F.min_by(c, F.when(F.col(c).isNotNull(), at))
        else:
            value = F.min_by(c, at)
        folded.append(value.alias(f"_fold_{c}"))
    per_key = changes.groupBy(*keys).agg(*folded)
    row = target.select(*keys, *columns, F.lit(True).alias("_ex"))
    both = per_key.join(row, list(keys), "left")
    merged = []
    for c in columns:
        rule, fold, old = rules.get(c, cf.POSTGRES), F.col(f"_fold_{c}"), F.col(c)
        if rule == "greatest":
            value = F.greatest(old, fold)
        elif rule == "least":
            value = F.least(old, fold)
        elif rule == "coalesce":
            value = F.coalesce(old, fold)
        elif rule == cf.LAKEHOUSE:
            value = fold
        else:
            value = F.when(F.col("_ex"), old).otherwise(fold)
        merged.append(value.alias(c))
    return both.select(*keys, *merged)


def report(decided: DataFrame) -> DataFrame:
    """How many changes met each action."""
    return decided.groupBy("action").agg(
        F.count("*").alias("changes"),
        F.count_if(F.startswith("action", F.lit("apply"))).alias("applied"),
    )


def advance_ledger(
    ledger: DataFrame,
    decided: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    version: str,
    ledger_version: str = "lake_version",
) -> DataFrame:
    """The ledger after a batch: the version applied last, also where it is null."""
    rows = applied(decided).select(*keys, *[c for c in seq if c not in keys], F.col(version).alias(ledger_version))
    last = latest_per_key(rows, keys, seq).select(*keys, ledger_version)
    return apply_changes(ledger, last.withColumn("op", F.lit(UPSERT)), keys)
