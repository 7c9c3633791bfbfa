"""Repair of conversations whose turns are broken, by the cheapest edits.

Method: a conversation is a lattice of nodes (row, state), the state being what stands before: nothing, a system turn, a
user turn or an assistant turn. Arcs are the edits: keep a row (0), reassign its role to the one that may follow (3),
delete it (4), insert an empty turn (3); a truncated row that stays adds 3, blank and repeated rows must go. The cheapest
way through is found by the auction algorithm for shortest paths: every node has a price, a path grows from the origin
along arcs that the prices make tight, and at a node where none is tight the price rises to the least its arcs offer and
the path gives the node up. Prices begin at what the rows ahead cost at least, so that only conflicts of roles are left
to bid for. When the path arrives, every arc of every cheapest way is tight; they are walked in the order of their
letters (D, I, K, R), so the first way through is the least of the cheapest audits.

Scale: rows are range-partitioned by conversation, turn, role and text, so a conversation of any length is spread, and
equal rows are counted, not moved one by one. Each task cuts its rows into segments of ``SEGMENT`` rows and runs the
auctions there. A conversation inside one segment is done with that. For any other each segment carries the cost and the
audit of every pair of entering and leaving states; as an audit ends with the edit of a segment's last row, no audit of
a segment begins another one, and choices made segment by segment are those for the whole. These segments are then
streamed through one task a conversation, backwards for the costs ahead and forwards for choices and digest: the digest
over a conversation needs its order. No task holds more than a segment's texts.

Defined results: nulls of role and text are one space; null turns come first and don't count for gaps; rows of null
conv_id are one conversation of null id. Rows of one turn are taken in order of role, then text; repeated rows are rows
each, the second a duplicate. A conversation all of whose rows are dropped has zeros and an empty audit. Other columns
are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, table, written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a segment; a longer text is a segment of its own.
SEGMENT, SEGMENT_BYTES = 64, 4 << 20

# States: nothing yet, after system, after user, after assistant.
_STATES = range(4)
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What turns a state at the end into a legal one.
_ENDINGS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

Arcs = list[list[tuple[int, str, int]]]


def lattice(rows: Sequence[tuple[str, bool, bool]], goal_state: int | None) -> tuple[Arcs, int, list[int]]:
    """Arcs of each node in order of their letters, the goal, and prices that no arc undercuts.

    Rows are (initial of the role, must go, is truncated); node 4 * i + s stands before row i in state s. The goal is the
    given state after the last row, or a node behind all endings. Arcs that cannot reach the goal are left out.
    """
    n = len(rows)
    goal = 4 * n + 4 if goal_state is None else 4 * n + goal_state
    arcs: Arcs = [[] for _ in range(4 * n + 5)]
    price = [0] * (4 * n + 5)
    alive = [False] * (4 * n + 5)
    alive[goal] = True
    if goal_state is None:
        for s in _STATES:
            arcs[4 * n + s].append((*_ENDINGS[s], goal))
            alive[4 * n + s] = True
    ahead = 0
    for i in range(n - 1, -1, -1):
        initial, must_go, truncated = rows[i]
        stays = TRUNCATED * truncated
        ahead += DELETE if must_go else stays
        for s in _STATES:
            price[4 * i + s] = ahead
            out = [(DELETE, "D", 4 * i + 4 + s)]
            if not must_go:
                kept = _KEPT[s].get(initial)
                if kept is not None:
                    out.append((stays, "K", 4 * i + 4 + kept))
                out.append((REROLE + stays, "R", 4 * i + 4 + _NEXT[s]))
            arcs[4 * i + s] = [arc for arc in out if alive[arc[2]]]
            alive[4 * i + s] = bool(arcs[4 * i + s])
        while True:  # inserts stay before the row, so they may lead to a node that only now is known to go on
            changed = False
            for s in _STATES:
                to = 4 * i + _NEXT[s]
                mine = arcs[4 * i + s]
                if alive[to] and not any(letter == "I" for _, letter, _ in mine):
                    mine.append((INSERT, "I", to))
                    alive[4 * i + s] = changed = True
            if not changed:
                break
        for s in _STATES:
            arcs[4 * i + s].sort(key=lambda arc: arc[1])
    return arcs, goal, price


def auction(arcs: Arcs, origin: int, goal: int, price: list[int]) -> int:
    """The cost of the cheapest way; prices are left such that all its arcs are tight."""
    path = [origin]
    while path[-1] != goal:
        at = path[-1]
        least, to = min((cost + price[to], to) for cost, _, to in arcs[at])
        if price[at] == least:
            path.append(to)
        else:
            price[at] = least
            if len(path) > 1:
                path.pop()
    return price[origin] - price[goal]


def least_audit(arcs: Arcs, origin: int, goal: int, price: list[int]) -> str:
    """The letters of the first way in order of letters along tight arcs."""
    walk, letters, dead = [origin], [], set()
    while walk[-1] != goal:
        at = walk[-1]
        for cost, letter, to in arcs[at]:
            if to not in dead and price[at] == cost + price[to]:
                walk.append(to)
                letters.append(letter)
                break
        else:
            dead.add(walk.pop())
            letters.pop()
    return "".join(letters)


def cheapest(rows: Sequence[tuple[str, bool, bool]], begin: int = 0, end: int | None = None) -> tuple[int, str] | None:
    """Cost and least audit from a state to a state after the last row, or to any legal end."""
    arcs, goal, price = lattice(rows, end)
    if begin != goal and not arcs[begin]:
        return None
    cost = auction(arcs, begin, goal, price)
    return cost, least_audit(arcs, begin, goal, price)


def _all_ways(rows: Sequence[tuple[str, bool, bool]]) -> tuple[list[int], list[str | None]]:
    """Costs (-1: no way) and audits for all pairs of entering and leaving states."""
    costs, audits = [-1] * 16, [None] * 16
    for end in _STATES:
        arcs, goal, price = lattice(rows, end)
        for begin in _STATES:
            if begin == goal or arcs[begin]:  # prices hold for every origin, so they are kept
                costs[4 * begin + end] = auction(arcs, begin, goal, price)
                audits[4 * begin + end] = least_audit(arcs, begin, goal, price)
    return costs, audits


def apply_audit(audit: str, rows: Sequence[tuple[str, str]], state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The rows (role, text) after the edits, and the state they end in."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append((_ROLE[state], ""))
            state = _NEXT[state]
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            out.append((role, text))
            state = _KEPT[state][role[:1]]
        elif letter == "R":
            out.append((_ROLE[state], text))
            state = _NEXT[state]
    return out, state


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT_FIELDS = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
_SEGMENT_FIELDS += [("turns_met", pa.int64())] + [(c, pa.int64()) for c in _COUNTS]
_SEGMENT_FIELDS += [("turns", pa.list_(_TURN)), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
_FOUND_FIELDS = [("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_SCAN = pa.schema(_SEGMENT_FIELDS + _FOUND_FIELDS)
_BACK = pa.schema(_SEGMENT_FIELDS + [("ahead", pa.list_(pa.int64()))])
_OUT = pa.schema(
    [("conv_id", pa.int64()), ("number", pa.int64()), ("turns", pa.list_(_TURN)), ("last", pa.bool_()), ("gaps", pa.int64())]
    + [(c, pa.int64()) for c in _COUNTS]
    + _FOUND_FIELDS[1:]
)
_SEGMENT_DDL = (
    "conv_id long, part int, number long, low long, high long, turns_met long, blank long, duplicate long, truncated long, "
    "illegal long, turns array<struct<role:string,text:string>>, costs array<long>, audits array<string>"
)
REPAIR_COLUMNS = (
    "conv_id long, number long, turns array<struct<role:string,text:string>>, last boolean, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_LEGAL = {"su", "ua", "au"}


def _rows_out(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


class _Digest:
    """The digest of repaired rows, newline-joined."""

    def __init__(self) -> None:
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, rows: Sequence[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.begun = True


class _Open:
    """Rows of one conversation that stand together in a task, until they are a segment."""

    def __init__(self, conv, begins: bool) -> None:
        self.conv, self.cut, self.number = conv, begins, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.turns: list[tuple[str, str]] = []
        self.numbers: list[int] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.bytes = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if self.turns and self.turns[-1][0][:1] + role[:1] not in _LEGAL:
            self.counts["illegal"] += 1
        if fault:
            self.counts[fault] += 1
        if turn is not None and (not self.numbers or self.numbers[-1] != turn):
            self.numbers.append(turn)
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.turns.append((role, text))
        self.bytes += len(text)

    def segment(self, part: int, whole: bool) -> dict:
        met = self.numbers
        out = {"conv_id": self.conv, "part": part, "number": self.number, "turns_met": len(met)} | self.counts
        out |= {"low": met[0] if met else None, "high": met[-1] if met else None}
        turns = self.turns
        if whole:
            out["cost"], out["audit"] = cheapest(self.rows)
            turns, _ = apply_audit(out["audit"], turns)
            digest = _Digest()
            digest.add(turns)
            out["repaired_sha256"] = digest.sha.hexdigest()
            out["gaps"] = met[-1] - met[0] + 1 - len(met) if met else 0
        else:
            out["costs"], out["audits"] = _all_ways(self.rows)
        out["turns"] = [{"role": role, "text": text} for role, text in turns]
        self.number += 1
        self.clear()
        return out


def _scan(segment_rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: _Open | None = None
        out: list[dict] = []
        held = 0
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                for conv, turn, role, text, dropped, copies, first, blank, truncated in zip(
                    *(rows.column(k).slice(at, 256).to_pylist() for k in range(rows.num_columns)), strict=True
                ):
                    if now is None or conv != now.conv:
                        if now is not None:
                            out.append(now.segment(part, whole=not now.cut))
                        now = _Open(conv, begins=now is None)
                    for copy in range(0 if dropped else copies):
                        if len(now.rows) >= segment_rows or (now.rows and now.bytes + len(text) > SEGMENT_BYTES):
                            now.cut = True
                            out.append(now.segment(part, whole=False))
                        fault = "blank" if blank else "duplicate" if copy or not first else "truncated" if truncated else None
                        now.add(turn, role, text, fault)
                        held += len(text) + 100
                        if held > SEGMENT_BYTES and out:
                            yield _rows_out(_SCAN, out)
                            out, held = [], 0
        if now is not None:
            out.append(now.segment(part, whole=False))
        if out:
            yield _rows_out(_SCAN, out)

    return scan


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what is still to pay after each segment, by state. Segments of a conversation come last first."""
    conv, ahead = object(), None
    for rows in batches:
        for at in range(rows.num_rows):
            row = rows.slice(at, 1).to_pylist()[0]
            if row["conv_id"] != conv:
                conv, ahead = row["conv_id"], [cost for cost, _ in _ENDINGS]
            yield _rows_out(_BACK, [row | {"ahead": ahead}])
            costs = row["costs"]
            ways = ([(costs[4 * s + e], ahead[e]) for e in _STATES] for s in _STATES)
            # A state from which nothing leads on is given a price no way can reach.
            ahead = [min([c + a for c, a in way if c >= 0], default=1 << 60) for way in ways]


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chooses the way through each segment and repairs its rows. Segments of a conversation come in order."""
    last: dict | None = None
    for rows in batches:
        for at in range(rows.num_rows):
            row = rows.slice(at, 1).to_pylist()[0]
            if last is None or row["conv_id"] != last["conv_id"]:
                if last is not None:
                    yield _closed(last)
                last = {"conv_id": row["conv_id"], "number": 0, "state": 0, "digest": _Digest(), "audit": [], "cost": 0}
                last |= {"low": None, "high": None, "met": 0, "role": None} | dict.fromkeys(_COUNTS, 0)
            state, costs = last["state"], row["costs"]
            ways = [(costs[4 * state + e] + row["ahead"][e], row["audits"][4 * state + e], e) for e in _STATES if costs[4 * state + e] >= 0]
            _, audit, end = min(ways)
            turns = [(turn["role"], turn["text"]) for turn in row["turns"]]
            repaired, _ = apply_audit(audit, turns, state)
            last["cost"] += costs[4 * state + end]
            last["state"] = end
            last["audit"].append(audit)
            last["digest"].add(repaired)
            for c in _COUNTS:
                last[c] += row[c]
            if turns:
                if last["role"] is not None and last["role"] + turns[0][0][:1] not in _LEGAL:
                    last["illegal"] += 1
                last["role"] = turns[-1][0][:1]
            if row["turns_met"]:
                last["met"] += row["turns_met"] - (last["high"] == row["low"])
                last["low"] = row["low"] if last["low"] is None else last["low"]
                last["high"] = row["high"]
            yield _rows_out(_OUT, [_part(last, repaired)])
            last["number"] += 1
    if last is not None:
        yield _closed(last)


def _part(last: dict, repaired: list[tuple[str, str]]) -> dict:
    turns = [{"role": role, "text": text} for role, text in repaired]
    return {"conv_id": last["conv_id"], "number": last["number"], "turns": turns, "last": False}


def _closed(last: dict) -> pa.RecordBatch:
    """The last row of a conversation: its ending and the totals."""
    cost, letters = _ENDINGS[last["state"]]
    repaired, _ = apply_audit(letters, [], last["state"])
    last["digest"].add(repaired)
    out = _part(last, repaired) | {c: last[c] for c in _COUNTS}
    out |= {"last": True, "cost": last["cost"] + cost, "audit": "".join(last["audit"]) + letters}
    out["gaps"] = 0 if last["low"] is None else last["high"] - last["low"] + 1 - last["met"]
    out["repaired_sha256"] = last["digest"].sha.hexdigest()
    return _rows_out(_OUT, [out])


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, dropped) after the damage that crc32 of ``conv_id:turn`` deals to each."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    deal = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    text = F.when(deal == 1, "").when(deal == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(deal == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (deal == 0).alias("dropped"),
        F.explode(F.when(deal == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def repair_conversations(rows: DataFrame, dropped: Column | None = None, segment_rows: int = SEGMENT) -> DataFrame:
    """Repaired conversations as ``REPAIR_COLUMNS``: the turns piece by piece, the totals on each one's last piece.

    Rows marked as ``dropped`` only tell that their conversation exists.
    """
    gone = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        *[F.when(gone, "").otherwise(F.coalesce(F.col(c).cast("string"), space)).alias(c) for c in ("role", "text")],
        gone.alias("dropped"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"same": F.sha2(F.col("text"), 256), "at": F.struct(F.col("turn").isNotNull(), F.col("turn"))})
    firsts = rows.where("not dropped").groupBy("conv_id", "role", "same").agg(F.min("at").alias("first_at"))
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("same").alias("what"), "first_at")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as")) & (F.col("same") == F.col("what"))
    rows = rows.join(firsts, same, "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "dropped",
        "copies",
        F.col("at").eqNullSafe(F.col("first_at")).alias("first"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    # Sorting by (dropped) last keeps the order that counts: turn, role, text.
    order = ["conv_id", "turn", "role", "text", "dropped"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ", gaps long, cost long, audit string, repaired_sha256 string"
    segments = written(arrow_map(rows, _scan(segment_rows), _SEGMENT_DDL + found), "segments")
    whole = segments.where("audit is not null")
    whole = whole.select(*[F.lit(True).alias("last") if c == "last" else F.col(c) for c in _OUT.names])
    cut = segments.where("audit is null").drop("gaps", "cost", "audit", "repaired_sha256")
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    cut = arrow_map(cut, _backwards, _SEGMENT_DDL + ", ahead array<long>")
    cut = cut.sortWithinPartitions("conv_id", "part", "number")  # rows stay in their tasks
    return whole.unionByName(arrow_map(cut, _forwards, REPAIR_COLUMNS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair_conversations(damage(table(spark, sf_dir, "conversations")), F.col("dropped"))
    return repaired.where("last").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


QUERIES = {"op11_conversation_repair": query}
#: SQL has neither crc32 nor the least cheapest audit; tests/llm compares with brute force over the same table.
ORACLE = {"op11_conversation_repair": None}
