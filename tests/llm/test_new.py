"""Conversation repair, periodic runs and SimHash against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair
from tidemark.llm import periodic_runs as periodic
from tidemark.llm import simhash

from .conftest import odd_texts

# Conversation repair

NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}
LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_audit(rows):
    """Cost, audit and repaired rows by a table of the best rest from each state, worked out from the end."""
    states = ["", "s", "u", "a"]

    def closed(best):
        while True:
            new = {}
            for s in states:
                cost, letters, out = best[NEXT[s][0]]
                new[s] = min(best[s], (cost + 3, "I" + letters, ((NEXT[s], ""), *out)))
            if new == best:
                return best
            best = new

    far = (10**9, "", ())
    best = closed({"": (0, "", ()), "s": far, "u": far, "a": (0, "", ())})
    for role, text, fault in reversed(rows):
        new = {}
        for s in states:
            cost, letters, out = best[s]
            ways = [(cost + 4, "D" + letters, out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in LEGAL[s]:
                    cost, letters, out = best[role[:1]]
                    ways.append((cost + more, "K" + letters, ((role, text), *out)))
                cost, letters, out = best[NEXT[s][0]]
                ways.append((cost + 3 + more, "R" + letters, ((NEXT[s], text), *out)))
            new[s] = min(ways)
        best = closed(new)
    return best[""]


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation, in order."""
    seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append((role, text, fault))
        if fault:
            counts[fault] += 1
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = plain_audit(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest)


def plain_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        deal = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        mine = found.setdefault(conv, [])
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        role = "user" if deal == 4 else role
        mine += [(turn, role, text)] * (2 if deal == 3 else 1)
    return {conv: sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, mine in found.items()}


def conversations(seed, n, longest):
    r = random.Random(seed)
    texts = ["Yes.", "no", "Why?  \n", "", " \t", "a. b", "same!", "tëxt …", "x" * 50 + ".", None]
    rows = []
    for conv in [None, *range(n)]:
        size = r.randint(1, longest)
        for at in range(size):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice([*texts, f"t{r.randint(0, 99)}."])
            rows.append((conv, r.choice([at, at, at + r.randint(0, 3), None]), role, text))
    return rows + rows[:3]


def repaired(frame, **options):
    out = repair.repair_conversations(frame, F.col("dropped"), **options)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = out.collect()
    for row in rows:
        assert (row["audit"] is not None) == row["last"]
    # the pieces hold the repaired texts
    for conv in {row["conv_id"] for row in rows}:
        mine = sorted((row for row in rows if row["conv_id"] == conv), key=lambda row: row["number"])
        assert [row["last"] for row in mine] == [False] * (len(mine) - 1) + [True]
        text = "\n".join(f"{t['role']}:{t['text']}" for row in mine for t in row["turns"])
        assert hashlib.sha256(text.encode()).hexdigest() == mine[-1]["repaired_sha256"]
    return {row["conv_id"]: tuple(row[c] for c in columns) for row in rows if row["last"]}


@pytest.mark.parametrize("segment_rows,longest", [(64, 9), (3, 9), (1, 5), (5, 60)])
def test_repair(spark, segment_rows, longest):
    rows = conversations(segment_rows, 60 if longest < 20 else 8, longest)
    extra = [(*row, "x", 1, True, 2) for row in rows]
    schema = "conv_id LONG, turn LONG, role STRING, text STRING, same STRING, copies INT, dropped BOOLEAN, last INT"
    frame = spark.createDataFrame(extra, schema).repartition(4)
    expected = {conv: plain_repair(mine) for conv, mine in plain_damage(rows).items()}
    assert repaired(repair.damage(frame), segment_rows=segment_rows) == expected


def test_repair_of_nothing(spark):
    schema = "conv_id LONG, turn LONG, role STRING, text STRING"
    assert repaired(repair.damage(spark.createDataFrame([], schema))) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Yes.")], schema)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(repair.damage(frame)) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_auction_prices_are_dual():
    r = random.Random(3)
    for _ in range(200):
        rows = [(r.choice("suat "), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 8))]
        arcs, goal, price = repair.lattice(rows, None)
        cost = repair.auction(arcs, 0, goal, price)
        assert all(price[i] <= c + price[to] for i, out in enumerate(arcs) for c, _, to in out)
        named = {"s": "system", "u": "user", "a": "assistant", "t": "tool", " ": " "}
        plain = [(named[i], "x", "blank" if go else "truncated" if cut else None) for i, go, cut in rows]
        assert (cost, repair.least_audit(arcs, 0, goal, price)) == plain_audit(plain)[:2]


# Periodic runs


def plain_runs(ids):
    n, found = len(ids), {}
    for q in range(1, n // 3 + 1):
        start = 0
        while start < n - q:
            end = start
            while end < n - q and ids[end] == ids[end + q]:
                end += 1
            if end + q - start >= max(24, 3 * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def run_texts(seed, n):
    r = random.Random(seed)
    out = [[], [0] * 23, [0] * 24, [0] * 400, [0, 1] * 100, ([0] * 9 + [1]) * 20]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = [0]
    while len(morse) < 512:
        morse += [1 - x for x in morse]
    out += [fibonacci[-1], morse, morse[:64] * 6]
    for _ in range(n):
        text = []
        while len(text) < r.randint(0, 500):
            some = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 60))]
            more = some * r.randint(1, 6)
            text += more[: r.randint(1, len(more))]
        out.append(text)
    return [np.array(t, np.int64) for t in out]


@pytest.mark.parametrize("largest", [8, 16, 1 << 18])
def test_runs(largest):
    texts = run_texts(largest, 150)
    for text, found in zip(texts, periodic.runs_of(texts, largest), strict=True):
        assert found == plain_runs(text.tolist())


@pytest.mark.parametrize("n", [2, 128, 256, 4096, 1 << 15])
def test_transform(n):
    r = np.random.default_rng(n)
    x = r.integers(0, periodic.PRIME, (2, n))
    back = periodic.ntt(periodic.ntt(x.astype(float)), inverse=True).astype(np.int64)
    assert ((back * pow(n, -1, periodic.PRIME) - x) % periodic.PRIME == 0).all()
    y = periodic.ntt(x.astype(float))[0, 1]
    root = pow(3, (periodic.PRIME - 1) // n, periodic.PRIME)
    assert int(y) % periodic.PRIME == sum(int(v) * pow(root, k, periodic.PRIME) for k, v in enumerate(x[0])) % periodic.PRIME


def test_one_word_repeated_takes_no_square_of_time():
    words = 400_000
    assert periodic.runs_of([np.zeros(words, np.int64)]) == [[(0, words, 1)]]


def plain_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 3000 else None
    if runs is None:
        return None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, listed, kept)


def test_periodic_documents(spark, odd, none):
    rows = [(i, t) for i, t in odd_texts()]
    r = random.Random(5)
    hit = [i for i in range(100, 600) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    rows += [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(1, 400)))) for i in hit]
    schema = "doc_id LONG, text STRING, start INT, runs STRING, period LONG"
    frame = spark.createDataFrame([(*row, 1, "k", None) for row in rows], schema).repartition(3)
    found = sorted((tuple(x) for x in periodic.periodic_runs(frame, damage=True).drop("collapsed", "runs").collect()), key=str)
    expected = [plain_periodic(*row) for row in rows]
    long = {row[0] for row, e in zip(rows, expected, strict=True) if e is None}
    assert [x for x in found if x[0] not in long] == sorted((e for e in expected if e), key=str)
    assert sum(x[1] for x in found if x[0] in hit) >= 10
    assert periodic.periodic_runs(none, damage=True).collect() == []
    kept = {x["doc_id"]: x for x in periodic.periodic_runs(odd).collect()}
    assert kept[16]["collapsed"] == "x |y #z"
    assert [tuple(x) for x in kept[16]["runs"]] == [(0, 180, 3)]


# SimHash


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, limit):
    """rows (doc_id, print) -> smallest doc_id reachable, per print."""
    prints = sorted({p for _, p in rows})
    left, out = set(prints), {}
    for p in prints:
        if p in left:
            group, todo = set(), [p]
            left.discard(p)
            while todo:
                x = todo.pop()
                group.add(x)
                near = {y for y in left if (x ^ y).bit_count() <= limit}
                left -= near
                todo += near
            ids = [i for i, q in rows if q in group and i is not None]
            out |= dict.fromkeys(group, min(ids, default=None))
    return out


def test_prints(monkeypatch):
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for _, text in odd_texts():
            if len(text or "") < 20000:
                assert simhash.fingerprint((text or "").encode()) == plain_print(text)


def test_near_duplicates(spark, odd, none):
    found = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    rows = [(i, plain_print(t)) for i, t in odd_texts()]
    least = plain_components(rows, 4)
    assert found == sorted(((i, f"{p:016x}", least[p]) for i, p in rows), key=str)
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("bucket", [16384, 64, 32])
def test_no_link_is_lost(spark, bucket):
    r = random.Random(bucket)
    prints = {r.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints)[:30]:
        for _ in range(r.choice([1, 4, 20])):
            for b in r.sample(range(64), r.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    prints |= {x for x in range(1 << 7)}  # one dense group
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print LONG")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_prints(frame, 4, bucket).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    least = plain_components([(p, p) for p in prints], 4)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        assert least[a] == least[b]
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: top(p) for p in prints} == least


def test_index_finds_every_pair():
    r = np.random.default_rng(1)
    prints = np.unique(np.concatenate([r.integers(0, 1 << 8, 300), r.integers(0, 1 << 62, 200)]).astype(np.uint64))
    bucket = r.integers(0, 3, len(prints))
    index = simhash.GrayIndex(prints, bucket)
    found = {(int(i), int(j)) for a, b in index.pairs(3) for i, j in zip(a, b)}
    p, k = index.prints.tolist(), index.bucket.tolist()
    every = range(len(p))
    assert found == {(i, j) for i in every for j in every if i < j and k[i] == k[j] and (p[i] ^ p[j]).bit_count() <= 3}
