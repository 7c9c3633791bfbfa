"""Similar documents, repeated bytes and repeated lines, against brute force on odd texts."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts, prose
from tidemark.llm import components as components_module
from tidemark.llm import line_dedup, ngram_join, suffix_dedup, suffix_sort
from tidemark.llm.common import slices
from tidemark.llm.components import components

SOLID = r"[^\x20\x09-\x0D]+"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def roots(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def shingles(text, n=3):
    w = re.findall(SOLID, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def one_of_each(rows, n, percent):
    """Rows (doc_id, text) of which one of each group of similar texts stays, by comparing all."""
    known = sorted({(i, t) for i, t in rows if i is not None and shingles(t, n)})
    sets = [shingles(t, n) for _, t in known]
    links = [
        (a, b) for b in range(len(known)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = roots(range(len(known)), links)
    rest = [(i, t) for i, t in rows if i is None or not shingles(t, n)]
    return sorted([row for k, row in enumerate(known) if root[k] == k] + rest, key=repr)


@pytest.mark.parametrize("options", [{}, {"boundary": 40, "block_sets": 2}])
def test_similar_documents(odd, options):
    texts = [(i, shingles(t)) for i, t in odd_texts()]
    known = [(i, s) for i, s in texts if i is not None and s]
    links = [(a, b) for a, s in known for b, t in known if a < b and 100 * len(s & t) >= 90 * len(s | t)]
    root = roots({i for i, _ in known}, links)
    expected = [(i, len(s), root.get(i, i)) for i, s in texts]
    assert rows_of(ngram_join.similar_documents(odd, **options)) == sorted(expected, key=repr)
    assert root[7] == root[4] == root[5] == 0 and root[9] == 8


def test_one_of_similar_stays(odd, none):
    odd = odd.withColumnsRenamed({"key": "doc", "rank": "row", "n_words": "copies"})
    left = ngram_join.keep_one(odd)
    assert left.columns == odd.columns
    assert rows_of(left.select("doc_id", "text")) == one_of_each(odd_texts(), 3, 90)
    assert {r.doc for r in left.collect()} == {"k"}
    assert ngram_join.similar_documents(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_rows_stay_by_their_texts_not_their_ids(spark):
    a, b, c, d = (prose(k, 60) for k in (31, 32, 33, 34))
    rows = [(18, a), (18, b), (3, b), (20, c), (20, d), (2, d), (1, c + " x"), (7, a.upper()), (9, prose(35, 60)), (9, prose(35, 60))]
    rows += [(9, prose(36, 60)), (None, a), (None, a), (5, ""), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    expected = one_of_each(rows, 3, 90)
    assert (3, b) in expected and (7, a.upper()) in expected and sum(i == 9 for i, _ in expected) == 2
    assert rows_of(ngram_join.keep_one(frame)) == expected
    # as documents, rows of one id are linked: 18 and 7 by a, 18 and 3 by b
    found = dict(ngram_join.similar_documents(frame).select("doc_id", "component_id").collect())
    assert found[18] == found[7] == found[3] == 3 and found[20] == found[2] == found[1] == 1 and found[9] == 9


def test_sketches_prune_nothing_similar():
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(700)]
    texts = [" ".join(base[: r.randrange(1, 700)]) for _ in range(60)] + [" ".join(r.sample(base, 650)) for _ in range(10)]
    raw = [t.encode() for t in texts]
    sets = ngram_join.Sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    sketches = [np.array(x, np.int64) for x in sets.sketches().to_pylist()]
    exact = [shingles(t) for t in texts]
    for threshold in ((90, 100), (80, 100), (50, 100)):
        num, den = threshold
        close = lambda a, b: den * len(exact[a] & exact[b]) >= num * len(exact[a] | exact[b])
        root = roots(range(len(texts)), [(a, b) for b in range(len(texts)) for a in range(b) if close(a, b)])
        found = ngram_join._plausible(sets.sizes, sketches, threshold)
        assert all(found[a] == found[root[a]] for a in range(len(texts)))
    assert len(set(ngram_join._plausible(sets.sizes, sketches, (90, 100))[60:].tolist())) == 10  # shuffled words share nothing


def test_no_link_is_lost_by_the_order_or_the_boundary():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice((12, 25, 60, 150)))]
        for _ in range(6):
            own = list(base)
            own[r.randrange(len(own))] = "new" + str(r.random())
            texts.append(" ".join(own))
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    sets = ngram_join.Sets(np.frombuffer(b"".join(raw), np.uint8), bounds)
    common, n = np.unique(sets.shingles, return_counts=True)
    exact = [shingles(t) for t in texts]
    assert sets.sizes.tolist() == [len(s) for s in exact]
    for order in (ngram_join._Order(common[n > 2], n[n > 2]), ngram_join._Order(common[:0], n[:0])):
        for boundary in (0, 30, 1000):
            met = defaultdict(set)
            for o, k in zip(*ngram_join._keys(sets, order, boundary, (90, 100)), strict=True):
                met[int(k)].add(int(o))
            together = {(a, b) for group in met.values() for a in group for b in group if a < b}
            for a in range(len(texts)):
                for b in range(a + 1, len(texts)):
                    if exact[a] != exact[b] and 100 * len(exact[a] & exact[b]) >= 90 * len(exact[a] | exact[b]):
                        assert (a, b) in together, (boundary, a, b)


@pytest.mark.parametrize("boundary", [0, 9, 10, 1000])
def test_sets_that_lack_nothing_meet_larger_ones(spark, boundary):
    """Eleven words, and the same with one word before or after them: 9 of 10 shingles."""
    texts = []
    for i in range(6):
        own = [f"t{i}w{k}" for k in range(11)]
        texts += [(3 * i, " ".join(own)), (3 * i + 1, " ".join([*own, "more"])), (3 * i + 2, " ".join(["more", *own]))]
    rows = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    found = rows_of(ngram_join.similar_documents(rows, boundary=boundary))
    assert found == sorted(((i, 9 + (i % 3 > 0), i // 3 * 3) for i, _ in texts), key=repr)


def _lists_of(texts, spark, name):
    """All texts as one long list, with what it is dealt from."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    order = ngram_join._Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sketched = ngram_join._sketches(docs, order, 9, (90, 100), 3)
    classes = ngram_join._classes(ngram_join.written(sketched, name).where("n > 0"))
    blocks = F.lit(-(-len(texts) // 8))
    return classes.select(F.col("node").alias("member"), "n", F.lit(1).cast("long").alias("key"), blocks.alias("blocks")), docs, classes


def test_a_crowded_list_is_not_dealt_by_the_square(spark):
    """Sets of one list that share its shingle only, and pairs of similar ones among them."""
    r = random.Random(3)
    texts = [" ".join(["a", "b", "c", *(f"w{r.randrange(10**6)}" for _ in range(r.randrange(18, 400)))]) for _ in range(240)]
    texts += [t + " more" for t in texts[::6]]
    met = {}
    for n in (140, 280):
        rows = ngram_join._uncrowded(*_lists_of(texts[-n:], spark, f"crowd{n}"), (90, 100), 8, 3)
        met[n] = rows.collect()
        assert len(met[n]) <= 4 * n  # by pairs of blocks of 8: 140 * 18 and 280 * 35
    places = defaultdict(set)
    for row in met[280]:
        places[row.member].add((row.key, row.i, row.j))
    for a in range(0, 240, 6):
        assert places[a] & places[240 + a // 6]


@pytest.mark.parametrize("threshold", [(90, 100), (80, 100), (50, 100)])
def test_similar_sets_agree_in_a_part(threshold):
    r = random.Random(9)
    texts = []
    for size in (1, 2, 4, 9, 10, 11, 12, 30, 90, 100, 101, 400):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(8):
            cut = base[: max(1, size - r.randrange(1 + size // 5))]
            cut[r.randrange(len(cut))] = "new" + str(r.random())
            texts += [" ".join(base[: max(1, size - r.randrange(1 + size // 5))]), " ".join(cut)]
    raw = [t.encode() for t in texts]
    sets = ngram_join.Sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    exact, keys = [shingles(t) for t in texts], defaultdict(set)
    for owner, key in zip(*sets.part_keys(threshold), strict=True):
        keys[int(owner)].add(int(key))
    num, den = threshold
    similar = 0
    for b in range(len(texts)):
        for a in range(b):
            if den * len(exact[a] & exact[b]) >= num * len(exact[a] | exact[b]):
                similar += exact[a] != exact[b]
                assert keys[a] & keys[b], (a, b)
    assert similar > 10


def test_boundary_follows_cost():
    assert ngram_join.cost_boundary(0.0) == 9  # sets below ten link only if equal, others cost more by subsets
    assert ngram_join.cost_boundary(0.2) > 20


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    found = dict(components(spark.createDataFrame(links, "a LONG, b LONG")).collect())
    root = roots({n for e in links for n in e}, links)
    assert found == {n: m for n, m in root.items() if n != m}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_links_to_roots_need_no_round(spark, monkeypatch):
    tables, write = [], components_module.written
    monkeypatch.setattr(components_module, "written", lambda rows, *a, **b: tables.append(rows) or write(rows, *a, **b))
    stars = [(k, k % 3) for k in range(3, 30)] + [(0, 9), (50, 40), (7, 7)]
    found = dict(components(spark.createDataFrame(stars, "a LONG, b LONG")).collect())
    assert found == {k: k % 3 for k in range(3, 30)} | {50: 40} and len(tables) == 1
    # A node of two links down, and one between two links, are no roots yet.
    for links in ([(5, 3), (5, 1)], [(5, 3), (3, 1)]):
        assert dict(components(spark.createDataFrame(links, "a LONG, b LONG")).collect()) == {5: 1, 3: 1}


@pytest.mark.parametrize("twice", [False, True])
def test_classes_are_joined_only_where_ids_clash(spark, twice):
    rows = [(1, 11, 5, 1, 1), (2, 12, 5, 1, 1), (3, 13, 5, 2, 1)] + [(1, 14, 5, 3, 1), (1, 15, 5, 4, 1)] * twice
    rows = [(*r, [r[3]], [0]) for r in rows]
    rows = spark.createDataFrame(rows, "doc_id LONG, t LONG, n LONG, s1 LONG, s2 LONG, keys ARRAY<LONG>, sketch ARRAY<LONG>")
    classes = ngram_join._classes(rows)
    assert ("Join" in classes._jdf.queryExecution().optimizedPlan().toString()) == twice
    nodes = {r.s1: (r.rep, r.node) for r in classes.collect()}
    assert {s: rep for s, (rep, _) in nodes.items()} == {1: 1, 2: 3} | ({3: 1, 4: 1} if twice else {})
    assert len({node for _, node in nodes.values()}) == len(nodes) and nodes[1] == (1, 1) and nodes[2] == (3, 3)


def cut_bytes(texts, length):
    """(doc_id, bytes, removed, spans, digest) by looking at every string."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    seen, out = {}, []
    for k in order:
        raw = (texts[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first = seen.setdefault(s, (texts[k], i))
            if first != (texts[k], i):
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((texts[k][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [8192, 1])
def test_repeated_bytes(odd, none, crowd):
    found = suffix_dedup.remove_repeats(odd, with_kept=False, crowd=crowd)
    assert rows_of(found) == cut_bytes(odd_texts(), 100)
    if crowd == 1:
        assert suffix_dedup.remove_repeats(none).count() == 0


def test_kept_bytes_are_real(odd):
    for r in suffix_dedup.remove_repeats(odd).where("n_removed > 0").collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("seed", range(8))
def test_two_stage_order(seed):
    r = np.random.default_rng(seed)
    text = r.integers(97, 97 + [1, 2, 2, 3, 4, 26, 100, 150][seed], 1500).astype(np.uint8)
    text = np.concatenate((text, text[200:700]))
    raw, depth = text.tobytes(), [100, 16, 100, 40, 8, 100, 24, 1][seed]
    keys = suffix_sort.eight_bytes(text, depth + 8)
    order = suffix_sort.suffix_order(text, keys, depth)
    cut = [raw[i : i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(len(raw))) and cut == sorted(cut)
    padded = raw + bytes(depth)
    common = suffix_sort.common_prefixes(order, keys, depth)
    for k in range(1, len(order), 37):
        a, b = padded[order[k - 1] :][:depth], padded[order[k] :][:depth]
        assert common[k] == next((i for i in range(depth) if a[i] != b[i]), depth)
    up = suffix_sort.rising(text)
    assert all(up[i] == (raw[i:] < raw[i + 1 :]) for i in range(0, len(raw), 11))


def cut_lines(texts, min_words):
    """Texts without later copies, by comparing all runs of enough words; equal rows are one document."""
    seen, out = {}, {}
    for text in sorted(set(texts), key=lambda t: (t[0] is not None, t[0] or 0)):
        lines = (text[1] or "").split("\n")
        worded = [(n, x, len(re.findall(SOLID, x))) for n, x in enumerate(lines) if re.search(SOLID, x)]
        gone = set()
        for k in range(len(worded)):
            run = hashlib.sha256()
            n = 0
            for z in range(k, len(worded)):
                run.update(worded[z][1].encode() + b"\n")
                n += worded[z][2]
                if n >= min_words and seen.setdefault(run.digest(), (text, k)) != (text, k):
                    gone |= set(range(worded[k][0], worded[z][0] + 1))
        out[text] = text[1] if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return sorted(((t[0], out[t]) for t in texts), key=repr)


def test_repeated_lines(odd, none):
    found = line_dedup.dedup_lines(odd.withColumnsRenamed({"key": "runs", "rank": "row"}))
    assert rows_of(found.select("row.doc_id", "text")) == cut_lines(odd_texts(), 20)
    assert found.select("row.*").columns == [*odd.columns[:6], "runs", "component_id", "row"]
    assert set(map(tuple, found.select("row.runs", "row.n_words").distinct().collect())) == {("k", 7)}
    assert line_dedup.dedup_lines(none).count() == 0


def test_repeated_lines_need_many_doublings(spark):
    """Runs of one-word lines, so that ranks are doubled up to sixteen lines."""
    r = random.Random(3)
    parts = [[r.choice("abcdef") for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(12):
        a, b = r.choice(parts), r.choice(parts)
        k = r.randrange(40)
        texts.append((i, "\n".join(a[k : k + 22] + [f"own{i}"] + b + [""] * (i % 3) + a[:25])))
    rows = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    assert rows_of(line_dedup.dedup_lines(rows).select("row.doc_id", "text")) == cut_lines(texts, 20)


def test_repeated_runs_go_whole(spark):
    """The short last lines of a repeated run go with it, wherever it ends."""
    r = random.Random(11)

    def line(n):
        return " ".join(r.choice("abcdefgh") + str(r.randrange(1000)) for _ in range(n))

    a, b, c, d, e = line(60), line(5), line(15), line(10), line(6)
    texts = [(1, "\n".join((a, b, line(30), c, d, e))), (2, "\n".join((a, b, line(40)))), (3, "\n".join((line(9), c, d, "", e, line(25))))]
    pool = [line(n) for n in (1, 1, 2, 3, 5, 8, 13, 19, 20, 45) for _ in range(2)]
    for i in range(4, 24):
        k = r.randrange(len(pool) - 12)
        lines = [line(4), *pool[k : k + r.randrange(3, 12)], "", line(7), *r.sample(pool, 5), *pool[k + 2 : k + 9]]
        texts.append((i, "\n".join(x for own in lines for x in (*[" "] * r.randrange(-2, 3), own))))
    texts += [(24, "\n".join((a, line(5), pool[-1], "", "", pool[-2])))]
    texts += [(25, "\n".join((line(8), pool[-1], "", "", " ", pool[-2], line(3)))), (26, "\n".join((pool[-2], "", pool[-1], a)))]
    expected = dict(cut_lines(texts, 20))
    assert b not in expected[2] and e not in expected[3] and len(expected[25].split("\n")) == 2
    rows = spark.createDataFrame(texts, "doc_id LONG, text STRING").repartition(3)
    found = line_dedup.dedup_lines(rows)
    assert rows_of(found.select("row.doc_id", "text")) == sorted(expected.items(), key=repr)
    for x in found.collect():  # runs are maximal: none begins where another ends
        assert all(p.end + 1 < q.start for p, q in zip(x.runs, x.runs[1:]))


def test_proposed_shingles_are_held_once():
    """What a task proposes, by a plain count, in less than 40 bytes a shingle (49 before)."""
    texts = [prose(s, 4000).encode() for s in range(400)] + [b"", b"one two", b"a b c d " * 500]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    counts = defaultdict(int)
    for i, j in slices(bounds):
        for h in ngram_join.Sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]).shingles.tolist():
            counts[h] += 1
    ngram_join._proposed(data, bounds, 3)  # what is kept over calls
    tracemalloc.start()
    shingles, n, total, repeated = ngram_join._proposed(data, bounds, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    often = sorted(((-c, h) for h, c in counts.items() if c > 2))[: ngram_join.PROPOSED]
    assert list(zip((-n).tolist(), shingles.tolist())) == often
    assert (total, repeated) == (sum(counts.values()), sum(c for c in counts.values() if c > 1))
    assert peak < 40 * total
