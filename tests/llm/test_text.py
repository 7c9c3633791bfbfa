"""Encoding, counting, formatting, contamination, language and quality, against libraries and brute force on odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.conftest import odd_texts, prose
from tidemark.llm import bpe, chat, decontaminate, language_id, quality_classifier, quality_rules, token_counts
from tidemark.llm.common import mixed, range_hashes

BYTES, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SOLID = r"[^\x20\x09-\x0D]+"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# BPE


def test_ids_equal_the_library(odd, none):
    library = Tokenizer.from_file(BYTES)
    expected = []
    for i, t in odd_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(bpe.encode_documents(odd, BYTES, with_ids=False)) == sorted(expected, key=repr)
    assert bpe.encode_documents(none, BYTES).count() == 0


def test_decoding_returns_the_text(odd):
    encoded = bpe.encode_documents(odd.where("doc_id is not null"), BYTES)
    back = rows_of(bpe.decode_documents(encoded, BYTES))
    assert back == sorted([(i, t or "") for i, t in odd_texts() if i is not None], key=repr)


def test_chunks_are_reused_and_joins_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 8)  # joins everywhere
    encoder, library = bpe.ChunkEncoder(BYTES), Tokenizer.from_file(BYTES)
    texts = [t or "" for _, t in odd_texts()] + ["I'll 'r" + "e'" * 9 + "   \n  x" * 40, "é'Î 12''ll   " * 50]
    for t in texts + texts:
        assert encoder.encode(t.encode()) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.reused > 1000


def test_one_long_pre_token_takes_linear_time(monkeypatch):
    """Splits of a text without boundaries add up to a few times its length."""
    r, split = random.Random(4), []
    encoder = bpe.ChunkEncoder(BYTES)
    plain = encoder.split
    monkeypatch.setattr(encoder, "split", lambda text: split.append(len(text)) or plain(text))
    text = "so " + "".join(r.choice("acgt") for _ in range(2_000_000)) + " it ends, 'tis so"
    ids = encoder.encode(text.encode())
    assert sum(split) < 8 * len(text) and encoder.decode(ids).decode() == text
    assert ids == bpe.ChunkEncoder(BYTES, chunk_reuse=False).encode(text.encode())


def test_shared_passages_are_cut_alike():
    shared = prose(40, 800).encode()
    a, b = (bpe.cuts(np.frombuffer(x.encode() + shared, np.uint8)) - len(x) for x in ("short", "another start, longer"))
    assert set(a[a >= 16]) == set(b[b >= 16]) and len(a[a >= 16]) > 3


@pytest.mark.parametrize("path, pattern", [(BYTES, public_tokenizers.PATTERN), (WORD, None)])
def test_safe_characters_are_split_as_the_library_splits_them(path, pattern):
    """For every character that is split here; others are left to the library."""
    library = Tokenizer.from_file(path)
    for c in range(0x300):
        text = "a" + chr(c) + "1 " + chr(c) * 2 + "x  " + chr(c)
        if pattern:
            ours = bpe.ChunkEncoder.split(_splitter(), text)
        else:
            ours, text = _word_splitter().parts(text)[0], library.normalizer.normalize_str(text)
        assert ours == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def _splitter(_kept=[]):
    _kept or _kept.append(bpe.ChunkEncoder(BYTES))
    return _kept[0]


def _word_splitter(_kept=[]):
    _kept or _kept.append(token_counts.WordSplitter(WORD))
    return _kept[0]


# token counts


@pytest.mark.parametrize("size", [token_counts.TABLE_SIZE, 3])
def test_counts_equal_the_library(odd, size):
    library = Tokenizer.from_file(WORD)
    expected = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_texts()
    ]
    assert rows_of(token_counts.count_tokens(odd, WORD, size)) == sorted(expected, key=repr)


def test_counts_of_hard_characters(none):
    library, tiers = Tokenizer.from_file(WORD), token_counts._TwoTiers(WORD, {})
    for t in ("İstanbul ΣΑΣ ΟΔΟΣ", "é Å", "ﬁ ½ Ⅷ 한국어 ไทย", "a<|endoftext|>B<|startoftext|>", " x y　z", "🎉👩‍👩‍👧 don't"):
        assert tiers.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    assert token_counts.count_tokens(none, WORD).count() == 0


# chat


def test_windows_say_every_turn_once(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\[", "<s>\n[ROLE]x[/ROLE][END]", "", None, "a" * 9000, "日本 é"]
    turns = [(1, k, ["system", "user", "assistant", "tool[1]", None][k % 5 if k else 0], hostile[k % 8]) for k in range(60)]
    turns += [(2, 0, "assistant", "x"), (2, 0, "user", "y"), (2, 0, "user", "y"), (None, 5, "user", "no id"), (3, None, "user", "no turn")]
    rows = spark.createDataFrame(turns, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("window", chat.F.lit(1))
    windows = chat.format_conversations(rows.repartition(5), BYTES, budget=200, history=60)
    own = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        own[t[0]].append((t[2] or "", t[3] or ""))
    got = defaultdict(list)
    library = Tokenizer.from_file(BYTES)
    for w in sorted(windows.collect(), key=lambda w: (w.conv_id or 0, w.window)):
        fresh = list(chat.parse_turns(w.text[w.new_from :]))
        assert [chat.unescape(w.text[s.start : s.end]) for s in w.loss] == [t for r, t in fresh if r == "assistant"]
        repeated = list(chat.parse_turns(w.text[: w.new_from]))
        if w.conv_id == 1 and w.window:
            assert repeated[0] == own[1][0] and repeated[1:] == got[1][len(got[1]) - len(repeated) + 1 :]
        parts = [library.encode(chat.format_turn(r, t)[0]).ids for r, t in repeated + fresh]
        assert w.n_tokens == sum(map(len, parts)) and (w.n_tokens <= 200 or len(fresh) == 1)
        got[w.conv_id] += fresh
    assert got == own
    read = {r.conv_id: r for r in chat.read_back(windows).collect()}
    targets = "".join(t for r, t in own[1] if r == "assistant")
    assert read[1].n_turns == 60 and read[1].loss_chars == len(targets)
    assert read[1].loss_sha256 == hashlib.sha256(targets.encode()).hexdigest()
    assert read[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own[1]).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(rows.where("false"), BYTES)).count() == 0


# decontamination


def contamination(texts, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for i, t in texts:
        w, hit, own = fold(t), set(), set()
        for item, text in items:
            b = fold(text)
            n = min(13, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    own.add(item)
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_contamination(odd, none, spark, block):
    texts = dict((i, t) for i, t in odd_texts() if t)
    items = [(1, texts[0][200:700]), (2, None), (3, ""), (4, "One, TWO!"), (5, "!!"), (6, texts[17][50000:50300]), (7, texts[0][200:700])]
    items += [(8, "été où"), (4, "One, TWO!"), (9, "ab")]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    found = decontaminate.find_contamination(odd, bench, block_bytes=block)
    expected = contamination(odd_texts(), items)
    assert rows_of(found.select("doc_id", "n_words", "n_hit", "item_ids")) == expected
    for r in found.where("n_hit > 0 and doc_id in (0, 17, 15)").collect():
        said = " ".join(texts[r.doc_id][s.start : s.end] for s in r.hit_spans)
        assert len(re.findall(r"\w+", said)) >= r.n_hit
    if block > 500:
        assert decontaminate.find_contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0
        assert decontaminate.find_contamination(none, bench).count() == 0
    for more in ([], [(99, texts[0][200:500])], [(None, texts[0][200:500])]):  # of rows of one id, or of none, each by its text
        rows = odd_texts() + more
        frame = odd.withColumnsRenamed({"key": "row", "rank": "hit"})
        frame = frame.unionByName(spark.createDataFrame([(*m, "x") for m in more], "doc_id LONG, text STRING, row STRING"), True)
        left = decontaminate.drop_contaminated(frame, bench, block_bytes=block)
        assert left.columns == frame.columns
        clean = [(i, t) for i, t in rows for _, n, h, _ in contamination([(i, t)], items) if not (h and 20 * h >= n)]
        assert rows_of(left.select("doc_id", "text")) == sorted(clean, key=repr)


# languages


def test_languages(spark, odd, none):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, prototypes = language_id.learn(table)
    found = language_id.predict(table, names, prototypes).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    right = found.where("lang = lang_pred").count()
    assert right >= 0.97 * found.count() and found.count() > 20
    rows = {r.doc_id: r for r in language_id.predict(odd, names, prototypes).collect()}
    assert len(rows) == len({i for i, _ in odd_texts()})
    assert {rows[i].lang_pred for i in (1, 2, 3)} == {"und"} and rows[1].score == 0.0
    assert all(0 <= r.score <= 1 and r.lang_pred in (*names, "und") for r in rows.values())
    assert language_id.learn(none)[0] == []
    assert {r.lang_pred for r in language_id.predict(odd, [], np.zeros((0, language_id.DIMENSIONS))).collect()} == {"und"}


def profile(text, vectors):
    """The bundle of the trigrams of a text, letter by letter."""
    codes = [0]
    for c in text or "":
        code = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    total = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            total += np.roll(vectors(a), 2) * np.roll(vectors(b), 1) * vectors(c)
    return total, any(codes)


def test_languages_equal_brute_force(spark, odd):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(
        odd.select("doc_id", quality_rules.F.substring("text", 1, 2500).alias("text"), "lang")
    )
    rows, space = table.collect(), language_id.Space()
    vectors = lambda code: space.letter(code).astype(float)
    out = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    profiles = [profile(r.text, vectors) for r in rows]
    languages = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for r, held, (v, _) in zip(rows, out, profiles, strict=True):
        if not held and r.doc_id is not None and r.lang is not None:
            languages[r.lang] += v
    names = sorted(languages)
    want = []
    for r, held, (v, lettered) in zip(rows, out, profiles, strict=True):
        cosines = [float(v @ languages[n]) / max(np.linalg.norm(v) * np.linalg.norm(languages[n]), 1e-9) for n in names]
        best = max(range(len(names)), key=lambda i: (cosines[i], -i))
        want.append((r.doc_id, held, names[best] if lettered else "und", min(max(cosines[best], 0), 1) if lettered else 0.0))
    got = language_id.predict(table, *language_id.learn(table)).collect()
    by = lambda r: (repr(r[:3]), r[3])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=by), sorted(want, key=by), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], abs_tol=1e-6)


def test_vectors_are_bound_and_bundled():
    space = language_id.Space()
    text = "Abc, ab".encode()
    keys, owners = space.trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    letters = {c: space.letter(ord(c) if c != " " else 0).astype(int) for c in "abc "}
    total = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in (" ab", "abc", "bc ", " ab", "ab "))
    assert (space.sums(keys, owners, 1)[0] == total).all()


# quality


def base_rules(t):
    w = re.findall(SOLID, t or "")
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if count[tuple(w[k : k + 3])] > 1}
    lines = [x for x in (t or "").split("\n") if re.search(SOLID, x)]
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def buckets(t):
    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return (seed - (1 << 64) if seed >= 1 << 63 else seed) % (quality_rules.BUCKETS // 2)

    w = re.findall(SOLID, t or "")
    return [h(x) for x in w] + [quality_rules.BUCKETS // 2 + h(x, y) for x, y in zip(w, w[1:])]


def log_ratio_table(texts, good):
    n, t = Counter(), Counter()
    for i, text in texts:
        n.update(buckets(text))
        if i in good:
            t.update(buckets(text))
    all_n, all_t, a = sum(n.values()), sum(t.values()), quality_rules.SMOOTH
    return {b: math.log((t[b] + a) / (n[b] * all_t / all_n + a)) for b in n}


def test_quality_rules(spark, odd, none):
    labels = spark.createDataFrame(
        [(0, 1, 0), (11, 1, None), (12, 1, 1), (17, 0, 0), (18, 1, 0), (18, 0, 0), (None, 1, 0), (99, 1, 0)],
        "doc_id LONG, quality INT, toxic INT",
    )
    ratios = log_ratio_table(odd_texts(), {0, 11})
    found = quality_rules.judge(odd, labels).collect()
    got = sorted([(r.doc_id, *r[1:6], r.base_failed, round(r.log_ratio, 9), r.kept) for r in found], key=repr)
    expected = []
    for i, t in odd_texts():
        b, g = base_rules(t), buckets(t)
        failed, mean = b[0] < 50 or 100 * b[4] > 50 * b[0], sum(ratios[x] for x in g) / max(1, len(g))
        expected.append((i, *b, failed, round(mean, 9), not failed and mean >= quality_rules.THRESHOLD))
    assert got == sorted(expected, key=repr)
    left = quality_rules.keep_good(odd, labels)
    assert left.columns == odd.columns and left.count() == sum(e[-1] for e in expected)
    assert quality_rules.judge(none, labels).count() == 0
    assert {r.log_ratio for r in quality_rules.judge(odd, labels.where("false")).collect()} == {0.0}


def test_windows_are_compared_by_their_words(spark):
    rows = spark.createDataFrame([(1, prose(1, 120) + " " + prose(1, 50)), (2, "a b " * 40), (3, "a b c a b"), (4, "")], "doc_id LONG, text STRING")
    words = quality_rules.word_list(quality_rules.F.col("text"))
    one = lambda *_: quality_rules.F.lit(1).cast("long")  # noqa: E731 (every hash collides)
    two = lambda a, b, c: quality_rules.F.length(a) % 2
    for hashed in (quality_rules.F.xxhash64, one, two):
        got = rows.select("doc_id", quality_rules.repeated_words(words, hashed)).collect()
        assert sorted(map(tuple, got)) == [(i, base_rules(t)[4]) for i, t in rows.collect()]


def test_classifier(spark, odd, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality_classifier.co_train(table, labels)
    scored = quality_classifier.score(table, model).join(labels, "doc_id").where(quality_classifier.F.crc32(quality_classifier.F.col("doc_id").cast("string")) % 5 == 0)
    rows = scored.collect()
    good = [r.score for r in rows if r.quality == 1 and not r.toxic]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([s >= 0.5 for s in good]) >= 0.95 and np.mean([s < 0.5 for s in bad]) >= 0.7
    found = quality_classifier.score(odd, model).collect()
    assert len(found) == len(odd_texts()) and all(0 <= r.score <= 1 for r in found)
    assert quality_classifier.co_train(odd, labels.where("quality = 1")) is None
    assert {r.score for r in quality_classifier.score(odd, None).collect()} == {0.5}
    assert quality_classifier.score(none, model).count() == 0


class BruteQuality:
    """Co-training on lists of features, one document at a time."""

    def __init__(self, rows, good, aside):
        self.q = quality_classifier
        self.rows = [(self.words(t), self.shapes(t), list(m)) for t, m in rows]
        self.good, self.aside = good, aside

    def bucket(self, word):
        data = np.frombuffer(word, np.uint8)
        return int(range_hashes(data, np.array([0]), np.array([len(data)]), lower=True)[0] % np.uint64(self.q.WORDS))

    def split(self, text):
        return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())

    def words(self, text):
        return {self.bucket(w) for w in self.split(text)}

    def shapes(self, text):
        spread = lambda x: int(mixed(np.array([x], np.uint64))[0] % np.uint64(self.q.WORDS))
        found = self.split(text)
        if not found:
            return set()
        ends = Counter(int(self.q._ENDING[w[-1]]) for w in found)
        out = {spread(kind * 8 + sum(n / len(found) >= s for s in self.q._SHARES)) for kind, n in ends.items()}
        # How many of the words are the first of their kind.
        distinct = len(self.words(text))
        return out | {spread(1024 + sum(distinct / len(found) >= s for s in self.q._FRESH))}

    def learn(self, labels):
        """Weights of both views, each from the documents that a label says it may learn from."""
        out = []
        for view, size in ((0, self.q.WORDS), (1, self.q.METAS)):
            counts, n = np.zeros((2, size)), [0, 0]
            for (words, shapes, meta), label in zip(self.rows, labels[view], strict=True):
                if label in (0, 1):
                    n[label] += 1
                    for key in words | shapes if view == 0 else meta:
                        counts[label, key] += 1
            share = n[1] / sum(n)
            smooth = self.q.SMOOTH
            out.append(np.log((counts[1] + smooth * share) / n[1]) - np.log((counts[0] + smooth * (1 - share)) / n[0]))
        return out

    def bins(self, weights):
        out = []
        for words, shapes, meta in self.rows:
            text = sum(weights[0][k] for k in words - shapes) / math.sqrt(max(len(words), 1)) + sum(weights[0][k] for k in shapes)
            pair = (text, sum(weights[1][k] for k in meta))
            reach, n = self.q.REACH, self.q.BINS
            out.append([int((min(max(x, -reach), reach - 1e-9) + reach) * n / (2 * reach)) for x in pair])
        return out

    def scores(self):
        known = [-1 if a else g for g, a in zip(self.good, self.aside, strict=True)]
        labels = (known, known)
        for k in range(self.q.ROUNDS + 1):
            bins, curves = self.bins(self.learn(labels)), []
            for view in (0, 1):
                tally = np.zeros((2, self.q.BINS))
                for at, g, a in zip(bins, self.good, self.aside, strict=True):
                    if a and g >= 0:
                        tally[g, at[view]] += 1
                curves.append(self.q.calibrated(tally[1], tally[0]))
            if k < self.q.ROUNDS:
                sure = lambda p: 1 if p >= self.q.SURE else 0 if p <= 1 - self.q.SURE else -1
                teach = lambda view: [
                    sure(curves[view][at[view]]) if g < 0 else k0 for at, g, k0 in zip(bins, self.good, known, strict=True)
                ]
                labels = (teach(1), teach(0))
        rate = known.count(1) / (known.count(0) + known.count(1))
        out = []
        for at in bins:
            p, q = curves[0][at[0]], curves[1][at[1]]
            odds = p / (1 - p) * q / (1 - q) * (1 - rate) / rate
            out.append((p, q, odds / (1 + odds)))
        return out


def test_classifier_equals_brute_force(spark):
    q = quality_classifier
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    texts = table.select("doc_id", "text", q._meta(table, q.METADATA).alias("meta")).collect()
    judged = defaultdict(lambda: 1)
    for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect():
        judged[r.doc_id] = min(judged[r.doc_id], r.quality * (1 - (r.toxic or 0)))
    good = [judged[r.doc_id] if r.doc_id in judged else -1 for r in texts]
    aside = [r.doc_id in judged and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in texts]
    want = BruteQuality([(r.text, r.meta) for r in texts], good, aside).scores()
    got = {r.doc_id: r[1:] for r in q.score(table, q.co_train(table, labels)).collect()}
    assert len(got) == len(texts) and -1 in good
    for r, w in zip(texts, want, strict=True):
        assert np.allclose(got[r.doc_id], w, atol=1e-9), r.doc_id


def test_calibration_does_not_fall():
    r = np.random.default_rng(0)
    p = quality_classifier.calibrated(r.integers(0, 50, 96), r.integers(0, 50, 96))
    assert (np.diff(p) >= 0).all() and len(p) == 96 and p.min() > 0 and p.max() < 1


def test_texts_without_repeated_windows_are_not_sorted(spark):
    """Only texts with windows of one hash are; of those the words decide, not the hash."""
    from pyspark.sql import functions as F

    texts = ["a b c d e f", "a b c d a b c", "a a a a", "a b", "", "x a b c y a b c z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").coalesce(1)
    words = quality_rules.word_list(F.col("text"))
    same = lambda *w: F.lit(7).cast("long") + F.length(w[0]) * 0
    for hashed in (F.xxhash64, same):
        found = rows.select(quality_rules.repeated_words(words, hashed).alias("n"))
        assert [r["n"] for r in found.collect()] == [0, 6, 4, 0, 0, 6]
    plan = rows.select(quality_rules.repeated_words(words))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan
