"""Token counts by a map-side two-tier lookup.

Method: one pass counts pre-tokens inside each task, which proposes its most frequent ones; the sums over all tasks give
a table of at most ``table_size`` frequent pre-tokens, whose token counts are worked out once and broadcast. The second
pass splits every text into pre-tokens and adds up their counts: from the broadcast table, else from a cache in the
worker, which encodes a miss once. No pre-token is shuffled but the proposals; the table decides only what is fast.

Exactness: texts whose characters the library and ``regex`` class alike (up to U+02FF, checked for each of them in a
test) are split here; any other text is normalised and split by the library itself. Special strings are cut out first,
as the library does, and count as one token each.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows count each; other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import arrow_map, batch, kept_in_worker, table

#: Entries of the broadcast table, and of the proposal of one task.
TABLE_SIZE = 8192
PROPOSED = 4096
#: Entries of a worker's cache; a full one starts anew.
CACHE_SIZE = 1 << 17
LIMIT = 2048


class WordSplitter:
    """Pre-tokens of a lower-casing word tokenizer, and the token count of one."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.findall = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.unsafe = regex.compile("[^\u0000-˿]")

    def parts(self, text: str) -> tuple[list[str], int]:
        """The normalised pre-tokens of a text and the number of its special strings."""
        pieces = self.special.split(text) if "<" in text else [text]
        out: list[str] = []
        for piece in pieces:
            if self.unsafe.search(piece):
                piece = self.tokenizer.normalizer.normalize_str(piece)
                out += [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
            else:
                out += self.findall(piece.lower())
        return out, len(pieces) - 1

    def count(self, part: str) -> int:
        spelled = "".join(p for p, _ in self.bytes_as_letters.pre_tokenize_str(part))
        return len(self.tokenizer.model.tokenize(spelled))


class _Counts(dict):
    """Token counts of pre-tokens, worked out when first asked for."""

    def __init__(self, splitter: WordSplitter) -> None:
        super().__init__()
        self.splitter = splitter

    def __missing__(self, part: str) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[part] = n = self.splitter.count(part)
        return n


class _TwoTiers:
    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        self.splitter = kept_in_worker("splitter", path, lambda: WordSplitter(path))
        self.frequent = frequent
        self.rare = _Counts(self.splitter)

    def count(self, text: str) -> int:
        parts, special = self.splitter.parts(text)
        frequent, rare = self.frequent, self.rare
        return special + sum([frequent[p] if p in frequent else rare[p] for p in parts])


_PROPOSALS = pa.schema([("part", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())])


def frequent_parts(documents: DataFrame, path: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """The most frequent pre-tokens of all documents with their token counts: (part, n, tokens)."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = kept_in_worker("splitter", path, lambda: WordSplitter(path))
        seen: Counter[str] = Counter()
        for rows in batches:
            for text in rows.column(0).to_pylist():
                seen.update(splitter.parts(text or "")[0])
                if len(seen) > 8 * CACHE_SIZE:
                    seen = Counter(dict(seen.most_common(CACHE_SIZE)))
        top = seen.most_common(PROPOSED)
        yield batch(_PROPOSALS, ([p for p, _ in top], [n for _, n in top], [splitter.count(p) for p, _ in top]))

    found = arrow_map(documents.select(F.col("text").cast("string")), propose, "part string, n long, tokens long")
    found = found.groupBy("part").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
    return found.orderBy(F.desc("n"), "part").limit(table_size)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(documents: DataFrame, path: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """Per document: doc_id, n_bytes of its UTF-8 text, n_tokens."""
    rows = frequent_parts(documents, path, table_size).select("part", "tokens").toArrow()
    frequent = dict(zip(rows["part"].to_pylist(), rows["tokens"].to_pylist(), strict=True))
    spread = documents.sparkSession.sparkContext.broadcast(frequent)
    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = kept_in_worker("tiers", run, lambda: _TwoTiers(path, spread.value))
        for rows in batches:
            texts = rows.column(1).to_pylist()
            yield batch(
                _COUNTED,
                (rows.column(0), [len((t or "").encode()) for t in texts], [tiers.count(t or "") for t in texts]),
            )

    wanted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(wanted, count, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op6_token_counts": query}
ORACLE: dict[str, str] = {}
