"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

Method: a rolling hash over 16 bytes cuts every text where the content says so, so that passages which documents share
are cut into the same chunks. A worker encodes a chunk once and keeps the result. Where two chunks meet, the pre-tokens
may differ from those of the whole text, so each join is repaired: splitting starts again two pre-tokens before the
join, at a boundary known to be right, and goes on until one of its boundaries is also a boundary of the next chunk on
its own. From there on both agree, as the splitting pattern looks back at nothing. A token never crosses a pre-token.

Scale: documents stay in their task, nothing is shuffled, and caches have a fixed number of entries of bounded length. A
single pre-token of any length takes linear time: its open end is split again only when it has doubled. Chunks are shared
by the documents of one worker: sharing them over the cluster would shuffle all text and all ids once more.

Exactness: characters up to U+02FF are split here, checked one by one in a test; text with others is split by the
library. Special strings are cut out first, as the library does.

Defined results: null and empty texts give no ids and decode to the empty text. Repeated rows are encoded each. Other
columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import arrow_map, _BYTES, batch, byte_columns, kept_in_worker, mixed, slices, table

#: Pre-tokens at the end of a chunk that what follows may still change: a contraction reaches over two.
OPEN = 2
#: Pre-tokens at the start of a chunk that a repair may replace before the whole chunk is split anew.
HEAD = 8
#: A cut follows one of so many characters on average.
CHUNK_BYTES = 512
#: Entries of the caches of a worker, and how long a text may be that is kept.
PARTS_KEPT = 1 << 16
CHUNKS_KEPT = 1 << 14
LONGEST_KEPT = 1 << 12


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which a rolling hash of the last 16 bytes cuts; never inside a character."""
    if len(data) <= 16:
        return np.zeros(0, np.int64)
    h, step = _BYTES[data], 0x9E3779B97F4A7C15
    for width in (1, 2, 4, 8):
        h = h[:-width] * np.uint64(step) + h[width:]
        step = step * step % (1 << 64)
    chosen = (mixed(h[:-1]) % np.uint64(CHUNK_BYTES) == 0) & ((data[16:] & 0xC0) != 0x80)
    return np.flatnonzero(chosen) + 16


class _Kept(dict):
    """The latest entries: when full, the older generation is forgotten."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def find(self, key):
        found = self.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class ChunkEncoder:
    def __init__(self, path: str, chunk_reuse: bool = True) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(special, key=len, reverse=True)
        self.special = regex.compile("(" + ("|".join(map(regex.escape, longest_first)) or r"(?!)") + ")")
        self.special_ids = {s: array("I", [i]).tobytes() for s, i in special.items()}
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.unsafe = regex.compile("[^\u0000-˿]")
        self.parts: _Kept = _Kept(PARTS_KEPT)
        self.chunks, self.chunk_reuse = _Kept(CHUNKS_KEPT), chunk_reuse
        self.reused = 0
        letters = _letters()
        self.letters = [letter for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spelled = [b""] * self.tokenizer.get_vocab_size()
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.spelled[i] = token.encode()

    def split(self, text: str) -> list[str]:
        """Pre-tokens; end to end they are the text."""
        if self.unsafe.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.findall(text)

    def ids_of(self, parts: list[str]) -> bytes:
        out = list(map(self.parts.get, parts))
        if None in out:
            letters, tokenize = self.letters, self.tokenizer.model.tokenize
            for k, p in enumerate(parts):
                if out[k] is None and (ids := self.parts.find(p)) is None:
                    spelled = "".join([letters[b] for b in p.encode()])
                    ids = array("I", [t.id for t in tokenize(spelled)]).tobytes()
                    if len(p) <= LONGEST_KEPT:
                        self.parts.keep(p, ids)
                if out[k] is None:
                    out[k] = ids
        return b"".join(out)

    def _chunk(self, raw: bytes) -> tuple[str, list[str], bytes, str]:
        """Text, first pre-tokens, ids of those between them and the open end, and the open end."""
        if (found := self.chunks.find(raw)) is None:
            text = raw.decode()
            parts = self.split(text)
            closed = max(0, len(parts) - OPEN)
            head = parts[: min(HEAD, closed)]
            found = (text, head, self.ids_of(parts[len(head) : closed]), "".join(parts[closed:]))
            if len(raw) <= LONGEST_KEPT:
                self.chunks.keep(raw, found)
        else:
            self.reused += 1
        return found

    def _piece(self, raw: bytes) -> Iterator[bytes]:
        """Ids of a text without special strings."""
        if not self.chunk_reuse:
            yield self.ids_of(self.split(raw.decode()))
            return
        at = [0, *cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        left = ""  # begins at a boundary of the whole text; its end is open
        more, size, wait = [], 0, 0  # what follows it unsplit, until so many characters have come
        for a, b in zip(at, at[1:]):
            if wait:
                more.append(raw[a:b].decode())
                size += len(more[-1])
                if size < wait:
                    continue
                again = self.split(left + "".join(more))
                yield self.ids_of(again[:-OPEN])
                left = "".join(again[-OPEN:])
                more, size, wait = [], 0, self._wait(left)
                continue
            text, head, middle, end = self._chunk(raw[a:b])
            if not left:
                yield self.ids_of(head)
                yield middle
                left = end
                continue
            # Repair: split on from the known boundary until a boundary is one of the chunk's own.
            again = self.split(left + "".join(head))
            own = set(accumulate(map(len, head), initial=len(left)))
            agreed = next(
                (k for k, p in enumerate(accumulate(map(len, again[:-OPEN])), 1) if p in own), None
            )
            if agreed is not None:
                reached = sum(map(len, again[:agreed])) - len(left)
                rest = next(k for k, p in enumerate(accumulate(map(len, head), initial=0)) if p == reached)
                yield self.ids_of(again[:agreed] + head[rest:])
                yield middle
                left = end
            else:  # no agreement so far: the whole chunk is split from the known boundary
                again = self.split(left + text)
                yield self.ids_of(again[:-OPEN])
                left = "".join(again[-OPEN:])
                wait = self._wait(left)
        yield self.ids_of(self.split(left + "".join(more)))

    @staticmethod
    def _wait(left: str) -> int:
        """An open end of several chunks is split again when as much has come again, so that all splits take linear time."""
        return len(left) if len(left) > 4 * CHUNK_BYTES else 0

    def encode(self, raw: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, piece in enumerate(self.special.split(raw.decode()) if b"<" in raw else [None]):
            if k % 2:
                out.append(self.special_ids[piece])
            else:
                out += self._piece(raw if piece is None else piece.encode())
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as UTF-8; bytes that are no character read as U+FFFD."""
        raw = b"".join(map(self.spelled.__getitem__, array("I", ids)))
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones are themselves, the rest follow U+00FF."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_ENCODED = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_documents(documents: DataFrame, path: str, with_ids: bool = True, chunk_reuse: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (little-endian 32-bit)."""
    schema = pa.schema(_ENCODED + [("ids", pa.binary())] * with_ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("encoder", f"{path} {chunk_reuse}", lambda: ChunkEncoder(path, chunk_reuse))
        for rows in batches:
            data, bounds = byte_columns(rows.column(1))
            for i, j in slices(bounds, 8 << 20):
                part = data[bounds[i] : bounds[j]].tobytes()
                ends = (bounds[i : j + 1] - bounds[i]).tolist()
                n, digests, decoded, kept = [], [], [], []
                for a, b in zip(ends, ends[1:]):
                    ids = encoder.encode(part[a:b])
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    kept += [ids] * with_ids
                yield batch(schema, [rows.column(0).slice(i, j - i), n, digests, decoded, *[kept] * with_ids])

    wanted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(wanted, encode, names + ", ids binary" * with_ids)


_DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ids: doc_id and text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("encoder", f"{path} True", lambda: ChunkEncoder(path))
        for rows in batches:
            texts = [encoder.decode(ids or b"").decode() for ids in rows.column(1).to_pylist()]
            yield batch(_DECODED, (rows.column(0), texts))

    return arrow_map(encoded.select(F.col("doc_id").cast("long"), "ids"), decode, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(table(spark, sf_dir, "documents"), path, with_ids=False)


QUERIES = {"op5_bpe": query}
ORACLE: dict[str, str] = {}
