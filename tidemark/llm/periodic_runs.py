"""Periodic runs of words: maximal repetitions of three periods or more.

Method: block convolution. At each dyadic scale B a text is cut into blocks of B words. A run of period q, B <= q < 2B,
and of length 3q holds a whole block together with the same words q further on, so it is enough to find where each block
occurs again at distances from B to 2B. Words are numbers, and a block stands at a distance where the sum of the squared
differences is zero; these sums are a convolution, done for all blocks of many texts at once by an exact integer
number-theoretic transform modulo a prime. The transform of a window is put together from the transforms of the two blocks
it covers. The least scale also takes the distances below 8. Blocks stay at ``LARGEST`` words for longer periods, which
then take several windows.

A distance is a seed: the repetition is extended word by word to both sides until it ends, which also refutes sums that
are zero by chance of the modulus. Seeds inside a run whose period divides theirs say nothing new and are dropped first.
Of the repetitions of one stretch the least period counts.

Scale: no shuffle; each text is worked on by itself, texts laid end to end in slices of bounded size. Work is
n log n squared in the words of a text, also of one that repeats a single word.

Defined results: null, empty and wordless texts have no words, no runs and the digests of nothing; a null doc_id stays
null, and its text is not damaged. Rows are judged one by one, whatever their doc_id. Other columns are ignored,
whatever their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, table

LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Words of the smallest and the largest block.
SMALLEST, LARGEST = 8, 1 << 18
#: 7 * 2**20 + 1: sums of 128 products of balanced residues are exact in doubles.
PRIME, _ROOT = 7_340_033, 3
_RADIX = 128
#: Words transformed at once.
SLICE_WORDS = 1 << 18


def _balanced(x: np.ndarray) -> np.ndarray:
    """Residues nearest to zero; exact while values are below 2**51."""
    return x - np.rint(x * (1.0 / PRIME)) * PRIME


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square = np.ones(exponents.shape, np.int64), base
    left = exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return _balanced(out.astype(np.float64))


@lru_cache(maxsize=64)
def _matrix(n: int, inverse: bool) -> np.ndarray:
    root = pow(_ROOT, (PRIME - 1) // n * (-1 if inverse else 1), PRIME)
    k = np.arange(n)
    return _powers(root, np.outer(k, k) % n)


@lru_cache(maxsize=8)
def _twiddles(rows: int, columns: int, inverse: bool) -> np.ndarray:
    root = pow(_ROOT, (PRIME - 1) // (rows * columns) * (-1 if inverse else 1), PRIME)
    return _powers(root, np.outer(np.arange(rows), np.arange(columns)))


def ntt(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row, without the factor 1/n of the inverse; n is a power of two."""
    m, n = x.shape
    if n <= _RADIX:
        return _balanced(x @ _matrix(n, inverse))
    rows, columns = _RADIX, n // _RADIX
    x = x.reshape(m, rows, columns)
    x = _balanced(_matrix(rows, inverse) @ x)
    x = _balanced(x * _twiddles(rows, columns, inverse))
    x = ntt(x.reshape(m * rows, columns), inverse)
    return x.reshape(m, rows, columns).transpose(0, 2, 1).reshape(m, n)


def block_matches(values: np.ndarray, block: int, windows: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) where a block may stand again: in window w at distances from w * block up to a block more.

    ``values`` has whole blocks; at its end windows are filled up with zeros. A true occurrence is never missed.
    """
    n = len(values) // block
    most = max(windows) + 1
    x = np.zeros(((n + most) * block,), np.float64)
    x[: n * block] = values
    squares = np.concatenate(([0], np.cumsum((x * x).astype(np.int64) % PRIME)))
    blocks = np.zeros((n + most, 2 * block))
    blocks[:, :block] = x.reshape(-1, block)
    spectra = ntt(blocks)
    turned = spectra[:n, -np.arange(2 * block) % (2 * block)]
    sign = np.where(np.arange(2 * block) % 2, -1.0, 1.0)
    scale = float(pow(2 * block, -1, PRIME))
    of, distances = [], []
    own = squares[block : (n + 1) * block : block] - squares[: n * block : block]
    for w in windows:
        products = _balanced(turned * _balanced(spectra[w : n + w] + sign * spectra[w + 1 : n + w + 1]))
        dots = _balanced(_balanced(ntt(products, inverse=True)[:, :block]) * scale)
        at = (np.arange(n)[:, None] + w) * block + np.arange(block)[None, :]
        sums = (squares[at + block] - squares[at] + own[:, None]).astype(np.float64) - 2 * dots
        block_at, offset = np.nonzero(_balanced(sums) == 0)
        of.append(block_at)
        distances.append(w * block + offset)
    return np.concatenate(of), np.concatenate(distances)


def _extended(ids: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The stretch around i in which words d apart are equal: its start, and its end d words behind the last such pair."""
    left, step = i, 64
    while left > 0:
        a = max(0, left - step)
        other = np.flatnonzero(ids[a:left] != ids[a + d : left + d])
        if len(other):
            left = a + int(other[-1]) + 1
            break
        left, step = a, step * 2
    right, step, n = i, 64, len(ids) - d
    while right < n:
        b = min(n, right + step)
        other = np.flatnonzero(ids[right:b] != ids[right + d : b + d])
        if len(other):
            right += int(other[0])
            break
        right, step = b, step * 2
    return left, right + d


class _Text:
    """Runs of one text, found scale by scale."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.runs: dict[tuple[int, int], int] = {}

    def seeds(self, at: np.ndarray, distances: np.ndarray, block: int) -> None:
        """Takes seeds, of distances not below those taken before."""
        inside = (distances > 0) & (at + distances + block <= len(self.ids))
        at, distances = at[inside], distances[inside]
        if not len(at):
            return
        by = np.lexsort((distances, at))
        at, distances = at[by], distances[by]
        open_ = np.ones(len(at), bool)
        for (start, end), period in self.runs.items():
            if end - start >= 2 * block:
                self._close(at, distances, block, open_, start, end, period)
        for k in np.lexsort((at, distances)).tolist():
            if not open_[k]:
                continue
            d = int(distances[k])
            start, end = _extended(self.ids, int(at[k]), d)
            self._close(at, distances, block, open_, start, end, d)
            if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * d) and self.runs.get((start, end), d) >= d:
                self.runs[start, end] = d

    @staticmethod
    def _close(at: np.ndarray, distances: np.ndarray, block: int, open_: np.ndarray, start: int, end: int, d: int) -> None:
        """Drops the seeds within a stretch of period d that are of the same or a multiple of that distance."""
        part = slice(*np.searchsorted(at, (start, end)).tolist())
        open_[part] &= (at[part] + distances[part] + block > end) | (distances[part] % d != 0)

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted(((s, e - s, q) for (s, e), q in self.runs.items()), key=lambda run: (run[0], run[2]))


def runs_of(texts: Sequence[np.ndarray], largest: int = LARGEST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of texts given as word numbers."""
    found = [_Text(ids) for ids in texts]
    scale = SMALLEST
    left = [k for k, ids in enumerate(texts) if len(ids) >= LEAST_LENGTH]
    while left:
        block = min(scale, largest)
        windows = range(scale // block, 2 * scale // block) if scale > SMALLEST else range(2)
        for a, b in _slices([len(texts[k]) for k in left]):
            part = left[a:b]
            sizes = [-(-len(texts[k]) // block) for k in part]
            starts = np.concatenate(([0], np.cumsum(sizes)))
            values = np.zeros(int(starts[-1]) * block, np.int64)
            for k, start in zip(part, starts.tolist()):
                values[start * block : start * block + len(texts[k])] = texts[k] + 1
            numbers, distances = block_matches(values % PRIME, block, windows)
            by = np.argsort(numbers, kind="stable")
            numbers, distances = numbers[by], distances[by]
            cuts = np.searchsorted(numbers, starts)
            for k, start, lo, hi in zip(part, starts.tolist(), cuts.tolist(), cuts[1:].tolist()):
                if hi > lo:
                    found[k].seeds((numbers[lo:hi] - start) * block, distances[lo:hi], block)
        scale *= 2
        left = [k for k in left if len(texts[k]) >= LEAST_PERIODS * scale]
    return [text.found() for text in found]


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for b, size in enumerate(sizes):
        if b > a and held + size > SLICE_WORDS:
            yield a, b
            a, held = b, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def damaged(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each of n words becomes, or None where the text of this id stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length in periods; of equal ones the first."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words but those a run repeats after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64())]
    + [(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())]
    + [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))]
)
RUN_COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"
)


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]], keep: bool) -> tuple:
    best = strongest(runs)
    start, length, period = best or (None, None, None)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    text = b" ".join(collapsed(words, runs))
    digest = hashlib.sha256(text).hexdigest()
    exponent = 1000 * length // period if best else None
    out = text.decode("utf-8", "replace") if keep else None
    spans = [dict(zip(("start", "length", "period"), run, strict=True)) for run in runs] if keep else None
    return doc_id, len(runs), start, length, period, exponent, listed, digest, out, spans


def _worker(damage: bool, keep: bool):
    def work(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        words, numbers = [], []
        for doc_id, text in rows:
            found = text.split()  # bytes split at \x20 and \x09-\x0D
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
            become = damaged(doc_id, len(found)) if damage else None
            if become is not None:
                ids, found = ids[become], [found[i] for i in become.tolist()]
            words.append(found)
            numbers.append(ids)
        out = [_row(row[0], w, runs, keep) for row, w, runs in zip(rows, words, runs_of(numbers), strict=True)]
        return batch(_OUT, zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held, size = [], 0
            for at in range(rows.num_rows):
                text = rows.column(1)[at].as_py() or b""
                if held and size + len(text) > 1 << 20:
                    yield work(held)
                    held, size = [], 0
                held.append((rows.column(0)[at].as_py(), text))
                size += len(text)
            if held:
                yield work(held)

    return run


def periodic_runs(documents: DataFrame, damage: bool = False, keep: bool = True) -> DataFrame:
    """Per row ``RUN_COLUMNS``: its runs, the strongest of them, digests, and with ``keep`` the collapsed text.

    With ``damage`` the words of some documents are first made to repeat, as their ids say (see ``damaged``).
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return arrow_map(rows, _worker(damage, keep), RUN_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), damage=True, keep=False).drop("collapsed", "runs")


QUERIES = {"op12_periodic_runs": query}
#: SQL has neither crc32 nor the convolution; tests/llm compares with brute force.
ORACLE = {"op12_periodic_runs": None}
