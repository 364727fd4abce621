"""Periodic stretches of words ("runs") by online square catching over dyadic blocks.

Words are appended to a text, some at a time. On every level k each completed, aligned block of 2^k words has a catcher for the
periods from 2^(k+1) - 1 to 2^(k+2) - 2: as words are appended it compares the hash of the last 2^k words with its block's. Each
appended word meets just two live catchers a level, so a text of n words costs 2 n log n comparisons. The first half of any square
holds an aligned block of its period's level, so none is missed. A catch whose neighbours on the block's left and right are caught
at the same distance is one with them; when the next block is not caught the stretch ends, its ends are found word by word, and
its squares have merged into one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subweave.llm.shared import column
from subweave.llm.words import mixed, runs, text_bytes

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_FACTOR = np.random.default_rng(41).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _Level:
    """The catchers of one block size: hashes of the last words' suffixes, and stretches of caught blocks that may go on."""

    def __init__(self, size: int):
        self.size = size
        self.suffixes = np.zeros(0, np.uint64)  # of the last positions; the last one's is that of the text's last word
        self.open = np.zeros((3, 0), np.int64)  # period, first and last block


class SquareCatcher:
    """Runs of a text that grows at its end: stretches of at least `exponent` times their smallest period that can't be extended.

    exponent: 2 or more. longest: a length that no run can pass, where the caller knows one.
    """

    def __init__(self, exponent: float = 4, longest: int | None = None):
        if exponent < 2:
            raise ValueError("exponent must be 2 at least")
        self.exponent, self.longest = exponent, longest
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.levels: list[_Level] = []
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    def append(self, words: np.ndarray) -> None:
        """Adds words, given as integers that are equal where the words are; how a text is cut into calls doesn't matter."""
        base, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:base], np.zeros(max(self.n, base * 2) - base, np.int64)])
        self.words[base : self.n] = words
        below, size, k = np.zeros(0, np.uint64), 1, 0
        while size <= self.n and (self.longest is None or self.exponent * (2 * size - 1) <= self.longest):
            if k == len(self.levels):
                self.levels.append(_Level(size))
            level, lo = self.levels[k], max(base, size - 1)
            if size == 1:
                new = mixed(self.words[base : self.n].astype(np.uint64))
            else:
                at, half = self.n - len(below), size // 2
                new = mixed(below[lo - half - at : self.n - half - at] * _FACTOR[k] + below[lo - at :])
            below = np.concatenate([level.suffixes, new])
            self._advance(level, below, lo)
            level.suffixes = below[max(0, len(below) - 4 * size) :]
            size, k = size * 2, k + 1

    def _advance(self, level: _Level, suffixes: np.ndarray, lo: int) -> None:
        """Compares the suffixes that end at lo and later with the blocks of the two catchers that are live there."""
        size, at = level.size, self.n - len(suffixes)
        caught = [level.open]
        for back in (0, size):
            first = max(lo, 3 * size - 2 + back)
            if first >= self.n:
                continue
            i = np.arange(first, self.n)
            end = (i - 2 * size + 2) // size * size - 1 - back
            hit = np.flatnonzero(suffixes[first - at :] == suffixes[end - at])
            if len(hit):
                end = end[hit]
                block = (end + 1) // size - 1
                caught.append(np.stack([i[hit] - end, block, block]))
        every = np.concatenate(caught, axis=1)
        if not every.shape[1]:
            return
        period, first, last = every[:, np.lexsort((every[1], every[0]))]
        head = np.concatenate([[True], (period[1:] != period[:-1]) | (first[1:] != last[:-1] + 1)])
        tail = np.concatenate([head[1:], [True]])
        joined = np.stack([period[head], first[head], last[tail]])
        live = (joined[2] + 2) * size - 1 + joined[0] >= self.n  # the next block's word is still to come
        level.open = joined[:, live]
        self._close(size, joined[:, ~live])

    def _close(self, size: int, stretches: np.ndarray) -> None:
        """Turns stretches of caught blocks (period, first and last block) into runs."""
        period, first, last = stretches
        enough = last - first + 1 >= np.maximum(1, ((self.exponent - 1) * period - (size - 1)) // size)
        period, lo, hi = period[enough], first[enough] * size, (last[enough] + 1) * size
        if len(period) > 4 and self.found:  # multiples of a known run's period inside it are no runs of their own
            known = np.array(sorted((s, e, q) for (s, e), q in self.found.items()), np.int64)
            reach = np.maximum.accumulate(known[:, 1])
            widest = np.searchsorted(reach, reach)  # the first run that reaches so far
            k = np.searchsorted(known[:, 0], lo, "right") - 1
            run = known[widest[np.maximum(k, 0)]]
            fresh = ~((k >= 0) & (run[:, 1] >= hi + period) & (period % run[:, 2] == 0))
            period, lo, hi = period[fresh], lo[fresh], hi[fresh]
        for q, a, b in zip(period.tolist(), lo.tolist(), hi.tolist(), strict=True):
            a, b = max(0, a - size), min(self.n - q, b + size)
            differ = np.flatnonzero(self.words[a:b] != self.words[a + q : b + q]) + a
            edges = np.concatenate([[a - 1], differ, [b]])
            for j in np.flatnonzero(np.diff(edges) - 1 >= (self.exponent - 1) * q):
                run = int(edges[j]) + 1, int(edges[j + 1]) + q
                self.found[run] = min(q, self.found.get(run, q))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start and period; more words may follow."""
        before = dict(self.found)
        for level in self.levels:
            self._close(level.size, level.open)
        out = sorted((s, e - s, q) for (s, e), q in self.found.items())
        self.found = before
        return [(s, n, q) for s, n, q in sorted(out, key=lambda r: (r[0], r[2]))]


def _pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    lo = 0
    while lo < len(data):
        blank = _BLANK.search(data, lo + most)
        hi = blank.start() if blank else len(data)
        yield data[lo:hi]
        lo = hi


def _with_runs(exponent: float, least: int, append: int = 1 << 16):
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in runs(offsets):
                numbers: dict[bytes, int] = {}
                texts = []
                for r in range(lo, hi):
                    own = [np.array([numbers.setdefault(w, len(numbers)) for w in piece.split()], np.int64) for piece in _pieces(data[offsets[r] : offsets[r + 1]].tobytes())]
                    texts.append(np.concatenate(own) if own else np.zeros(0, np.int64))
                # one text of all rows, with a word of its own after each row, which no run can pass
                catcher = SquareCatcher(exponent, max(map(len, texts)))
                flat = np.concatenate([x for k, t in enumerate(texts) for x in (t, np.array([-1 - k]))])
                for at in range(0, len(flat), append):
                    catcher.append(flat[at : at + append])
                starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
                found: list[list] = [[] for _ in texts]
                for s, n, q in catcher.runs():
                    if n >= least:
                        k = int(np.searchsorted(starts, s, "right")) - 1
                        found[k].append((s - int(starts[k]), n, q))
                words, kept = list(numbers), []
                for t, own in zip(texts, found, strict=True):
                    keep = np.ones(len(t), bool)
                    for s, n, q in own:
                        keep[s + q : s + n] = False
                    kept.append(b" ".join([words[i] for i in t[keep].tolist()]))
                tuples = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in own] for own in found]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(list(map(len, texts)), pa.int64()), pa.array(tuples, pa.list_(spans)), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: float = 4, least: int = 6) -> DataFrame:
    """Each text's periodic stretches of words, and the text without their repeats.

    docs: an integer id and a text column; other columns are ignored, whatever their names. Words are runs of characters other than
    ASCII white space, numbered from 0; case counts. A run is a stretch with smallest period q (words q apart are equal) of at least
    `least` words and `exponent` times q (2 or more) that no neighbouring word extends. A word is left out of `collapsed` if some run
    holds it after the run's first q words.

    Returns one row per input row: id_col, n_words long, runs array<struct<start, length, period: long>> by start, then period
    (empty without runs), collapsed string: the kept words joined by one blank. Null and empty texts and texts without words have
    no words and an empty collapsed text. Rows with a null id and repeated rows each get their own result; an empty table gives an
    empty result. No shuffle: a row depends on its own text alone; a task holds about 60 bytes for each word of its longest text.
    """
    out = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    out = out.mapInArrow(_with_runs(exponent, least), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(column("id").alias(id_col), "n_words", "runs", "collapsed")
