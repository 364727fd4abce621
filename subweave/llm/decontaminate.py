"""Benchmark decontamination: item-sized windows compared by SimHash, verified by weighted shingles.

For each benchmark item, windows of the item's own number of words slide over a document, one word at a time. Windows whose
shingles of the benchmark weigh too little for any item of that length are passed over, which loses nothing. The others
get fingerprints of 256 bits. A multi-index of 16 blocks proposes the items: fingerprints within the radius agree in some
block up to radius // 16 bits, so all of them are found. What it proposes is compared by its distance, and what is
within the radius is verified by the exact weighted similarity of the bags of word shingles.

A fingerprint's bit is the sign of a sum of normal values, one for each occurrence of a shingle in the window (the second of one
shingle has another value than its first) times the square root of its weight. The cosine of two such sums is then the weight of
what both bags hold over the root of the product of their weights, so similarity bounds the angle whatever the weights are.

The benchmark is written to the shared folder in slices; a task reads one after the other, so it holds one slice at a time, and
the documents are read once.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subweave.llm.shared import column, new_path, written
from subweave.llm.words import PUNCTUATION, mixed, runs, shingle_hashes, text_bytes, word_hashes

BITS, BLOCKS = 256, 16  # blocks of 16 bits
UNIT = 1 << 16  # weight of a shingle of one item; weights are whole numbers, so that running sums are exact
NO_HOLDERS = np.zeros(0, np.uint64), np.zeros(0, np.int32)
_SALTS = np.random.default_rng(41).integers(1, 2**63, BITS // 8, dtype=np.uint64)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)  # moves a shingle's further occurrences apart
_NORMAL = np.array([round(100 * NormalDist().inv_cdf((k + 0.5) / 256)) for k in range(256)], np.int32)
_ONES = np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1).sum(1).astype(np.uint8)
HITS = T.StructType([T.StructField("id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])


def radius_of(percent: int) -> int:
    """The most bits in which fingerprints of windows and items of this similarity differ, but for a chance of about 3e-5.

    Similarity s means a cosine of 2 s / (1 + s) at least, and each bit differs with the chance angle / pi.
    """
    same = percent / 100
    apart = math.acos(2 * same / (1 + same)) / math.pi
    return int(BITS * apart + 4.3 * math.sqrt(BITS * apart * (1 - apart)))


def numbered(grams: np.ndarray) -> np.ndarray:
    """How many equal shingles stand before each."""
    order = np.argsort(grams, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1]]))[: len(grams)]
    out = np.zeros(len(grams), np.int64)
    out[order] = np.arange(len(grams)) - np.repeat(head, np.diff(head, append=len(grams)))
    return out


def normals(grams: np.ndarray, number: np.ndarray | int, weights: np.ndarray) -> np.ndarray:
    """For each of the numbered shingles 256 normal values times the square root of its weight, as whole numbers."""
    features = grams + np.uint64(number) * _AGAIN if np.isscalar(number) else grams + number.astype(np.uint64) * _AGAIN
    out = np.take(_NORMAL, mixed(features[:, None] ^ _SALTS).view(np.uint8))
    out *= np.rint(256 * np.sqrt(weights / UNIT)).astype(np.int32)[:, None]
    return out


def bag_sums(grams: np.ndarray, weights: np.ndarray, values: np.ndarray | None = None, step: int = 4096) -> np.ndarray:
    """The sums of a whole bag, in steps, so that very long ones need little memory. values: the normals of first occurrences, where they are there."""
    number, total = numbered(grams), np.zeros(BITS, np.int64)
    again = np.flatnonzero(number) if values is not None else np.arange(len(grams))
    if values is not None:
        total += (values if not len(again) else values[number == 0]).sum(0, dtype=np.int64)
    for lo in range(0, len(again), step):
        k = again[lo : lo + step]
        total += normals(grams[k], number[k], weights[k]).sum(0, dtype=np.int64)
    return total


def simhash(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprint (16 numbers of 16 bits) of a bag of weighted shingles."""
    return np.packbits(bag_sums(grams, weights) > 0).view("<u2")


def window_simhashes(grams: np.ndarray, weights: np.ndarray, n: int, width: int, values: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the n windows of `width` shingles that start at 0, 1, ..., each from the one before.

    A window that moves on loses its last occurrence of the shingle that leaves and gains one more of the one that enters.
    values: the normals of all the shingles as first occurrences, where the caller has them.
    """
    sums = np.empty((n, BITS), np.int64)
    sums[0] = bag_sums(grams[:width], weights[:width], None if values is None else values[:width])
    if n > 1:
        names, place = np.unique(grams, return_inverse=True)
        start, end = np.arange(n - 1), np.arange(n - 1) + width
        leaving = entering = np.zeros(n - 1, np.int64)
        if len(names) < len(grams):
            base = place * np.int64(len(grams) + 1)
            key = base + np.arange(len(grams))
            order = np.sort(key)
            leaving = np.searchsorted(order, base[start] + end) - np.searchsorted(order, key[start]) - 1
            entering = np.searchsorted(order, key[end]) - np.searchsorted(order, base[end] + start + 1)
        change = np.zeros((n - 1, BITS), np.int32)
        for sign, at, number in ((1, end, entering), (-1, start, leaving)):
            own = normals(grams[at], 0, weights[at]) if values is None else values[at]
            if len(again := np.flatnonzero(number)):
                own = own.copy()
                own[again] = normals(grams[at[again]], number[again], weights[at[again]])
            (np.add if sign > 0 else np.subtract)(change, own, out=change)
        np.cumsum(change, axis=0, out=sums[1:])
        sums[1:] += sums[0]
    return np.packbits(sums > 0, axis=1).view("<u2")


def _flips(most: int) -> np.ndarray:
    """All numbers of 16 bits of which at most so many are set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(16), k)], np.uint16)


class MultiIndex:
    """Items by the values of their fingerprints' blocks; finds all within the radius of a fingerprint, and others."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        within = radius // BLOCKS
        self.asked = _flips(within // 3)  # a query flips some bits, the table holds the other flips
        held = _flips(within - within // 3)
        keys = (prints[:, :, None] ^ held).astype(np.uint32) | (np.arange(BLOCKS, dtype=np.uint32) << 16)[None, :, None]
        flat = keys.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owners = (order // (BLOCKS * len(held))).astype(np.int32)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a row of prints and an item."""
        wanted = ((prints[:, :, None] ^ self.asked).astype(np.uint32) | (np.arange(BLOCKS, dtype=np.uint32) << 16)[None, :, None]).reshape(len(prints), -1)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        row, at = np.nonzero(self.keys[place] == wanted)
        place = place[row, at]
        n = self.first[place + 1] - self.first[place]
        ends = np.cumsum(n)
        item = self.owners[np.repeat(self.first[place] - (ends - n), n) + np.arange(int(n.sum()))]
        pairs = np.unique(np.repeat(row, n) * np.int64(len(self.owners)) + item)
        return pairs // len(self.owners), pairs % len(self.owners)


class _SameLength:
    """The items of one number of words."""

    def __init__(self, n_words: int, size: int, radius: int) -> None:
        self.n_words, self.size, self.width, self.radius = n_words, size, n_words - size + 1, radius
        self.ids: list[int] = []
        self.bags: list[Counter] = []
        self.totals: list[int] = []
        self.rows: list[np.ndarray] = []

    def add(self, item_id: int, grams: np.ndarray, weight: np.ndarray) -> None:
        self.ids.append(item_id)
        self.bags.append(Counter(grams.tolist()))
        self.totals.append(int(weight.sum()))
        self.rows.append(simhash(grams, weight))

    @functools.cached_property
    def least(self) -> int:
        return min(self.totals)

    @functools.cached_property
    def prints(self) -> np.ndarray:
        return np.array(self.rows)

    @functools.cached_property
    def index(self) -> MultiIndex:  # made by the task that needs it first
        return MultiIndex(self.prints, self.radius)


class BenchmarkIndex:
    """A slice of the benchmark: each item's weighted shingles and fingerprint, and a multi-index for each number of words.

    A shingle's weight is 1 / (1 + ln n), n being the number of items of the whole benchmark, not of the slice, that hold it.
    holders: the sorted shingles that several items hold and their numbers of items; empty if there are none.
    """

    def __init__(self, items: list[tuple[int, str]], holders: tuple[np.ndarray, np.ndarray] | dict, shingle: int, radius: int) -> None:
        words, first = _words([t for _, t in items])
        self.shared, self.holders = holders or NO_HOLDERS
        lengths: dict[int, _SameLength] = {}
        grams_of: dict[int, list[np.ndarray]] = defaultdict(list)
        for r, (item_id, _) in enumerate(items):
            own = words[first[r] : first[r + 1]]
            if len(own):
                size = min(shingle, len(own))
                grams, _ = shingle_hashes(own, np.array([0, len(own)]), size)
                lengths.setdefault(len(own), _SameLength(len(own), size, radius)).add(item_id, grams, self.weights(grams))
                grams_of[size].append(grams)
        self.empty = not lengths
        # for each size of shingles all of them, a filter, and the items by number of words
        self.sizes = {}
        for size, found in grams_of.items():
            keys = np.unique(np.concatenate(found))
            self.sizes[size] = keys, _filter(keys), [x for x in lengths.values() if x.size == size]

    def weights(self, grams: np.ndarray) -> np.ndarray:
        n = np.ones(len(grams))
        if len(self.shared):
            place = np.minimum(np.searchsorted(self.shared, grams), len(self.shared) - 1)
            n = np.where(self.shared[place] == grams, self.holders[place], 1)
        return np.rint(UNIT / (1.0 + np.log(n))).astype(np.int64)

    def hits(self, words: np.ndarray, first: np.ndarray, percent: int) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, Hamming distance, first word, words) of each row's best window for each item that it holds."""
        counts = np.diff(first)
        for size, (keys, present, lengths) in self.sizes.items():
            grams, bounds = shingle_hashes(words, first, size)
            maybe = np.flatnonzero(present[(grams >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
            maybe = maybe[keys[place] == grams[maybe]]
            rows = np.searchsorted(bounds, maybe, "right") - 1
            maybe, rows = maybe[counts[rows] >= size], rows[counts[rows] >= size]
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for where, row in zip(np.split(maybe, cuts), rows[np.concatenate([[0], cuts])] if len(rows) else (), strict=False):
                for (c, item), best in self._in_row(grams[bounds[row] : bounds[row + 1]], where - bounds[row], lengths, percent).items():
                    score, distance, start, n_words = best
                    yield int(row), lengths[c].ids[item], score, distance, start, n_words

    def _in_row(self, grams: np.ndarray, where: np.ndarray, lengths: list[_SameLength], percent: int, step: int = 2048) -> dict:
        """The best window of one text for each item that it holds. where: places of shingles of the benchmark."""
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        weight, reach = self.weights(grams[where]), max(x.width for x in lengths)
        cuts = np.flatnonzero(np.diff(where) >= reach) + 1
        for near, own in zip(np.split(where, cuts), np.split(weight, cuts), strict=True):
            total = int(own.sum())
            fit = [c for c, x in enumerate(lengths) if 100 * total >= percent * x.least]
            if not fit:
                continue
            lo, hi = max(0, int(near[0]) - reach + 1), min(len(grams), int(near[-1]) + reach)
            sums = np.zeros(hi - lo + 1, np.int64)
            sums[near - lo + 1] = own
            np.cumsum(sums, out=sums)
            # shingles' normals serve all lengths, unless the stretch is too long to keep them
            values = normals(grams[lo:hi], 0, self.weights(grams[lo:hi])) if hi - lo <= 1 << 13 else None
            for c in fit:
                x = lengths[c]
                # places from the first window that holds a shingle of the benchmark to the last one; a shorter text is a window
                starts = np.arange(max(0, int(near[0]) - x.width + 1), max(0, min(int(near[-1]), len(grams) - x.width)) + 1)
                inside = sums[np.minimum(starts + x.width, hi) - lo] - sums[starts - lo]
                starts = starts[100 * inside >= percent * x.least]
                for k in range(0, len(starts), step):
                    self._compare(best, c, x, grams, starts[k : k + step], percent, lo, values)
        return best

    def _compare(self, best: dict, c: int, x: _SameLength, grams: np.ndarray, starts: np.ndarray, percent: int, since: int, values: np.ndarray | None) -> None:
        """values: the normals of the shingles from `since` on."""
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > x.width) + 1):
            lo, n = int(run[0]), int(run[-1] - run[0]) + 1
            part = grams[lo : lo + n - 1 + x.width]
            weight = self.weights(part)
            own = None if values is None else values[lo - since : lo - since + len(part)]
            prints = window_simhashes(part, weight, n, x.width, own)[run - lo]
            row, item = x.index.candidates(prints)
            distance = _ONES[prints[row] ^ x.prints[item]].sum(1, dtype=np.int64)
            close = distance <= x.radius
            for r, i, d in zip(row[close].tolist(), item[close].tolist(), distance[close].tolist(), strict=True):
                a = int(run[r]) - lo
                score = weighted_similarity(part[a : a + x.width], weight[a : a + x.width], x.bags[i], x.totals[i])
                if 100 * score >= percent - 1e-9 and ((c, i) not in best or score > best[c, i][0]):
                    best[c, i] = score, d, int(run[r]), min(x.n_words, len(grams) + x.size - 1 - int(run[r]))


def weighted_similarity(grams: np.ndarray, weights: np.ndarray, bag: Counter, total: int) -> float:
    """Weight in both over weight in either of a window's shingles and an item's; each counts as often as it occurs."""
    left, shared = dict(bag), 0
    for g, w in zip(grams.tolist(), weights.tolist(), strict=True):
        if left.get(g, 0) > 0:
            left[g] -= 1
            shared += w
    return shared / max(int(weights.sum()) + total - shared, 1)


def _words(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(pc.utf8_lower(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)), PUNCTUATION)


def _filter(keys: np.ndarray) -> np.ndarray:
    present = np.zeros(1 << 20, bool)
    present[(keys >> np.uint64(44)).astype(np.int64)] = True
    return present


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text")).where("id is not null and text is not null").distinct()


def shared_shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """(shingle long, n int): those that several of the items (id, text) hold and how many hold each, counted over all of them.

    A shingle that isn't among them has one holder or none and weighs 1 either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(0))
            for r in range(batch.num_rows):
                own = words[first[r] : first[r + 1]]
                held = np.unique(shingle_hashes(own, np.array([0, len(own)]), min(shingle, max(len(own), 1)))[0])
                for lo in range(0, len(held), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(held[lo : lo + (1 << 16)].view(np.int64))], names=["shingle"])

    return rows.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")


class Slices(NamedTuple):
    """A benchmark as files in the shared folder: items by slice, and the shingles that several items hold."""

    items: list[list[str]]
    holders: list[str]
    shingle: int
    radius: int


def _read(files: list[str]) -> pa.Table:
    return pa.concat_tables([pq.read_table(path, filesystem=fs, partitioning=None) for fs, path in map(FileSystem.from_uri, files)])


@functools.lru_cache(maxsize=1)
def _holders(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    if not files:
        return NO_HOLDERS
    found = _read(list(files))
    keys, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


@functools.lru_cache(maxsize=1)
def _loaded(files: tuple[str, ...], holders: tuple[str, ...], shingle: int, radius: int) -> BenchmarkIndex:
    """The index of a slice; a worker keeps the last one, so with a single slice it is made once."""
    items = _read(list(files))
    rows = sorted(zip(items.column("id").to_pylist(), items.column("text").to_pylist(), strict=True))
    return BenchmarkIndex(rows, _holders(holders), shingle, radius)


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, most: int) -> Slices:
    """Writes the items in slices of about `most` characters, and the shingles' numbers of items; only file names come to the driver."""
    rows = _items(benchmark, id_col, text_col)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    slice_of = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")
    path = new_path(benchmark.sparkSession, "benchmark")
    rows.withColumn("slice", slice_of).repartition("slice").write.partitionBy("slice").parquet(path)
    read = benchmark.sparkSession.read
    files: dict[str, list[str]] = defaultdict(list)
    for f in sorted(read.schema("id long, text string, slice int").parquet(path).inputFiles()):
        files[f.rsplit("/", 2)[1]].append(f)
    holders = written(shared_shingles(rows, shingle).coalesce(8), "holders")
    return Slices(list(files.values()), sorted(holders.inputFiles()), shingle, radius)


def _hits(slices: Slices, texts: pa.Array, percent: int) -> Iterator[tuple]:
    """(row, item, similarity, distance, first word, words) of the texts, slice after slice; their words are hashed once."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    groups = []
    for lo, hi in runs(offsets):
        own = offsets[lo : hi + 1]
        words, first = word_hashes(data[own[0] : own[-1]], own - own[0], PUNCTUATION)
        if len(words):
            groups.append((lo, words, first))
    del data
    for files in slices.items if groups else []:
        index = _loaded(tuple(files), tuple(slices.holders), slices.shingle, slices.radius)
        for lo, words, first in groups:
            for row, *rest in index.hits(words, first, percent):
                yield lo + row, *rest


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80, radius: int | None = None, slice_chars: int = 2_000_000) -> DataFrame:
    """Documents that hold benchmark items, one row for each document and item.

    Texts are lower-cased; words are runs of ASCII letters and digits and of characters beyond ASCII; items shorter than `shingle` words are one
    shingle of all their words. An item is found if a window of its length has 100 * similarity >= percent; a text of fewer words is
    one window. radius: bits of 256 in which the fingerprints may differ; it follows from percent where none is given.
    The benchmark is taken in slices of about slice_chars characters: every task reads them one after the other from the
    shared folder (file systems that pyarrow opens by their address) and holds one at a time. Shingle weights count the items of the
    whole benchmark, so results don't depend on slice_chars; for them a task holds 12 bytes for each shingle of several items.
    Returns: id, item_id, score double (best window's weighted similarity), distance int (its SimHash distance),
    first_word and n_words long (the window in the document's words). Null and empty texts hold nothing; items with a
    null id, a null text or no words are nowhere. Repeated rows of documents give repeated results; of items with the
    same id each text counts. Other columns are ignored; either table may be empty.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    slices = benchmark_slices(benchmark, item_id_col, item_text_col, shingle, radius or radius_of(percent), slice_chars)
    out = rows.mapInArrow(_search(slices, percent), HITS)
    return out.select(column("id").alias(id_col), "item_id", "score", "distance", "first_word", "n_words")


def _search(slices: Slices, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(_hits(slices, batch.column(1), percent))
            if held:
                row, *rest = zip(*held, strict=True)
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=HITS.names)

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item; all their columns as they were. Rows with a null id are judged by their own text too."""
    o = {"shingle": 5, "percent": 80, "radius": None, "slice_chars": 2_000_000, "item_id_col": "item_id", "item_text_col": "text"} | options
    slices = benchmark_slices(benchmark, o["item_id_col"], o["item_text_col"], o["shingle"], o["radius"] or radius_of(o["percent"]), o["slice_chars"])
    at, percent = docs.columns.index(text_col), o["percent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in _hits(slices, batch.column(at), percent):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
