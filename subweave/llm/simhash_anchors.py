"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code over the fingerprints' bits: the perfect Golay code (4,096 words over 23 bits, no
fingerprint more than 3 bits from one). Each fingerprint is at home at its nearest anchor and is replicated to every anchor within
covering radius plus threshold, so two fingerprints that differ in at most that many bits meet at the home of either. Anchors
that are home to many are refined by the code over the next 23 bits, then by one over the rest; fingerprints are compared per anchor.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from subweave.llm.near_dedup import spanning_forest
from subweave.llm.shared import column, components, dropped, written
from subweave.llm.words import text_bytes


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """64 bits: each is 1 if over half of the shingles' XXH64 hashes, repeats included, have it set."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, 1 << 14):
        hi = min(n, lo + (1 << 14))
        spans = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(hi - lo, 64)  # of each byte, the highest bit first
        for cut in range(0, hi - lo, 255):
            counts += bits[cut : cut + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            for r in range(batch.num_rows):
                out[r] = fingerprint(data[offsets[r] : offsets[r + 1]].tobytes().lower().split(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    return run


@functools.cache
def golay_words() -> np.ndarray:
    """The 4,096 words of the perfect Golay code over 23 bits: the multiples of its generator polynomial."""
    generator = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    words = np.zeros(1, np.int64)
    for shift in range(12):
        words = np.concatenate([words, words ^ (generator << shift)])
    return np.sort(words)


@functools.cache
def rest_words() -> np.ndarray:
    """A code over the last 18 bits with covering radius 2: the Hamming code over 15 bits (those whose set positions XOR to 0), and 000 or 111."""
    words = np.arange(1 << 15)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(15):
        syndrome ^= ((words >> bit) & 1) * (bit + 1)
    return np.sort(np.concatenate([words[syndrome == 0], words[syndrome == 0] | (7 << 15)]))


LEVELS = [(0, 23, 3, golay_words), (23, 23, 3, golay_words), (46, 18, 2, rest_words)]  # first bit, bits, covering radius, code


def _near_masks(level: int, within: int) -> list[np.ndarray]:
    """Patterns of flipped bits, by their number from 0 to within."""
    bits = LEVELS[level][1]
    out = [np.zeros(1, np.int64)]
    single = np.int64(1) << np.arange(bits, dtype=np.int64)
    for _ in range(within):
        more = (out[-1][:, None] | single)[(out[-1][:, None] < single)]  # flips in ascending order
        out.append(more)
    return out


@functools.cache
def _homes(level: int) -> np.ndarray:
    """For every pattern of the level's bits the number of its nearest anchor (ties to the smaller)."""
    _, bits, radius, code = LEVELS[level]
    words, home = code(), np.full(1 << bits, -1, np.int16 if level < 2 else np.int32)
    for masks in _near_masks(level, radius):
        for m in masks:
            at = words ^ m
            free = home[at] < 0
            home[at[free]] = np.flatnonzero(free)
    return home


@functools.cache
def _around(level: int, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pattern in which bits may differ from the nearest anchor: the anchors of the code near it.

    The code is linear, so what is near a fingerprint is near its difference from its nearest anchor, moved by that anchor.
    Returns each pattern's number by its bits, where each number's list starts, and the lists: anchors, bits beyond the radius.
    """
    _, bits, radius, code = LEVELS[level]
    patterns = np.concatenate(_near_masks(level, radius))
    apart = np.bitwise_count(patterns[:, None] ^ code())
    rows, anchors = np.nonzero(apart <= radius + within)
    number = np.zeros(1 << bits, np.int16)
    number[patterns] = np.arange(len(patterns))
    return number, np.searchsorted(rows, np.arange(len(patterns) + 1)), code()[anchors], np.maximum(0, apart[rows, anchors].astype(np.int32) - radius)


def replicas(level: int, part: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints' bits of a level: (fingerprints, anchors, what is left) of all anchors not more than `left` bits beyond the covering radius."""
    homes = _homes(level)
    number, starts, words, beyond = _around(level, int(left.max(initial=0)))
    nearest = LEVELS[level][3]()[homes[part]]
    k = number[part ^ nearest]
    count = starts[k + 1] - starts[k]
    rows = np.repeat(np.arange(len(part)), count)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[k], count)
    rest = left[rows] - beyond[at]
    rows, at, rest = rows[rest >= 0], at[rest >= 0], rest[rest >= 0]
    return rows, homes[nearest[rows] ^ words[at]].astype(np.int64), rest


def _placed(level: int, distance: int):
    """(fp, key, left, home) -> the same rows at the anchors of one level more. left: bits that a partner may still differ in beyond the radii so far."""
    first, bits, _, _ = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = _homes(level)
        for batch in batches:
            fp, key, left, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "left", "home"))
            part = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
            size = len(LEVELS[level][3]())
            own, guests = np.flatnonzero(home), np.flatnonzero(~home)
            pieces = [(own, homes[part[own]].astype(np.int64), left[own], np.ones(len(own), bool))]
            for lo in range(0, len(guests), 1024):
                some = guests[lo : lo + 1024]
                rows, anchors, rest = replicas(level, part[some], left[some])
                pieces.append((some[rows], anchors, rest, np.zeros(len(rows), bool)))
            for rows, anchors, rest, at_home in pieces:
                if len(rows):
                    columns = [fp[rows], key[rows] * size + anchors, rest.astype(np.int32), at_home]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["fp", "key", "left", "home"])

    return run


def _links(distance: int, rows: int = 256):
    def run(table: pa.Table) -> pa.Table:
        """At one anchor, links that connect the same fingerprints as all pairs of a home and a replicated one would."""
        fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        homes, guests = np.sort(fp[home]), np.sort(fp[~home])
        owner = np.full(len(guests), -1, np.int64)  # of each guest, the first home linked with it
        found = [np.zeros((0, 2), np.uint64)]
        for lo in range(0, len(homes), rows):
            block = homes[lo : lo + rows]
            near = np.bitwise_count(block[:, None] ^ guests) <= distance
            near &= block[:, None] != guests
            linked = np.flatnonzero(near.any(0))
            if not len(linked):
                continue
            near = near[:, linked]
            first = near.argmax(0)
            i, j = np.nonzero(near)
            between = np.zeros((len(block), len(block)), bool)
            between[first[j], i] = between[i, first[j]] = True
            np.fill_diagonal(between, False)
            forest = np.array(spanning_forest(between), np.int64).reshape(-1, 2)
            before = owner[linked]
            met = before >= 0
            ends = np.unique(np.stack([before[met], first[met] + lo], axis=1), axis=0)
            new = linked[~met]
            owner[new] = first[~met] + lo
            found += [block[forest], homes[ends], np.stack([homes[owner[new]], guests[new]], axis=1)]
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0).view(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def linked_fingerprints(fingerprints: DataFrame, distance: int = 3, most: int = 4096) -> DataFrame:
    """Links (a long, b long) between distinct fingerprints (fp long) that connect what pairs at `distance` bits or fewer connect.

    distance: 0 to 7. Anchors that are home to more than `most` fingerprints are refined by the next code. At one anchor, blocks of
    about `most` homes are compared with blocks of 64 times as many replicated fingerprints, each pair of blocks in a task.
    """
    if not 0 <= distance <= 7:
        raise ValueError("distance must be from 0 to 7")
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("home")
    at = fingerprints.select("fp", F.lit(0).cast("long").alias("key"), F.lit(distance).alias("left"), both)
    ready = []
    for level in range(len(LEVELS)):
        at = written(at.mapInArrow(_placed(level, distance), "fp long, key long, left int, home boolean"), "anchors")
        count = at.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0")
        blocks = [F.ceil(F.col("homes") / most).cast("int").alias("rows"), F.ceil(F.col("guests") / (64 * most)).cast("int").alias("columns")]
        count = written(count.select("key", *blocks), "homes")
        many = count.where("rows > 1")
        last = level == len(LEVELS) - 1 or many.isEmpty()
        # a block of homes meets every block of guests, so each goes to all of the other's
        mine = lambda n: F.array(F.pmod(F.xxhash64("fp"), F.col(n)).cast("int"))
        all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        met = at.join(count if last else count.where("rows = 1"), "key")
        met = met.withColumn("row", F.explode(F.when(F.col("home"), mine("rows")).otherwise(all_of("rows"))))
        met = met.withColumn("column", F.explode(F.when(F.col("home"), all_of("columns")).otherwise(mine("columns"))))
        ready.append(met.select(F.lit(level).alias("level"), "key", "row", "column", "fp", "home"))
        if last:
            break
        at = at.join(many.select("key"), "key", "left_semi")
    every = functools.reduce(DataFrame.union, ready)
    return every.groupBy("level", "key", "row", "column").applyInArrow(_links(distance), "a long, b long").distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, most: int = 4096) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in few bits.

    docs: an integer id and a text column; other columns are ignored, whatever their names. Words are runs of characters other than
    ASCII white space, with A-Z lower-cased; shingles of `shingle` words are joined by blanks, repeats included; a text with fewer
    words is one shingle. A bit of the fingerprint is 1 if more than half of the shingles' XXH64 hashes (seed 42) have it.
    Texts that are null or have no words have the fingerprint zero, linked like any other.

    Returns one row per input row: id_col, fingerprint string (16 hexadecimal digits), component_id (smallest id reachable over
    links of `distance` differing bits or fewer, itself included). Equal fingerprints are compared once, however many rows hold
    them. A row with a null id has its fingerprint, links nothing and has a null component. Repeated ids: each row follows its own
    text. An empty table gives an empty result.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(shingle), "id long, fp long"), "fingerprints")
    classes = written(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = written(linked_fingerprints(classes.select("fp"), distance, most), "links")
    joined = written(components(links).select(F.col("id").alias("fp"), "component"), "components")
    placed = classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(smallest, "component").select("fp", "component_id"), "named")
    dropped(classes, links, joined)
    component = F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    out = rows.join(named, "fp", "left").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)
    return out.select(column("id").alias(id_col), "fingerprint", "component_id")
