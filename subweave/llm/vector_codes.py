"""Product codes of integer vectors: k-means codebooks for each part of the vectors, over Hilbert-sorted blocks.

Vectors are scaled to integers and cut into equal parts. Each part position's vectors are sorted along a Hilbert curve and stored
as flat blocks with the box of their least and largest components and their sums. In each round the distances between a block's
box and the codebook's entries leave the block a short list of entries that can be nearest to anything in it; with one entry left,
the block's stored sums are taken whole, else small kernels over the list find each vector's nearest entry, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.shared import column, dropped, partitions, written

_LIMIT = 1 << 26  # of a scaled component's size, so that squared distances stay exact in 64 bits


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with components of `bits` bits (rows x dimensions, at most 64 bits in all), as unsigned numbers.

    By Gray codes: from the highest bit down each component's bit decides how the lower bits of the others are turned.
    """
    x = x.astype(np.uint64).T.copy()
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1) << np.uint64(b), (np.uint64(1) << np.uint64(b)) - np.uint64(1)
        for d in range(len(x)):
            on = (x[d] & bit) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1) << np.uint64(b)
        turn ^= np.where(x[-1] & bit, bit - np.uint64(1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << np.uint64(1)) | ((x[d] >> np.uint64(b)) & np.uint64(1))
    return key


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """A column of packed numbers as rows."""
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width) if len(column) and data is not None else np.zeros((0, width), kind)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32).tobytes() if width else bytes(4 * (len(x) + 1))), pa.py_buffer(x.tobytes())])


def _keyed(parts: int, width: int, low: np.ndarray, high: np.ndarray):
    """(row, ints) -> (part, key, row, vector): each part with its place on the curve."""
    dims = min(width, 64)
    bits = min(16, 64 // dims)
    step = np.maximum(1, high - low).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, parts, width)
            for p in range(parts):
                cells = np.floor((x[:, p] - low[p]) / step[p] * (2**bits - 1)).astype(np.int64)
                key = (hilbert_keys(cells[:, :dims], bits) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed numbers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(key), batch.column(0), _packed(x[:, p].astype("<i4"))], names=["part", "key", "row", "vector"])

    return run


def _blocks(width: int, size: int):
    """Sorted (part, key, row, vector) -> blocks of at most `size` vectors of a part: part, n, rows, flat, low, high, total."""

    def block(part: int, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        starts = np.arange(0, len(x), size)
        n = np.diff(starts, append=len(x))
        reduced = [np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)]
        total = np.add.reduceat(x.astype(np.int64), starts)
        flat = [x[a : a + size].tobytes() for a in starts]
        ids = [rows[a : a + size].tobytes() for a in starts]
        columns = [pa.array(np.full(len(starts), part, np.int32)), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(flat, pa.binary()), *map(_packed, reduced), _packed(total)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "n", "rows", "flat", "low", "high", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, x = -1, np.zeros(0, np.int64), np.zeros((0, width), "<i4")
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            ids, vectors = batch.column(2).to_numpy(), _matrix(batch.column(3), width, "<i4")
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if own[a] != part and len(x):
                    yield block(part, rows, x)
                    rows, x = rows[:0], x[:0]
                part = int(own[a])
                rows, x = np.concatenate([rows, ids[a:b]]), np.concatenate([x, vectors[a:b]])
                if full := len(x) // size * size:
                    yield block(part, rows[:full], x[:full])
                    rows, x = rows[full:], x[full:]
        if len(x):
            yield block(part, rows, x)

    return run


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer rows, the nearest entry (ties to the lower) and its squared distance, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # products of whole numbers are exact in double precision
        a, b = x.astype(np.float64), entries.astype(np.float64)
        far = (b * b).sum(1) - 2 * (a @ b.T)
        best = far.argmin(1)
        return best, (far[np.arange(len(x)), best] + (a * a).sum(1)).astype(np.int64)
    a, b = x.astype(np.int64), entries.astype(np.int64)
    far = np.stack([((a - e) ** 2).sum(1) for e in b], axis=1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def short_lists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks x entries: whether the entry can be the nearest one (ties to the lower) of some point of the block's box."""
    low, high, e = low[:, None].astype(np.float64), high[:, None].astype(np.float64), entries[None].astype(np.float64)
    least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(low - e), np.abs(high - e)) ** 2).sum(2).min(1, keepdims=True)
    return least <= most * (1 + 1e-9)


def _rounds(width: int, codebooks: list[np.ndarray], last: bool):
    """Blocks -> sums by entry (part, entry, n, total) of a task, or, in the last round, (row, part, entry, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        totals = [np.zeros(c.shape, np.int64) for c in codebooks]
        for batch in batches:
            part, total = batch.column(0).to_numpy(), _matrix(batch.column(6), width, "<i8")
            low, high = _matrix(batch.column(4), width, "<i4"), _matrix(batch.column(5), width, "<i4")
            for cut in range(0, batch.num_rows, 128):
                for p in np.unique(part[cut : cut + 128]):
                    blocks = np.flatnonzero(part[cut : cut + 128] == p) + cut
                    entries = codebooks[p]
                    for k, listed in zip(blocks.tolist(), short_lists(low[blocks], high[blocks], entries), strict=True):
                        choice = np.flatnonzero(listed)
                        n = batch.column(1)[k].as_py()
                        if len(choice) == 1 and not last:
                            counts[p][choice[0]] += n
                            totals[p][choice[0]] += total[k]
                            continue
                        x = np.frombuffer(batch.column(3)[k].as_buffer(), "<i4").reshape(n, width)
                        best, error = nearest(x, entries[choice])
                        best = choice[best]
                        if last:
                            rows = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(n, p, np.int32)), pa.array(best.astype(np.int32)), pa.array(error)], names=["row", "part", "entry", "error"])
                            continue
                        np.add.at(counts[p], best, 1)
                        np.add.at(totals[p], best, x.astype(np.int64))
        for p, (n, t) in enumerate(zip(counts, totals, strict=True)):
            used = np.flatnonzero(n)
            if len(used) and not last:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(t[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, block: int = 64
) -> DataFrame:
    """Codes of vectors by codebooks of `size` entries (256 at most) for each of `parts` equal parts, in exact integers.

    Each component x becomes floor(scale * x). The codebooks start as the parts of the `size` smallest ids' vectors, ascending (equal
    ids by their components). Each round assigns every part to the nearest entry by squared Euclidean distance, ties to the lower,
    then sets each entry to its parts' floor(sum / count); unused entries stay. Finally parts are assigned again.

    vectors: an integer id, an array column and a label; other columns are ignored, whatever their names. Left out are rows with a
    null id, vectors that are null, empty or hold null or non-finite components, and those whose number of components isn't that of
    the smallest id's. That number must be a multiple of `parts`, and scaled components must be below 2 ** 26 in size; else
    ValueError. Repeated rows count as often as they occur and each get their code.

    Returns one row per row kept: id_col, code string (each part's entry in two hexadecimal digits), error long (squared distances
    summed over the parts), label_error long (errors summed over equal labels, nulls together), codebooks_sha256 string (all final
    entries' components by part, entry and position, joined by commas). An empty table gives an empty result.
    The driver holds the codebooks and one sum for each entry; blocks hold `block` vectors.
    """
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = vectors.select(column(id_col).cast("long").alias("id"), column(label_col).alias("label"), column(vector_col).cast("array<double>").alias("vector"))
    v = v.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)
    v = v.select("id", "label", F.transform("vector", lambda c: F.floor(c * scale).cast("long")).alias("ints"))
    first = v.select("id", "ints").orderBy("id", "ints").limit(1).collect()
    if not first:
        return v.select(column("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    dim = len(first[0].ints)
    width = dim // parts
    if dim % parts or not 1 <= size <= 256:
        raise ValueError("vectors must cut into equal parts, and codebooks hold 256 entries at most")
    rows = written(v.where(F.size("ints") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    spans = rows.select([F.min(F.col("ints")[d]).alias(f"l{d}") for d in range(dim)] + [F.max(F.col("ints")[d]).alias(f"h{d}") for d in range(dim)]).first()
    low, high = (np.array(spans[a : a + dim], np.int64).reshape(parts, width) for a in (0, dim))
    if max(-int(low.min()), int(high.max())) >= _LIMIT:
        raise ValueError("components are too large for exact sums")
    start = np.array([r.ints for r in rows.orderBy("id", "ints").limit(size).select("ints").collect()], np.int64).reshape(-1, parts, width)
    codebooks = [start[:, p] for p in range(parts)]

    keyed = rows.select("row", "ints").mapInArrow(_keyed(parts, width, low, high), "part int, key long, row long, vector binary")
    sort = ["part", "key", F.xxhash64("row")]  # equal vectors, however many, are dealt to several ranges
    dealt = keyed.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort)
    blocks = written(dealt.mapInArrow(_blocks(width, block), "part int, n int, rows binary, flat binary, low binary, high binary, total binary"), "blocks")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_rounds(width, codebooks, last=False), "part int, entry int, n long, total array<long>")
        # numbers of their own columns add up before the shuffle
        wide = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)])
        codebooks = [c.copy() for c in codebooks]
        for r in wide.collect():
            codebooks[r.part][r.entry] = np.array(r[3:], np.int64) // r.n
    assigned = blocks.mapInArrow(_rounds(width, codebooks, last=True), "row long, part int, entry int, error long")
    digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    coded = assigned.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", digits.alias("hex")))).alias("p"), F.sum("error").alias("error"))
    coded = rows.select("row", "id", "label").join(coded, "row").select("id", "label", F.array_join(F.col("p.hex"), "").alias("code"), "error")
    coded = written(coded, "codes")
    dropped(blocks, rows)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    digest = hashlib.sha256(",".join(str(x) for c in codebooks for x in c.reshape(-1).tolist()).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    return out.select(column("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
