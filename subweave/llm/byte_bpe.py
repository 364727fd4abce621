"""Byte-level BPE over a global shuffle of distinct words.

Documents are cut into pre-tokens with their positions. A block of documents keeps its positions as numbers of the
block's own words; its words are dealt out by hash, so that equal words of all blocks meet in one place and each is
encoded once. Its ids go back to the blocks that have the word, where documents are put together by position.
Words travel packed, many to a row: a row for each occurrence would be larger than the texts several times over.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.shared import column, new_path, partitions

BLOCK_BYTES = 12 << 20  # text of a block of documents


@functools.cache
def token_bytes(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=token_bytes(path), special_tokens={})


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).reshape(-1).view("<u4"), at + 4 * n


def _short(x: np.ndarray) -> bytes:
    """Numbers of which small ones are the most frequent: a first byte each, and streams of the further bytes of those that need any."""
    x = x.astype(np.int64)
    one, two, three = x < 192, (x >= 192) & (x < 12_480), (x >= 12_480) & (x < 995_520)
    y, z = x - 192, x - 12_480
    first = np.where(one, x, np.where(two, 192 + (y >> 8), np.where(three, 240 + (z >> 16), 255))).astype(np.uint8)
    rest = ~(one | two | three)
    return b"".join([first.tobytes(), (y[two] & 255).astype(np.uint8).tobytes(), (z[three] & 0xFFFF).astype("<u2").tobytes(), x[rest].astype("<u4").tobytes()])


def _unshort(raw: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(raw, np.uint8, n)
    out = first.astype(np.int64)
    two, three, rest = (first >= 192) & (first < 240), (first >= 240) & (first < 255), first == 255
    a = n + int(two.sum())
    b = a + 2 * int(three.sum())
    out[two] = ((out[two] - 192) << 8) + np.frombuffer(raw, np.uint8, a - n, n) + 192
    out[three] = ((out[three] - 240) << 16) + np.frombuffer(raw, "<u2", int(three.sum()), a) + 12_480
    out[rest] = np.frombuffer(raw, "<u4", int(rest.sum()), b)
    return out


_PIECES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())])
_PIECES_DDL = "block long, bucket int, ids array<long>, sizes array<int>, body binary"


@functools.cache
def breaks_at_blanks(pattern: str) -> bool:
    """Whether a stretch from a blank or line feed to the next has the same matches wherever it stands, judged by all short combinations of kinds of characters."""
    import regex

    find = regex.compile(pattern).findall
    kinds = ["a", "Z", "7", "'", "'s", "-", "é", "東", "😀"]
    stretches = [" " + x + y for x in kinds for y in ["", *kinds]] + ["\n" + x for x in kinds]
    before = {x: find("x" + x)[1:] for x in stretches}
    return all(find(start + x + y) == find(start) + before[x] + before[y] for start in ("x", "it's", "3,", "") for x in stretches[:: len(kinds)] for y in stretches)


class _Block:
    """The words of a block in order of their first use, and what text between blanks they make up."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.local = breaks_at_blanks(pattern)
        self.number: dict[str, int] = {}
        self.chunks: dict[str, bytes | None] = {}

    def __call__(self, text: str) -> bytes:
        """The numbers of the text's pre-tokens.

        A stretch from a blank or line feed up to the next, with no other white space at its ends, has the same
        pre-tokens wherever it stands; these are remembered. Texts with other runs of white space, and all texts if the
        pattern has matches across blanks, are cut as a whole.
        """
        if not self.local:
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self.chunks
        try:
            if first != first.strip():
                return self.plain(text)
            body = b"".join([self.plain(first), *map(known.__getitem__, rest)])
        except (KeyError, TypeError):
            for c in rest:
                if c not in known:
                    core = c[1:] if c[:1] == "\n" else c
                    edge = core[:1] + core[-1:]
                    known[c] = self.plain(c if c[0] == "\n" else " " + c) if core and not edge[0].isspace() and not edge[1].isspace() else None
            if any(known[c] is None for c in rest):
                return self.plain(text)
            body = b"".join([self.plain(first), *map(known.__getitem__, rest)])
        return body

    def plain(self, text: str) -> bytes:
        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in self.find(text)], "<u4").tobytes()


_POSITIONS, _ORDER = -1, -2  # in the place of a bucket: a run of documents, the numbers of the words of all buckets


def _pretokens(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 24

        def row(bucket: int, ids: list, sizes: list, body: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": count, "bucket": bucket, "ids": ids, "sizes": sizes, "body": zstandard.compress(body, 3)}], schema=_PIECES)

        def finished(block: _Block, runs: list) -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in block.number]
            used = np.zeros(len(words), np.int64)
            for _, _, numbers in runs:
                used += np.bincount(numbers, minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-used, kind="stable")] = np.arange(len(words))  # the most frequent word is number 0
            for ids, sizes, numbers in runs:
                yield row(_POSITIONS, ids, sizes, _short(rank[numbers]))
            dealt: list[list[int]] = [[] for _ in range(buckets)]
            for i, w in enumerate(words):
                dealt[hash_of(w) % buckets].append(i)
            order = []
            for b, own in enumerate(dealt):
                if own:
                    own.sort(key=words.__getitem__)
                    order += own
                    yield row(b, [], [len(own)], b"\xff".join([words[i] for i in own]))  # a byte that no UTF-8 text has
            yield row(_ORDER, [], [], _planes(rank[order]) if order else b"")

        block, runs, size = _Block(pattern), [], 0
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                ids, streams, held = [], [], 0
                while lo < whole.num_rows and held < 1 << 20:
                    text = whole.column(1)[lo].as_py() or ""
                    ids.append(whole.column(0)[lo].as_py())
                    streams.append(block(text))
                    held += len(text)
                    lo += 1
                runs.append((ids, [len(s) // 4 for s in streams], np.frombuffer(b"".join(streams), "<u4")))
                size += held
                if size >= BLOCK_BYTES:
                    yield from finished(block, runs)
                    block, runs, size, count = _Block(pattern), [], 0, count + 1
        if runs:
            yield from finished(block, runs)

    return run


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word)


def _encode(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: each distinct word of a bucket is encoded once, and its ids go to every block that has it."""
        encode = _encoding(ranks, pattern).encode_ordinary
        vocabulary = token_bytes(ranks)
        known: dict[bytes, bytes] = {}
        current = None
        for batch in batches:
            bodies = []
            for bucket, body in zip(batch.column(1).to_pylist(), batch.column(4), strict=True):
                if bucket != current:
                    known, current = {}, bucket
                words = zstandard.decompress(body.as_py()).split(b"\xff")
                for w in words:
                    if w not in known:
                        known[w] = np.array([vocabulary[w]] if w in vocabulary else encode(w.decode()), "<u4").tobytes()
                found = [known[w] for w in words]
                counts = np.fromiter(map(len, found), "<u4", len(found)) // 4
                bodies.append(zstandard.compress(_planes(counts) + _planes(np.frombuffer(b"".join(found), "<u4")), 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bodies, pa.binary())], schema=_PIECES)

    return run


@functools.cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The table that decoding joins by id: all tokens' bytes, and where each id's begin (one more than ids)."""
    by_id = {i: w for w, i in token_bytes(path).items()}
    rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def joined_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in order, and where each id's end."""
    data, first = table
    size = first[ids + 1] - first[ids]
    ends = np.cumsum(size)
    return data[np.repeat(first[ids] - (ends - size), size) + np.arange(int(size.sum()))], ends


def _assembled(ranks: str):
    def run(pieces: pa.Table, encoded: pa.Table) -> pa.Table:
        """One block: the ids of its words, then its documents by position."""
        order = next(r["body"] for r in pieces.to_pylist() if r["bucket"] == _ORDER) if pieces.num_rows else zstandard.compress(b"")
        order = zstandard.decompress(order)
        order = _unplaned(order, 0, len(order) // 4)[0].tolist()
        ids_of: list[bytes] = [b""] * len(order)
        at = 0
        for r in sorted(encoded.to_pylist(), key=lambda r: r["bucket"]):
            body, n = zstandard.decompress(r["body"]), r["sizes"][0]
            counts, start = _unplaned(body, 0, n)
            flat = _unplaned(body, start, (len(body) - start) // 4)[0].tobytes()
            ends = (4 * np.cumsum(counts, dtype=np.int64)).tolist()
            for number, lo, hi in zip(order[at : at + n], [0, *ends], ends, strict=False):
                ids_of[number] = flat[lo:hi]
            at += n
        # the block's distinct words are decoded once: their ids joined with the token-byte table
        counts = np.array([len(x) // 4 for x in ids_of], np.int64)
        flat, ends = joined_bytes(np.frombuffer(b"".join(ids_of), "<u4").astype(np.int64), token_table(ranks))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        flat = flat.tobytes()
        raw = [flat[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)]
        names, ids, decoded = [], [], []
        for r in pieces.to_pylist():
            if r["bucket"] == _POSITIONS:
                numbers, lo = _unshort(zstandard.decompress(r["body"]), sum(r["sizes"])).tolist(), 0
                names += r["ids"]
                for size in r["sizes"]:
                    own = numbers[lo : lo + size]
                    lo += size
                    ids.append(b"".join([ids_of[i] for i in own]))
                    decoded.append(b"".join([raw[i] for i in own]))
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32())
        flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
        return pa.table([pa.array(names, pa.int64()), pa.ListArray.from_arrays(bounds, flat), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Byte-level BPE ids of whole texts, and the bytes that these ids stand for.

    ranks: file of base64 tokens and numbers; pattern: expression whose matches are encoded separately. No special
    tokens. Returns one row per input row: id, ids array<int>, decoded binary. Null texts are as empty (no ids).
    Ids may be null or repeat; each row follows its own text. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    buckets = buckets or 4 * partitions(spark)
    # written once, as blocks are named by task; bucketed by block, so that documents aren't shuffled again
    name = "pretokens_" + uuid.uuid4().hex
    pieces = rows.mapInArrow(_pretokens(pattern, buckets), _PIECES_DDL)
    pieces.write.format("parquet").bucketBy(partitions(spark), "block").option("path", new_path(spark, "pretokens")).saveAsTable(name)
    pieces = spark.table(name)
    encoded = pieces.where("bucket >= 0").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(ranks, pattern), _PIECES_DDL)
    whole = pieces.where("bucket < 0").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assembled(ranks), "id long, ids array<int>, decoded binary")
    return whole.withColumnRenamed("id", id_col)
