"""Token-id files: ids of documents in order of their ids, in chunks of byte or bit planes compressed with zstandard.

A file is one range of documents. It holds the chunks one after the other and a footer: the chunk index (where each
chunk starts, how many ids it has, the length of each plane), the document index (id, null flag, number of ids), the
footer's own start and a magic number. Chunks have a fixed number of ids and don't end with documents.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.llm.shared import column, new_path, partitions, written
from subweave.llm.words import runs, text_bytes

MAGIC = b"PLANES01"
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The compressed planes of a block of unsigned 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = rows.T if kind == "byte" else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The block of ids again."""
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw]) if n else np.zeros((32, 0), np.uint8)
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(raw).T).reshape(-1).view("<u4")


class FileWriter:
    """Writes one file to an open stream."""

    def __init__(self, stream, kind: str, block: int) -> None:
        self.stream, self.kind, self.block, self.at = stream, kind, block, 0
        self.held: list[np.ndarray] = []
        self.n_held, self.chunks, self.docs = 0, [], []

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their names, how many ids each has, and all their ids."""
        self.docs.extend((k or 0, k is None, n) for k, n in zip(doc_ids, sizes.tolist(), strict=True))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        end = len(ids) if all_of_it else len(ids) // self.block * self.block
        for lo in range(0, end, self.block):
            part = ids[lo : min(lo + self.block, end)]
            planes = to_planes(part, self.kind)
            self.chunks.append([self.at, len(part), *map(len, planes)])
            for p in planes:
                self.stream.write(p)
                self.at += len(p)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self.flush(True)
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 3)
        chunks = np.array(self.chunks, dtype="<i8").reshape(-1, 2 + PLANES[self.kind])
        parts = [zstandard.compress(np.ascontiguousarray(a.T).tobytes()) for a in (chunks, docs)]
        head = json.dumps({"kind": self.kind, "block": self.block, "chunks": len(chunks), "docs": len(docs), "sizes": [len(p) for p in parts]}).encode()
        for b in (struct.pack("<I", len(head)), head, *parts, struct.pack("<Q", self.at), MAGIC):
            self.stream.write(b)


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of an open file and its ids, one chunk in memory at a time."""
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file")
    (at,) = struct.unpack("<Q", tail[:8])
    source.seek(at)
    (n,) = struct.unpack("<I", source.read(4))
    head = json.loads(source.read(n))
    load = lambda k, rows, width: np.frombuffer(zstandard.decompress(source.read(head["sizes"][k])), "<i8").reshape(width, rows).T if rows else (source.read(head["sizes"][k]), np.zeros((0, width), "<i8"))[1]
    chunks = load(0, head["chunks"], 2 + PLANES[head["kind"]])
    docs = load(1, head["docs"], 3)
    held, next_chunk = np.zeros(0, "<u4"), 0
    for doc_id, null, length in docs.tolist():
        parts = [held]
        have = len(held)
        while have < length:
            start, n_ids, *sizes = chunks[next_chunk].tolist()
            source.seek(start)
            raw, planes = source.read(sum(sizes)), []
            for s in sizes:
                planes.append(raw[:s])
                raw = raw[s:]
            parts.append(from_planes(planes, n_ids, head["kind"]))
            have += n_ids
            next_chunk += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield None if null else doc_id, held[:length]
        held = held[length:]


class Remembered:
    """A bounded memory: when it is full, what wasn't asked for since it was last full is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; afterwards all the others are in `new`."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        out, old, new = [], self.old, self.new
        for k in keys.difference(new):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                new[k] = v
        return out


# fixed values: how the files that PieceEncoder can read prepare a text
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class PieceEncoder:
    """Encodes texts with a tokenizer file that drops white space, each distinct piece between blanks and each of its words once.

    No token of such a tokenizer spans a blank, a line feed or a match of the file's own splitting pattern, so a text's ids are those of
    its words in order. Pieces are numbered and their ids put together column by column. Memories are bounded, which changes no result.
    Files with another normaliser or splitter are refused.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        parts = file["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[1]["add_prefix_space"] or file["normalizer"].get("normalizers") != _NORMALIZERS:
            raise ValueError("only for files that compose, lower-case, split by a pattern and then map bytes to letters")
        self.split = regex.compile(parts[0]["pattern"]["Regex"]).findall
        # byte-level letters: visible Latin characters stand for themselves, all other bytes for those from 256 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in own)}
        self.pack = [struct.Struct(f"<{k}I").pack for k in range(64)]
        self.marks = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = Remembered(most), Remembered(2 * most)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for lo in range(0, len(texts), 10_000) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 10_000], add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single matches of the splitting pattern, straight from the file's model."""
        tokenize, pack, letters = self.tokenizer.model.tokenize, self.pack, self.letters
        out = []
        for w in words:
            ids = [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin1").translate(letters))]
            out.append(pack[len(ids)](*ids) if len(ids) < len(pack) else np.array(ids, "<u4").tobytes())
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        plain, other = [], []
        for p in self.pieces.missing(set(pieces)):
            # visible Latin characters alone: lower case is the same for a word and letter by letter, nothing combines or is white space
            (plain if p.isprintable() and (not p or max(p) <= "\xff") and not any(m in p for m in self.marks) else other).append(p)
        found = [self.split(p.lower()) for p in plain]
        unknown = self.words.missing({w for ws in found for w in ws})
        self.words.new.update(zip(unknown, self._words(unknown), strict=True))
        known = self.words.new.__getitem__
        self.pieces.new.update(zip(plain, [b"".join(map(known, ws)) for ws in found], strict=True))
        self.pieces.new.update(zip(other, self._library(other), strict=True))
        return list(map(self.pieces.new.__getitem__, pieces))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more than texts); null is as empty."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        pieces = split.flatten().dictionary_encode()
        ids = self._pieces(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, number = np.frombuffer(b"".join(ids), "<u4"), pieces.indices.to_numpy()
        n = size[number]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[number] - (ends - n), n) + np.arange(int(n.sum()))
        bounds = split.offsets.to_numpy().astype(np.int64)
        return flat[at], np.concatenate([[0], ends])[bounds - bounds[0]]


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(folder: str, tokenizer: str, end_id: int | None, kind: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        writer = name = None
        shard = n_docs = n_ids = 0
        encode = _encoder(tokenizer)
        for whole in batches:
            for lo, hi in runs(text_bytes(whole.column(1))[1], 4 << 20):
                batch = whole.slice(lo, hi - lo)
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    shard = batch.column(2)[0].as_py()
                    name = f"{base}/tokens-{shard:06d}-{uuid.uuid4().hex}.bin"  # each attempt has its own; only a committed one is listed
                    stream = fs.open_output_stream(name)
                    writer = FileWriter(stream, kind, block)
                ids, first = encode(batch.column(1))
                sizes = np.diff(first)
                if end_id is not None:
                    ids, sizes = np.insert(ids, first[1:], end_id), sizes + 1
                writer.add(batch.column(0).to_pylist(), sizes, ids)
                n_docs += len(sizes)
                n_ids += len(ids)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n_docs]), pa.array([n_ids])], names=["shard", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 1, shards: int | None = None, kind: str = "byte", block: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them as token files in ascending order of ids, one file for each range of ids.

    Null texts are as empty; end_id is appended to each document (None: nothing). Null ids come first; rows with the
    same id stand together, ordered by a hash of their text. Other columns are ignored. kind: byte or bit planes.
    folder must be reachable from all executors; by default a new one in the shared folder.
    Returns the manifest, one row per file: shard int, path, n_docs, n_tokens, start long (ids in all files before it).
    An empty table makes no file and no row.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards or partitions(spark), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    files = ordered.select("id", "text", F.spark_partition_id().alias("shard")).mapInArrow(_write(folder, tokenizer, end_id, kind, block), "shard int, path string, n_docs long, n_tokens long")
    files = written(files, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = _filesystem(path)
            held, size = [], 0
            with fs.open_input_file(name) as source:
                for doc_id, ids in read_file(source):
                    held.append((doc_id, at, len(ids), ids.tobytes()))
                    at += len(ids)
                    size += len(ids)
                    if size > 1 << 21 or len(held) >= 5000:
                        yield _rows(held)
                        held, size = [], 0
            if held:
                yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["id", "start", "n_tokens", "ids"])


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files of a manifest: id, start long, n_tokens long, ids binary (little-endian unsigned 32-bit) per document."""
    paths = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return paths.mapInArrow(_read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
