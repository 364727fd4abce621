"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad, judged by its own and its neighbours' features and by the label of the line before. The
forward-backward marginals of a document's lines, weighted by their lengths, are its quality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLASS = np.full(256, ord("o"), np.uint8)  # other: letters beyond ASCII and control characters
for _k, _v in ((range(97, 123), "l"), (range(65, 91), "u"), (range(48, 58), "d"), (b" \t\r\x0b\x0c", "s"), (b".,;:'\"?()-", "p")):
    for _b in _k:
        _CLASS[_b] = ord(_v)
for _b in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_b] = ord("y")
_CLASSES = _CLASS.tobytes()
_NAMES = 13
FEATURES = 3 * _NAMES + 1  # own, previous and next line, and one that is always 1


def line_features(line: str) -> tuple[list[float], int]:
    """Shares and counts of a line, each about 0 to 1; and its length in characters."""
    n = len(line)
    raw = line.encode("utf-8", "replace").translate(_CLASSES)
    size = max(len(raw), 1)
    upper, lower, digit, symbol, point = raw.count(b"u"), raw.count(b"l"), raw.count(b"d"), raw.count(b"y"), raw.count(b"p")
    words = line.split()
    k = max(len(words), 1)
    distinct = len(set(words))
    return [
        upper / max(upper + lower, 1),
        symbol / size,
        min(4 * symbol / k, 3) / 3,
        digit / size,
        point / size,
        min(line.count(" | ") * 4 / k, 3) / 3,
        distinct / k,
        1.0 - (distinct / k) ** 2 if k > 8 else 0.0,
        min(n / k, 20) / 20,
        min(k, 60) / 60,
        1.0 if k <= 3 else 0.0,
        1.0 if line[-1:] in ".!?\"" else 0.0,
        1.0 if line == line.upper() and upper > 3 else 0.0,
    ], n


def document_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's non-blank lines with their neighbours', and the lines' lengths."""
    rows = [line_features(x) for x in re.split(r"[\n\r]+", text or "") if x and not x.isspace()]
    if not rows:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32)
    own = np.array([r for r, _ in rows], np.float32)
    none = np.zeros((1, _NAMES), np.float32)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones((len(own), 1), np.float32)]), np.array([n for _, n in rows], np.float32)


def _padded(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(w) for _, w in docs)
    x = np.zeros((len(docs), most, FEATURES), np.float32)
    w = np.zeros((len(docs), most), np.float32)
    for i, (a, b) in enumerate(docs):
        x[i, : len(b)], w[i, : len(b)] = a, b
    return x, w


class LineField:
    """Two labels (0 bad, 1 good); weights of features and of label pairs."""

    def __init__(self) -> None:
        self.own = np.zeros((FEATURES, 2))
        self.pair = np.zeros((2, 2))

    def marginals(self, x: np.ndarray, real: np.ndarray, pairs: bool = False):
        """Probabilities of the labels of each line (documents x lines x 2), by forward-backward over all documents at once."""
        score = x @ self.own.astype(np.float32)
        d, t, _ = score.shape
        fore, back = np.zeros((d, t, 2)), np.zeros((d, t, 2))
        fore[:, 0] = score[:, 0]
        add = lambda v: np.logaddexp(v[:, 0], v[:, 1])
        for k in range(1, t):
            new = add(fore[:, k - 1, :, None] + self.pair) + score[:, k]
            fore[:, k] = np.where(real[:, k, None], new, fore[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = add(((score[:, k + 1] + back[:, k + 1])[:, None, :] + self.pair).transpose(0, 2, 1))
            back[:, k] = np.where(real[:, k + 1, None], new, 0.0)
        total = add(fore[:, -1, :, None])[:, 0]
        p = np.exp(fore + back - total[:, None, None]) * real[:, :, None]
        if not pairs:
            return p
        both = np.exp(fore[:, :-1, :, None] + self.pair + (score + back)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        return p, both

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-4) -> LineField:
        """Adam over the whole sample; every line of a document has its document's label. Bad documents count as much as good ones."""
        kept = sorted(((d, y) for d, y in zip(docs, labels, strict=True) if len(d[1])), key=lambda v: len(v[0][1]))
        if not kept:
            return self
        n_bad = max(sum(y == 0 for _, y in kept), 1)
        n_good = max(len(kept) - n_bad, 1)
        groups = []
        for lo in range(0, len(kept), 256):
            part = kept[lo : lo + 256]
            x, w = _padded([d for d, _ in part])
            y = np.array([v for _, v in part])
            weight = np.where(y == 1, 0.5 / n_good, 0.5 / n_bad) / np.maximum((w > 0).sum(1), 1)
            groups.append((x, w > 0, y, weight))
        theta = np.zeros(FEATURES * 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            grad_own, grad_pair = np.zeros((FEATURES, 2)), np.zeros((2, 2))
            for x, real, y, weight in groups:
                p, both = self.marginals(x, real, True)
                gap = (real[:, :, None] * np.eye(2)[y][:, None, :] - p) * weight[:, None, None]
                grad_own += np.tensordot(x, gap.astype(np.float32), ((0, 1), (0, 1)))
                said = np.eye(2)[y][:, :, None] * np.eye(2)[y][:, None, :]
                grad_pair += ((said[:, None] * real[:, 1:, None, None] - both) * weight[:, None, None, None]).sum((0, 1))
            grad = np.concatenate([grad_own.ravel(), grad_pair.ravel()]) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.own, self.pair = theta[: FEATURES * 2].reshape(FEATURES, 2), theta[FEATURES * 2 :].reshape(2, 2)
        return self

    def scores(self, texts: list[str | None], empty: float) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good; `empty` for texts without a line."""
        docs = [document_lines(t) for t in texts]
        out = np.full(len(docs), empty)
        order = sorted((i for i, d in enumerate(docs) if len(d[1])), key=lambda i: len(docs[i][1]))
        lo = 0
        while lo < len(order):
            hi = lo + 1  # documents of much the same number of lines together, 20,000 lines at most unless one has more
            while hi < len(order) and (hi + 1 - lo) * len(docs[order[hi]][1]) <= 20_000 and len(docs[order[hi]][1]) <= 2 * len(docs[order[lo]][1]) + 4:
                hi += 1
            x, w = _padded([docs[i] for i in order[lo:hi]])
            p = self.marginals(x, w > 0)[:, :, 1]
            out[order[lo:hi]] = (p * w).sum(1) / w.sum(1)
            lo = hi
        return np.clip(out, 0.0, 1.0)


def bucket(id_col: str | Column, parts: int) -> Column:
    """crc32 of an id as text, modulo `parts`; null for a null id."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % parts


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, sample: int = 1500) -> LineField:
    """Fits on labelled rows outside the held-out fold.

    sample: bound on the rows of each label that are fitted, those of smallest hash of the id; whole texts. Rows without a text, an id
    or a label aren't used; a document labelled more than once counts once, with its smallest label. Without any
    labelled row the field stays at even odds.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (bucket(id_col, folds) != held_out)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 x sample rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(2 * sample).collect()
    return LineField().fit([document_lines(r.text) for r in rows], [r.y for r in rows])


def quality_scores(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, empty: float = 0.0) -> DataFrame:
    """id, score double (0 to 1), predicted int (1 if score >= threshold).

    Null and empty texts and texts of blank lines score `empty`. Only the text is an input. Ids may be null or repeat;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist(), empty))], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, model: LineField, text_col: str = "text", threshold: float = 0.3, empty: float = 0.0) -> DataFrame:
    """docs without those that score below threshold, all their columns as they were."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                keep = model.scores(batch.column(names.index(text_col)).to_pylist(), empty) >= threshold
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
