"""Language of a document by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes from both sides, blanks and all, gives every byte position a distribution over the
languages, and a document pools the log-probabilities of all its positions. Texts are read in windows, many at once: each
position of a window has read at least the OVERLAP bytes before it and after it (or all there are), so its label hardly
depends on where windows begin. It is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.llm.quality_crf import bucket
from subweave.llm.shared import column
from subweave.llm.words import runs, text_bytes

WINDOW, OVERLAP = 512, 48  # bytes that a window labels, and bytes read before and after them
MOST = 32_768  # windows times languages that are read at once


def _soft(x: np.ndarray) -> np.ndarray:
    """Between -1 and 1, without an exponential; its slope is (1 - |y|) ** 2 where it is y."""
    return x / (1 + np.abs(x))


def _softmax_log(logits: np.ndarray, axis: int) -> np.ndarray:
    logits = logits - logits.max(axis, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis, keepdims=True))


class ByteGRU:
    """Gated recurrent units in both directions and a softmax over languages at every byte.

    A unit's update gate z, reset gate r and candidate c: with a = state @ g, z = (1 + s(x_z + a_z)) / 2, r = (1 + s(x_r + a_r)) / 2,
    c = s(x_c + r * a_c), and the new state is z * state + (1 - z) * c; x is the byte's row of a table, s(v) = v / (1 + |v|).
    """

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        h, k = hidden, len(langs)
        self.w = {f"{d}{n}": r.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("x", 0.3, (256, 3 * h)), ("g", 0.6 / h**0.5, (h, 3 * h)), ("o", 0.4, (h, k)))}
        self.w["bias"] = np.zeros(k, np.float32)

    # training: time x sequences, row by row, with masks

    def _one_way(self, d: str, steps: np.ndarray, real: np.ndarray):
        """States of one direction and what led to them; where nothing is real the state stays as it is."""
        h, w = self.hidden, self.w
        state = np.zeros((steps.shape[1], h), w[d + "g"].dtype)
        states, held = [], []
        for k in range(len(steps)):
            x, a = w[d + "x"][steps[k]], state @ w[d + "g"]
            gates = 0.5 + 0.5 * _soft(x[:, : 2 * h] + a[:, : 2 * h])
            z, r, u = gates[:, :h], gates[:, h:], a[:, 2 * h :]
            c = _soft(x[:, 2 * h :] + r * u)
            held.append((state, z, r, c, u))
            state = np.where(real[k][:, None], z * state + (1 - z) * c, state)
            states.append(state)
        return np.stack(states), held

    def step(self, data: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for sequences of bytes (rows of data, sizes of them real); every position has its sequence's language."""
        h, w = self.hidden, self.w
        t = int(sizes.max())
        steps, real = data[:, :t].T, np.arange(t)[:, None] < sizes
        fore, fheld = self._one_way("f", steps, real)
        back, bheld = self._one_way("b", steps[::-1], real[::-1])
        logp = _softmax_log(fore @ w["fo"] + back[::-1] @ w["bo"] + w["bias"], 2)
        n = real.sum()
        loss = -float((logp[:, np.arange(len(y)), y] * real).sum() / n)
        gap = np.exp(logp)
        gap[:, np.arange(len(y)), y] -= 1
        gap *= (real / n).astype(gap.dtype)[:, :, None]
        g = {"bias": gap.sum((0, 1))}
        for d, states, held, own, seen, mask in (("f", fore, fheld, gap, steps, real), ("b", back, bheld, gap[::-1], steps[::-1], real[::-1])):
            g[d + "o"] = np.tensordot(states, own, ((0, 1), (0, 1)))
            into = own @ w[d + "o"].T
            g[d + "g"] = np.zeros_like(w[d + "g"])
            carried = np.zeros_like(states[0])
            rows = []
            for i in range(t - 1, -1, -1):
                state, z, r, c, u = held[i]
                m = mask[i][:, None]
                whole = carried + into[i]
                dh = np.where(m, whole, 0)
                dz = dh * (state - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
                dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da = np.hstack([dz, dr, dc * r])
                g[d + "g"] += state.T @ da
                rows.append(np.hstack([dz, dr, dc]))
                carried = np.where(m, dh * z + da @ w[d + "g"].T, whole)
            rows, at = np.concatenate(rows), seen[::-1].reshape(-1)
            order = np.argsort(at, kind="stable")
            values, first = np.unique(at[order], return_index=True)
            g[d + "x"] = np.zeros_like(w[d + "x"])
            g[d + "x"][values] = np.add.reduceat(rows[order], first, axis=0)
        return loss, g

    def fit(self, texts: list[bytes], y: np.ndarray, rounds: int = 250, batch: int = 128, length: int = 64, rate: float = 0.02, seed: int = 6) -> ByteGRU:
        """Adam over random stretches of the texts, the languages equally often."""
        if not texts:
            return self
        r = np.random.default_rng(seed)
        by = [b for b in (np.flatnonzero(y == k) for k in range(len(self.langs))) if len(b)]
        m = {n: np.zeros_like(v) for n, v in self.w.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.w.items()}
        for i in range(1, rounds + 1):
            at = np.concatenate([r.choice(b, batch // len(by) + 1) for b in by])
            cut = [texts[k][(s := int(r.integers(0, max(len(texts[k]) - length, 0) + 1))) : s + length] for k in at]
            sizes = np.array([len(c) for c in cut])
            data = np.frombuffer(b"".join(c.ljust(length, b"\0") for c in cut), np.uint8).reshape(-1, length)
            _, g = self.step(data, sizes, y[at])
            pace = rate * (1.0 if i < 0.6 * rounds else 0.3)
            for n in self.w:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v2[n] = 0.99 * v2[n] + 0.01 * g[n] ** 2
                self.w[n] = (self.w[n] - pace * (m[n] / (1 - 0.9**i)) / (np.sqrt(v2[n] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    # prediction: one array for each gate and for the candidate, so that every step works on whole arrays

    def _advance(self, d: str, state: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The states (windows x units) after one more byte of each window."""
        g, x = self._parts[d + "g"], self._parts[d + "x"]
        z, r, c = (state @ k for k in g)
        z += x[0].take(seen, axis=0)
        r += x[1].take(seen, axis=0)
        size = np.abs(z)
        size += 1
        z /= size
        np.abs(r, out=size)
        size += 1
        r /= size
        r *= c  # the table holds halves of the candidate's part of g: r * a_c = (1 + gate) * half
        c += r
        c += x[2].take(seen, axis=0)
        np.abs(c, out=size)
        size += 1
        c /= size
        out = state - c
        out *= z
        out += state
        out += c
        out *= 0.5
        return out

    def _prepare(self) -> None:
        h = self.hidden
        split = lambda m: [np.ascontiguousarray(m[:, k * h : (k + 1) * h]) for k in range(3)]
        self._parts = {d + n: split(self.w[d + n]) for d in "fb" for n in "xg"}
        for d in "fb":
            self._parts[d + "g"][2] *= 0.5
        self._parts |= {d + "o": np.ascontiguousarray(self.w[d + "o"].T) for d in "fb"}

    def pooled(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """For each text data[lo:hi] the sums of its positions' log-probabilities.

        labels: also filled with every position's log-probabilities (bytes of data x languages).
        """
        self._prepare()
        n = -(-(hi - lo) // WINDOW)
        owner = np.repeat(np.arange(len(lo)), n)
        start = lo[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        out = np.zeros((len(lo), len(self.langs)))
        size = np.minimum(hi[owner] - start, WINDOW)
        order = np.argsort(-size, kind="stable")
        together = max(64, MOST // max(8, len(self.langs)))
        for k in range(0, len(order), together):
            own = order[k : k + together]
            before, after = np.minimum(start[own] - lo[owner[own]], OVERLAP), np.minimum(hi[owner[own]] - start[own] - size[own], OVERLAP)
            np.add.at(out, owner[own], self._windows(data, start[own], size[own], before, after, labels))
        return out

    def _windows(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        """Sums over the windows, longest first; before, after: how many bytes around each are read too."""
        k, n = len(self.langs), len(start)
        state = self._warm("f", data, start, before, -1)
        held = np.empty((int(size.max(initial=0)), k, n), np.float32)
        for j in range(len(held)):
            m = int(np.searchsorted(-size, -j))  # windows with more than j bytes
            state = self._advance("f", state[:m], data[start[:m] + j])
            held[j, :, :m] = self._parts["fo"] @ state.T
        state = self._warm("b", data, start + size - 1, after, 1)
        sums, bias = np.zeros((k, n)), self.w["bias"][:, None]
        for j in range(len(held) - 1, -1, -1):
            m = int(np.searchsorted(-size, -j))
            state[:m] = self._advance("b", state[:m], data[start[:m] + j])
            logits = held[j, :, :m]
            logits += self._parts["bo"] @ state[:m].T
            logits += bias
            logp = _softmax_log(logits, 0)
            sums[:, :m] += logp
            if labels is not None:
                labels[start[:m] + j] = logp.T
        return sums.T

    def _warm(self, d: str, data: np.ndarray, edge: np.ndarray, around: np.ndarray, way: int) -> np.ndarray:
        """The states after the bytes around the windows, from the farthest to the one next to the edge."""
        order = np.argsort(-around, kind="stable")
        state = np.zeros((len(edge), self.hidden), np.float32)
        for q in range(int(around.max(initial=0)), 0, -1):
            m = int(np.searchsorted(-around[order], -q, "right"))
            state[:m] = self._advance(d, state[:m], data[edge[order[:m]] + way * q])
        out = np.empty_like(state)
        out[order] = state
        return out


def predict_texts(model: ByteGRU, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; null, empty and letterless ones are `und` with score 0."""
    n, k = len(texts), len(model.langs)
    langs, scores = ["und"] * n, np.zeros(n)
    data, offsets = text_bytes(texts)
    for a, b in runs(offsets, 2 << 20) if k else ():
        rows = np.array([a + i for i, t in enumerate(texts.slice(a, b - a).to_pylist()) if t and any(map(str.isalpha, t))], np.int64)
        if not len(rows):
            continue
        size = offsets[rows + 1] - offsets[rows]
        mean = model.pooled(data, offsets[rows], offsets[rows + 1]) / size[:, None]
        p = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(size, 40)[:, None] ** 0.5)
        p /= p.sum(1, keepdims=True)
        for r, best, own in zip(rows.tolist(), p.argmax(1).tolist(), p, strict=True):
            langs[r], scores[r] = model.langs[best], own[best]
    return langs, np.clip(scores, 0.0, 1.0)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, sample: int = 1200, chars: int = 240, most: int = 500, hidden: int = 8, rounds: int = 250) -> ByteGRU:
    """Trains on documents with a language outside the held-out fold.

    sample: bound on the documents of each language, those of smallest hash of id and text; of each, one stretch of at most
    `chars` characters at a place in the whole text that the hash gives. most: bound on the languages; more raise
    ValueError. So the driver gets sample * chars * languages characters at most. Without any such document there are no
    languages and every prediction is `und`.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    rows = rows.where((bucket("id", folds) != held_out) & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("id", "text"))
    if rows.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages")
    # first which documents, by hashes alone; then only their stretches come to the driver
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = rows.where(F.length("text") > 0).select("lang", "h", "id").withColumn("r", rank).where(F.col("r") <= sample).select("lang", "h", "id").distinct()
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    found = rows.join(F.broadcast(chosen), ["lang", "h", "id"], "left_semi").select("lang", "h", "id", F.substring("text", at, F.lit(chars)).alias("part")).toPandas().sort_values(["lang", "h", "id", "part"])
    langs = sorted(set(found["lang"]))
    number = {lang: k for k, lang in enumerate(langs)}
    return ByteGRU(langs, hidden).fit([t.encode() for t in found["part"]], np.array([number[x] for x in found["lang"]], np.int64), rounds)


def predict_languages(docs: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred (a learned language, or `und`), score double.

    Null texts and texts without a letter are `und` with score 0. Only the text is an input. Ids may be null or repeat;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_texts(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
