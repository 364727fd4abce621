"""Periodic runs, SimHash anchors and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from subweave.llm import simhash_anchors as sa
from subweave.llm.periodic_runs import SquareCatcher, periodic_runs
from subweave.llm.queries import with_planted_periods
from subweave.llm.vector_codes import hilbert_keys, nearest, short_lists, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, exponent):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            u = t
            while u + q < n and w[u] == w[u + q]:
                u += 1
            if u > t and u - t >= (exponent - 1) * q:
                out.setdefault((t, u + q), q)
            t = max(u, t + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 2.5, 4])
def test_catcher_finds_every_run_however_words_are_appended(exponent):
    r = random.Random(exponent)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(70))]
        if w and r.random() < 0.5:
            s, p = r.randrange(len(w)), r.randrange(1, 15)
            w = [*w[:s], *(w[min(s + i % p, len(w) - 1)] for i in range(len(w) - s))]
        catcher, at = SquareCatcher(exponent), 0
        while at < len(w):
            step = r.randrange(1, 12)
            catcher.append(np.array(w[at : at + step]))
            at += step
            if r.random() < 0.1:
                assert catcher.runs() == plain_runs(w[:at], exponent)
        assert catcher.runs() == plain_runs(w, exponent), w


def test_catcher_on_long_texts():
    base = np.random.default_rng(1).integers(0, 40, 9000)
    for w, runs in ((np.zeros(60_000, int), [(0, 60_000, 1)]), (np.tile(base, 7)[:60_000], [(0, 60_000, 9000)]), (np.arange(60_000), [])):
        catcher = SquareCatcher(4, longest=60_000)
        for at in range(0, len(w), 7001):
            catcher.append(w[at : at + 7001])
        found = catcher.runs()
        assert [x for x in found if x[1] > 1000] == runs
    with pytest.raises(ValueError):
        SquareCatcher(1.5)


def texts_with_repeats():
    r = random.Random(9)
    out = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "A a A a A a A a", "x y " * 6, "same line here\n" * 40, "w " * 3000, "z" * 50_000]
    for _ in range(60):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(200))]
        p, at = r.randrange(1, 9), r.randrange(len(w) + 1)
        out.append(" ".join(w[:at] + (w[at : at + p] or ["q"]) * r.randrange(9) + w[at:]))
    return out + ["a a a a a a"]


def table(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "b b b b b b c", "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, runs int").repartition(3)


def test_periodic_runs(spark):
    docs = table(spark, texts_with_repeats())
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert len(out) == len(texts)
    for k, text in texts.items():
        w = WORD.findall(text or "")
        runs = [x for x in plain_runs(w, 4) if x[1] >= 6]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in out[k].runs] == runs and out[k].n_words == len(w)
        assert out[k].collapsed == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_op11_over_planted_periods(spark):
    from subweave.llm.queries import op11_periodic_runs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    planted = {r.doc_id: r.text for r in with_planted_periods(docs.union(docs.limit(1).selectExpr("20L", "cast(null as string)", "lang", "source", "n_chars"))).where("doc_id <> 20 or text is not null").collect()}
    out = {r.doc_id: r for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    changed = 0
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            changed += 1
        assert WORD.findall(planted[r.doc_id] or "") == w
        runs = [x for x in plain_runs(w[:4000], 4) if x[1] >= 6] if n <= 4000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        got = out[r.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *(best or (None,) * 3))
        assert got.exponent_milli == (best and 1000 * best[1] // best[2])
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()
    assert changed > 5


def plain_fingerprint(text, shingle=3):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    pieces = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = np.array(sorted(set(fps)), np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ f) <= distance) + k + 1:
            parent[root(int(distinct[j]))] = root(int(f))
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[root(f)] = min(i, least.get(root(f), i))
    return [least[root(f)] for f in fps]


def test_codes_cover():
    words = sa.golay_words()
    assert len(words) == 4096 and np.bitwise_count(words[1:]).min() == 7
    r = np.random.default_rng(4)
    for level, (_, bits, radius, code) in enumerate(sa.LEVELS):
        part = r.integers(0, 1 << bits, 500)
        home = sa._homes(level)
        assert (home >= 0).all() and np.bitwise_count(part ^ code()[home[part]]).max() <= radius
        left = r.integers(0, 4, 500).astype(np.int32)
        rows, anchors, rest = sa.replicas(level, part, left)
        apart = np.maximum(0, np.bitwise_count(part[:, None] ^ code()).astype(int) - radius)
        i, j = np.nonzero(apart <= left[:, None])
        assert sorted(zip(rows.tolist(), anchors.tolist(), rest.tolist(), strict=True)) == list(zip(i.tolist(), j.tolist(), (left[i] - apart[i, j]).tolist(), strict=True))


@pytest.mark.parametrize(("distance", "most"), [(3, 4096), (3, 20), (1, 5), (5, 300), (0, 4096)])
def test_links_connect_what_all_pairs_connect(spark, distance, most):
    r = np.random.default_rng(distance + most)
    centres = r.integers(0, 2**64, 12, dtype=np.uint64)
    fps = list(map(int, centres)) + [0, 2**64 - 1]
    for _ in range(500):
        f = int(centres[r.integers(12)]) if r.random() < 0.6 else fps[r.integers(len(fps))]
        for b in r.integers(0, 64, r.integers(0, 2 * distance + 2)):
            f ^= 1 << int(b)
        fps.append(f)
    fps += [int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(30)]  # many at one anchor
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    links = sa.linked_fingerprints(df, distance, most).collect()
    u = lambda x: int(np.int64(x).view(np.uint64))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert a != b and u(a) in parent and u(b) in parent
        parent[root(u(a))] = root(u(b))
    want = plain_components(list(range(len(fps))), fps, distance)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(root(f), i)
    assert [least[root(f)] for f in fps] == want
    assert len(set(want)) > 3


def test_simhash_duplicates(spark):
    r = random.Random(2)
    base = [[f"word{r.randrange(500)}" for _ in range(r.randrange(60, 150))] for _ in range(12)]
    texts = [None, "", " ", "One two", "one  TWO", "Ä ä", "x", "long " * 4000]
    for _ in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = "changed"
        texts.append(r.choice([" ", "\n", "\t "]).join(w).title())
    docs = table(spark, texts)
    out = sa.simhash_duplicates(docs).collect()
    assert len(out) == len(texts) + 1
    named = sorted((x for x in out if x.doc_id is not None), key=lambda x: x.doc_id)
    fps = [plain_fingerprint(t) for t in texts]
    assert [x.fingerprint for x in named] == [f"{f:016x}" for f in fps]
    assert [x.component_id for x in named] == plain_components(range(len(texts)), fps, 3)
    assert 10 < len({x.component_id for x in named}) < 150
    assert [(x.fingerprint, x.component_id) for x in out if x.doc_id is None] == [(f"{plain_fingerprint('b b b b b b c'):016x}", None)]
    assert sa.simhash_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sa.linked_fingerprints(spark.createDataFrame([], "fp long"), 9)


def test_hilbert_keys_are_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_short_lists_hold_the_nearest():
    r = np.random.default_rng(6)
    entries = r.integers(-300, 300, (64, 5))
    for _ in range(50):
        x = r.integers(-300, 300, 5) + r.integers(-r.integers(1, 60), 60, (20, 5))
        listed = short_lists(x.min(0)[None], x.max(0)[None], entries)[0]
        assert set(nearest(x, entries)[0]) <= set(np.flatnonzero(listed))
    big = r.integers(-(1 << 25), 1 << 25, (30, 5))
    best, far = nearest(big, big[:7] + 1)
    plain = [[sum((int(a) - int(b) - 1) ** 2 for a, b in zip(x, e, strict=True)) for e in big[:7]] for x in big]
    assert best.tolist() == [p.index(min(p)) for p in plain] and far.tolist() == list(map(min, plain))


def plain_codes(rows, parts, size, rounds):
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, width)
    books = [x[:size, p].copy() for p in range(parts)]
    assign = lambda: [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
    for _ in range(rounds):
        for p, far in enumerate(assign()):
            best = far.argmin(1)
            for e in range(len(books[p])):
                if (best == e).any():
                    books[p][e] = x[best == e, p].sum(0) // (best == e).sum()
    far = assign()
    codes = ["".join(f"{f[k].argmin():02x}" for f in far) for k in range(len(kept))]
    errors = [int(sum(f[k].min() for f in far)) for k in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize(("size", "n"), [(256, 700), (5, 60), (16, 9)])
def test_vector_codes(spark, size, n):
    r = np.random.default_rng(size)
    centres = r.normal(0, 0.4, (6, 12))
    rows = [(int(k), (centres[k % 6] + r.normal(0, 0.02, 12)).round(4).tolist(), [None, 1, 2][k % 3]) for k in r.permutation(n)]
    rows += [(n + 1, [0.25] * 12, 1)] * 40 + [(3, [-0.1] * 12, None), (n + 2, None, 1), (n + 3, [0.1] * 11 + [None], 1), (n + 4, [float("nan")] * 12, 1), (n + 5, [float("inf")] * 12, None), (None, [0.1] * 12, 1)]
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], "vec_id long, embedding array<float>, label int, part string").repartition(5)
    rows32 = [(i, v and [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    out = sorted(tuple(x) for x in vector_codes(df, size=size, block=8).collect())
    assert out == plain_codes(rows32, 4, size, 4)
    short = df.union(spark.createDataFrame([(n + 9, [0.5] * 4, 1, "c"), (n + 10, [], 1, "c")], df.schema))
    assert vector_codes(short, size=size).count() == len(out)
    empty = vector_codes(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes(df, parts=5)
