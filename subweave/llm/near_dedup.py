"""MinHash near-duplicates by an LSH forest.

Every document's MinHash signature is read in several orders ("trees"). Documents whose signatures share the first
values of an order are neighbours there. Where a region of an order is dense, its documents descend to longer common
prefixes until few share one; on the way each is tied to one representative of every region it passes. Candidates are
verified on the full shingle sets: first each document's closest candidate, then only those that would join two
components and what else dense regions hold of several components, so no region is ever expanded into all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.shared import column, components, dropped, written
from subweave.llm.words import mixed, runs, shingle_hashes, shingle_sets, text_bytes, word_hashes

_TIE = np.uint64(0x9E3779B97F4A7C15)


def forest_shape(percent: int) -> tuple[int, int, int]:
    """Number of orders, values from one level of an order to the next, and the most bits in which sketches may differ.

    A pair of just this similarity shares none of the first-level regions with probability 4e-6 at most, and its sketches
    differ in more bits with that of six standard deviations.
    """
    if not 40 <= percent <= 100:
        raise ValueError("percent must be from 40 to 100")
    same = min(percent, 99) / 100
    step = 4 if percent >= 75 else 2
    trees = int(np.ceil(np.log(4e-6) / np.log(1 - same**step)))
    n, apart = trees * step, 1 - same
    return trees, step, int(n * apart + 6 * (n * (1.5 * apart - apart * apart)) ** 0.5)


def _fingerprints(shingle: int, trees: int, step: int):
    values = trees * step
    factors = np.random.default_rng(77).integers(1, 2**63, values, dtype=np.uint64) | np.uint64(1)
    weights = np.random.default_rng(78).integers(1, 2**63, (trees, step), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            count, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            least = np.zeros((values, n), np.uint32)
            for lo, hi in runs(offsets):
                own = offsets[lo : hi + 1]
                words, first = word_hashes(data[own[0] : own[-1]], own - own[0])
                x, bounds = shingle_hashes(words, first, shingle)
                rows = np.flatnonzero(np.diff(bounds)) + lo
                if not len(rows):
                    continue
                at = bounds[rows - lo]
                for i, f in enumerate(factors):
                    least[i, rows] = np.minimum.reduceat((x * f).view(np.uint32)[1::2], at)
                for r in rows:
                    own_set = np.unique(x[bounds[r - lo] : bounds[r - lo + 1]])
                    count[r], k1[r], k2[r] = len(own_set), own_set.sum(dtype=np.uint64), mixed(own_set ^ _TIE).sum(dtype=np.uint64)
            labels = mixed((least.reshape(trees, step, n) * weights[:, :, None]).sum(1, dtype=np.uint64)).T
            bits = np.concatenate([least & 1, (least >> 1) & 1]).astype(np.uint8).T  # 2 x values bits
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
            sketch = np.packbits(np.ascontiguousarray(bits), axis=1).view(np.int64) if n else np.zeros((0, bits.shape[1] // 64), np.int64)
            low = np.ascontiguousarray((least & 0xFF).astype(np.uint8).T)
            longs = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), np.ascontiguousarray(m).reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), longs(labels), longs(sketch), pa.array([x.tobytes() for x in low], pa.binary())],
                names=["id", "n", "k1", "k2", "labels", "sketch", "values"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for r, own in shingle_sets(batch.column(1), shingle):
                ids.append(r)
                sets.append(own.tobytes())
                if sum(map(len, sets[-64:])) > 1 << 22 or len(sets) >= 2000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sets, pa.binary())], names=["id", "members"])
                    ids, sets = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sets, pa.binary())], names=["id", "members"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: id, text of every node."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(texts.join(ends, "id", "left_semi").mapInArrow(_sets(shingle), "id long, members binary"), "sets")
    found = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_confirmed(percent), "a long, b long")
    )
    found = written(found, "links")
    dropped(sets)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, few: int = 12, levels: int = 3) -> DataFrame:
    """Groups of documents with near-equal sets of word shingles.

    docs: an integer id and a text column; other columns are ignored, whatever their names. Words are runs of bytes
    other than ASCII white space, with A-Z lower-cased. A document's set holds its distinct shingles of `shingle` words;
    with fewer words, the whole sequence as one. Two documents are linked if 100 * shared >= percent * union, counted on
    the 64-bit hashes of all their shingles. percent: 40 to 100; the forest's shape follows from it.
    few: regions of at most so many documents yield all their pairs; denser ones descend, `levels` times at most.

    Returns one row per input row: id, n_shingles long, component_id long (smallest id reachable, itself included), kept boolean
    (id = component_id). Null and empty texts and texts without words have n_shingles 0 and are linked with nothing.
    Equal sets are one class, however many rows hold them. A row with a null id has a null component and is kept.
    Repeated ids: each row follows its own text. An empty table gives an empty result.
    """
    trees, step, limit = forest_shape(percent)
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    rows = written(texts.mapInArrow(_fingerprints(shingle, trees, step), "id long, n long, k1 long, k2 long, labels array<long>, sketch array<long>, values binary"), "fingerprints")
    usable = rows.where("n > 0 and id is not null")
    classes = written(usable.groupBy("k1", "k2").agg(F.min("id").alias("id")), "classes")
    nodes = written(usable.join(classes, ["k1", "k2", "id"], "left_semi").dropDuplicates(["id", "k1", "k2"]).select("id", "n", "labels", "sketch", "values"), "nodes")

    # candidates, level by level
    members = nodes.select("id", F.posexplode("labels").alias("tree", "label"))
    found, dense, spent = [], None, [nodes]
    for level in range(levels):
        counts = members.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("id", F.lit(level)).alias("h"), "id")).alias("rep")).where("c > 1")
        shared = written(members.join(counts, "label").select("label", "tree", "id", "c", F.col("rep.id").alias("rep")), "regions")
        spent.append(shared)
        ids = shared.where(F.col("c") <= few).groupBy("label").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        pairs = F.expr("flatten(transform(ids, x -> transform(filter(ids, y -> y > x), y -> struct(x as a, y as b))))")
        found.append(ids.select(F.explode(pairs).alias("p")).select("p.a", "p.b"))
        large = shared.where(F.col("c") > few)
        found.append(large.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")))
        if level == 0:
            dense = large.select("label", "id")
        if level == levels - 1 or large.isEmpty():
            break
        # the next values of the same order make the common prefix longer
        turned = F.concat("values", "values")
        more = F.expr(f"substring(turned, tree * {step} + {step * (level + 1)} + 1, {step})")
        members = large.join(nodes.select("id", turned.alias("turned")), "id").select("id", "tree", F.xxhash64("label", more).alias("label"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    candidates = written(every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")), "candidates")

    # each document's closest candidate first
    ends = candidates.select(F.col("a").alias("x"), F.col("b").alias("y"), "met").union(candidates.select("b", "a", "met"))
    closest = ends.groupBy("x").agg(F.max(F.struct("met", (-F.col("y")).alias("y"))).alias("m")).select(F.least("x", -F.col("m.y")).alias("a"), F.greatest("x", -F.col("m.y")).alias("b")).distinct()
    closest = written(closest, "closest")
    node_texts = texts.where("id is not null").join(nodes.select("id"), "id", "left_semi")
    links = _verified(closest, node_texts, shingle, percent)
    joined = written(components(links), "components")

    # then what would join two components
    sketches = nodes.select("id", "sketch")
    words = (trees * step * 2 + 63) // 64
    apart = "+".join(f"bit_count(xs[{k}] ^ ys[{k}])" for k in range(words)) + f" <= {limit}"
    left = candidates.select("a", "b").join(closest, ["a", "b"], "left_anti")
    left = written(_across(left, joined).join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("xs")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("ys")), "b").where(apart).select("a", "b"), "left")
    # and what dense regions hold of several components, block against block
    rest = _between_components(dense, joined, nodes.select("id", "n"), node_texts, shingle, percent, spent)
    more = [rest] if left.isEmpty() else [_verified(left, node_texts, shingle, percent), rest]
    spent += [candidates, closest, links, left, *more[:-1]]
    if any(not m.isEmpty() for m in more):
        spent.append(joined)
        joined = written(components(functools.reduce(DataFrame.union, [links, *more])), "components")
    dropped(*spent)

    component = classes.join(joined, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    row = rows.select("id", "n", "k1", "k2")
    out = row.where("n > 0 and id is not null").join(component, ["k1", "k2"]).select("id", "n", "component")
    out = out.union(row.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    out = pairs.join(joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(joined.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _between_components(dense: DataFrame, joined: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, percent: int, spent: list[DataFrame], block: int = 512) -> DataFrame:
    """Links (a, b) between the components of dense regions, each named by its smallest id.

    Regions that overlap make up a cluster. Its documents are cut into blocks of much the same set size: a component of at
    least `block` documents into its own, all others together. First each block of several components is compared with
    itself and what links is contracted, then every block with the blocks of sizes that can be similar enough, one such
    pair in a task; blocks of one and the same component are passed over. A task yields a spanning forest of its
    components, so at most as many links as it has components. What is written on the way goes to spent.
    """
    placed = dense.join(joined, "id", "left").select("label", "id", F.coalesce("component", "id").alias("component"))
    mixed_regions = placed.groupBy("label").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("label", "lo")
    placed = written(placed.join(mixed_regions, "label").select("id", "component", "lo").distinct(), "mixed")
    spent.append(placed)
    if placed.isEmpty():
        return placed.select(F.col("id").alias("a"), F.col("id").alias("b"))
    # components that share a region, rather than documents, so a large component is one end of few links
    cluster = components(placed.select(F.col("component").alias("a"), F.col("lo").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    docs = placed.select("id", "component").distinct()
    own = docs.groupBy("component").agg(F.count(F.lit(1)).alias("c")).select("component", F.when(F.col("c") >= block, F.col("component").cast("string")).otherwise("").alias("own"))
    step = 1.1
    width = F.floor(F.log("n") / F.log(F.lit(step))).cast("int")
    sized = written(docs.join(cluster.join(own, "component"), "component").join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id").withColumn("width", width), "inside")
    full = sized.groupBy("cluster", "width", "own").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / 2_000_000)).cast("int").alias("parts"))
    placing = ["cluster", "width", "own", "part"]
    inside = written(sized.join(full, ["cluster", "width", "own"]).select("id", "component", *placing[:3], F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")), "blocks")
    sets = written(texts.join(inside.select("id").distinct(), "id", "left_semi").mapInArrow(_sets(shingle), "id long, members binary"), "sets")

    alone = inside.where("own = ''").join(sets, "id")
    alone = alone.select(*placing, F.lit(-1).alias("side"), "component", "members")
    first = written(alone.groupBy(*placing).applyInArrow(_block_links(percent), "a long, b long"), "links")
    merged = components(first).select(F.col("id").alias("component"), F.col("component").alias("now"))
    spent += [sized, inside, sets, first]
    inside = written(inside.join(merged, "component", "left").select("id", F.coalesce("now", "component").alias("component"), *placing), "blocks")

    blocks = inside.groupBy(*placing).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = blocks.select("cluster", *[F.col(c).alias(f"a_{c}") for c in (*placing[1:], "lo", "hi")])
    right = blocks.select("cluster", *[F.col(c).alias(f"b_{c}") for c in (*placing[1:], "lo", "hi")])
    reach = int(np.ceil(np.log(100 / percent) / np.log(step))) + 1
    order = lambda x: F.struct(*[f"{x}_{c}" for c in placing[1:]])
    near = F.abs(F.col("a_width") - F.col("b_width")) <= reach
    differ = F.least("a_lo", "b_lo") < F.greatest("a_hi", "b_hi")
    pairs = written(left.join(right, "cluster").where(near & differ & (order("a") < order("b"))).drop("a_lo", "a_hi", "b_lo", "b_hi"), "pairs")
    ends = inside.join(sets, "id").select(*placing, "component", "members")
    side = lambda x, k: pairs.join(ends.withColumnsRenamed({c: f"{x}_{c}" for c in placing[1:]}), ["cluster", *[f"{x}_{c}" for c in placing[1:]]]).select(*pairs.columns, F.lit(k).alias("side"), "component", "members")
    second = written(side("a", 0).union(side("b", 1)).groupBy(*pairs.columns).applyInArrow(_block_links(percent), "a long, b long"), "links")
    spent += [inside, pairs, second]
    return first.union(second)


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Of a symmetric matrix of links so many that the same nodes are connected, fewer than there are nodes."""
    free, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        todo = [start] if free[start] else []
        free[start] = False
        while todo:
            k = todo.pop()
            new = np.flatnonzero(linked[k] & free).tolist()
            free[new] = False
            out += [(k, x) for x in new]
            todo += new
    return out


def _shared_counts(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many members each set of one shares with each of two, by products of 0/1 matrices over the members that both sides have."""
    size = np.array([len(x) for x in sets], np.int64)
    shared = np.zeros((len(one), len(two)), np.float32)
    if not len(one) or not len(two):
        return shared
    rows = [np.repeat(np.arange(len(k)), size[k]) for k in (one, two)]
    grams = [np.concatenate([sets[i] for i in k]) for k in (one, two)]
    both = np.intersect1d(*grams)
    at = [np.searchsorted(both, g) for g in grams]
    real = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == g) if len(both) else np.zeros(len(g), bool) for p, g in zip(at, grams, strict=True)]
    at, rows = [p[r] for p, r in zip(at, real, strict=True)], [q[r] for q, r in zip(rows, real, strict=True)]
    order = [np.argsort(p, kind="stable") for p in at]
    at, rows = [p[o] for p, o in zip(at, order, strict=True)], [q[o] for q, o in zip(rows, order, strict=True)]
    for lo in range(0, len(both), 4096):
        parts = []
        for p, q, k in zip(at, rows, (one, two), strict=True):
            x, y = np.searchsorted(p, [lo, lo + 4096])
            held = np.zeros((len(k), min(4096, len(both) - lo)), np.float32)
            held[q[x:y], p[x:y] - lo] = 1
            parts.append(held)
        shared += parts[0] @ parts[1].T
    return shared


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A spanning forest of the components of two blocks (side 0 and 1), or of one with itself (side -1)."""
        side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        size = np.array([len(x) for x in sets], np.int64)
        one, two = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)
        shared = _shared_counts(sets, one, two)
        shared = shared.astype(np.float64)
        linked = 100 * shared >= percent * (size[one][:, None] + size[two][None, :] - shared)
        names, number = np.unique(component, return_inverse=True)
        i, j = np.nonzero(linked)
        between = np.zeros((len(names), len(names)), bool)
        between[number[one][i], number[two][j]] = between[number[two][j], number[one][i]] = True
        found = names[np.array(spanning_forest(between), np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(found.min(1) if len(found) else [], pa.int64()), "b": pa.array(found.max(1) if len(found) else [], pa.int64())})

    return run


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the group's smallest id. Rows with a null id stay; of rows with the same id one stays."""
    keep = near_duplicates(docs, id_col, text_col, **options).where(F.col("kept") & column(id_col).isNotNull()).select(column(id_col).alias(id_col))
    named = docs.where(column(id_col).isNotNull()).join(keep, id_col, "left_semi").dropDuplicates([id_col]).select(*map(column, docs.columns))
    return named.union(docs.where(column(id_col).isNull()))
