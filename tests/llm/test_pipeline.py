"""The five stages, each on its own input, against plain versions; and the schemas of the numbered queries."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subweave.llm import byte_bpe, decontaminate, queries
from subweave.llm.quality_crf import fit_quality, quality_scores
from subweave.llm.words import shingle_hashes

SRC = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SRC), reason="no test data")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """For each stage its input's rows and its output's."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SRC}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SRC).write.parquet(str(folder / name))
        new = spark.read.parquet(str(folder / name))
        if name != "byte_bpe":
            assert new.columns == docs.columns
        out[name] = docs.collect(), new.collect(), docs
        docs = new
    return out


def test_quality_keeps_what_the_model_accepts(spark, stages):
    before, after, docs = stages["quality"]
    labels = spark.read.parquet(f"{SRC}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality_scores(docs, fit_quality(docs, labels), threshold=0.3).collect()}
    assert {r.doc_id for r in after} == {k for k, p in scores.items() if p}
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    kept = {r.doc_id for r in after}
    held = {r.doc_id for r in before}
    right = [(k in kept) == bool(q) for k, q in known.items() if k in held]
    assert np.mean(right) > 0.97


def test_near_duplicates_of_the_stage(stages):
    before, after, _ = stages["near_dedup"]
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in before}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for k, w in words.items() if w}
    group = {k: k for k in words}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert {r.doc_id for r in after} == set(group.values())


def test_contaminated_documents_of_the_stage(spark, stages):
    before, after, _ = stages["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{SRC}/benchmark.parquet").collect()]
    words, first = decontaminate._words(items)
    grams = [shingle_hashes(words[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]), 5)[0] for k in range(len(items))]
    held = Counter(g for own in grams for g in set(own.tolist()))
    weight = lambda g: round(65536 / (1 + np.log(max(held.get(g, 1), 1))))
    bags = [Counter(g.tolist()) for g in grams]
    bad = set()
    for r in before:
        w, _ = decontaminate._words([r.text or ""])
        if len(w) < 5:
            continue
        own = shingle_hashes(w, np.array([0, len(w)]), 5)[0].tolist()
        for bag, g in zip(bags, grams, strict=True):
            where = [i for i, x in enumerate(own) if x in bag]
            starts = {min(max(i - k, 0), max(len(own) - len(g), 0)) for i in where for k in range(len(g))}
            for s in starts:
                part = Counter(own[s : s + len(g)])
                if sum(weight(x) * c for x, c in (part & bag).items()) >= 0.8 * sum(weight(x) * c for x, c in (part | bag).items()) - 1e-6:
                    bad.add(r.doc_id)
                    break
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad


def test_pseudonyms_of_the_stage(stages):
    before, after, _ = stages["pseudonyms"]
    old, new = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
    assert old.keys() == new.keys() and all(new[k].n_chars == len(new[k].text) and new[k].lang == old[k].lang for k in new)
    secret = re.compile(r"[0-9]|@|(?i:token|secret|key|passw)")
    assert all(new[k].text == old[k].text for k in new if not secret.search(old[k].text))
    left = re.compile(r"[\w.]+@mail\d+\.example\.com")
    assert not any(left.search(r.text) for r in after)


def test_tokens_of_the_stage(stages):
    import tiktoken

    before, after, _ = stages["byte_bpe"]
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.token_bytes(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before)
    for r in before:
        ids = e.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SRC}/documents.parquet")
    odd = docs.limit(30).withColumn("text", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("text")))
    odd = odd.union(odd).union(docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SRC).count() == 0, name
        stage(spark, odd, SRC).collect()


CONTRACTS = {
    "op1_graph_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op5_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_pseudonyms": {"doc_id": "bigint", "text": "string"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_schema_and_rows_of_each_query(spark, name):
    out = queries.QUERIES[name](spark, SRC)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert CONTRACTS[name].items() <= kinds.items()
    if name in ("op2_token_files", "op3_byte_bpe", "op6_quality", "op8_pseudonyms", "op9_language", "op10_near_dedup"):
        docs = spark.read.parquet(f"{SRC}/documents.parquet")
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        if "held_out" in kinds:
            folds, fold = (5, 0) if name == "op6_quality" else (3, 1)
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    elif name == "op1_graph_search":
        rows = out.collect()
        assert rows and all(r.query_id % 50 == 0 and r.vec_id != r.query_id and 1 <= r["rank"] <= 5 for r in rows)
    else:
        assert out.count() > 0
