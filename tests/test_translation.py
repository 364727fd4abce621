"""Answers with wrong ids, models that fail, jobs that are killed, and every default argument."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from subweave.operators import translate as X
from subweave.operators.pipeline import caption_files
from subweave.params import Params
from subweave.sources.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models run on executors, which don't have this file

CUES = "track_id string, cue_index int, start_ms double, end_ms double, text string"


def cues_of(spark, n, tracks="a"):
    return spark.createDataFrame([(t, k, 1000.0 * k, 1000.0 * k + 900, f"Line {t}{k} is Here") for t in tracks for k in range(n)], CUES)


def items(prompt):
    return re.findall(r"^\[(\d+)\] (.*)$", prompt.split("Lines to work on:")[1].split("\n\nAnswer with")[0], re.M)


def lower(prompts, move=0):
    return [json.dumps([{"id": int(k) + move, "translation": t.lower()} for k, t in items(p)]) for p in prompts]


@pytest.mark.parametrize(
    ("ids", "error"),
    [([3, 4, 5], None), (["3", "4", "5"], None), ([5, 3, 4], None), ([4, 5, 6], "unexpected id"), ([2, 3, 4], "unexpected id"), ([3, 3, 4], "repeated id"), ([3, 4], "count"), ([3, 4, None], "id"), ([3, 4, 4.5], "id"), ([3, 4, 99], "unexpected id")],
)
def test_ids_of_a_batch(spark, ids, error):
    row = [("t", 0, json.dumps([{"id": k, "translation": f"x{k}"} for k in ids]), 3, 3, 6, [3, 4, 5])]
    answers = spark.createDataFrame(row, "track_id string, batch_no int, content string, expected int, start int, end int, ids array<int>")
    for given in (answers, answers.drop("ids"), answers.drop("start", "end")):
        out = X.parse_answers(given).collect()
        assert {r.error for r in out} == {error} and (error or sorted((r.cue_index, r.text) for r in out) == [(k, f"x{k}") for k in (3, 4, 5)])
    assert {r.error for r in X.parse_answers(answers.drop("ids", "start", "end")).collect()} == {None if error == "unexpected id" else error}


def test_of_several_answers_always_the_same_one(spark):
    answers = spark.createDataFrame([("a", 0, x) for x in ("c", "b", "d")], "track_id string, cue_index int, text string").repartition(3)
    assert X.apply_answers(cues_of(spark, 1), answers).first().translated_text == "b"


def test_shifted_ids_put_no_text_on_another_line(spark):
    cues = cues_of(spark, 26)
    for model, want in ((lambda p: lower(p, 1), "Line a{} is Here"), (lambda p: lower(p, 1) if len(items(p[0])) > 1 else lower(p), "line a{} is here")):
        out = X.translate_to_bilingual(cues, "fr", lambda prompts, model=model: [model([p])[0] for p in prompts]).orderBy("cue_index").collect()
        assert [r.translated_text for r in out] == [want.format(k) for k in range(26)]


def test_a_model_that_raises_for_some_prompts(spark):
    def model(prompts):
        if any("a7 " in p.split("Lines to work on:")[1] for p in prompts):
            raise RuntimeError("not this one")
        return lower(prompts)

    out = X.translate_to_bilingual(cues_of(spark, 30, "ab"), "fr", model).collect()
    assert {(r.track_id, r.cue_index) for r in out if r.translated_text == r.source_text} == {("a", 7)} and len(out) == 60
    assert X.answers_of(lambda p: p[:-1] if len(p) > 1 else p, ["x", "y", "z"]) == ["x", "y", "z"]
    assert X.answers_of(lambda p: 1 / 0, ["x", "y"]) == [None, None] and X.answers_of(lambda p: p, []) == []


def test_a_killed_job_asks_nothing_twice(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(prompts):
        import uuid

        for p in prompts:
            (asked / uuid.uuid4().hex).write_text(p)
        # every batch of several lines fails, so that there are rounds to be killed between
        return [a if len(items(p)) == 1 else "[]" for p, a in zip(prompts, lower(prompts), strict=True)]

    cues, ledger, tables = cues_of(spark, 5), X.Ledger(f"file://{tmp_path}/ledger", "m1"), []

    def killed(d):
        tables.append(d)
        if len(tables) == killed.at:
            raise KeyboardInterrupt
        return written(d)

    for killed.at in (4, 9, 10**6):
        tables.clear()
        try:
            out = X.translate_to_bilingual(cues, "fr", model, checkpoint=killed, ledger=ledger).collect()
        except KeyboardInterrupt:
            out = None
        said = [f.read_text() for f in asked.iterdir()]
        assert len(said) == len(set(said)) > 0
    assert sorted(r.translated_text for r in out) == sorted(f"line a{k} is here" for k in range(5))
    n = len(said)
    X.translate_to_bilingual(cues, "fr", model, ledger=ledger).collect()
    assert len(list(asked.iterdir())) == n
    X.translate_to_bilingual(cues, "fr", model, ledger=X.Ledger(ledger.path, "m2")).collect()
    assert len(list(asked.iterdir())) == 2 * n


def test_every_default(spark):
    cues = cues_of(spark, 3)
    assert {r.translated_text for r in X.translate_to_bilingual(cues, "fr", lower).collect()} == {f"line a{k} is here" for k in range(3)}
    upper = lambda ps: [json.dumps([{"id": int(k), "restored": t.upper()} for k, t in items(p)]) for p in ps]
    assert {r.text for r in X.restore_cues(cues, upper).collect()} == {f"LINE A{k} IS HERE" for k in range(3)}
    assert X.guidance(cues, "fr", ["summary"], lambda p: ["s"] * len(p)).collect()[0].summary == "s"
    full = X.translate_to_bilingual(cues, "fr", lower, Params(retries=1), restore_fn=upper, guidance_fn=lambda p: ["g"] * len(p)).collect()
    assert {(r.source_text, r.translated_text) for r in full} == {(f"Line a{k} is Here", f"line a{k} is here") for k in range(3)}
    events = spark.createDataFrame([("a", 0, 0.0, 3000.0, 1, None, [("Hello", 0.0), (" There.", 300.0)])], "track_id string, event_index int, t_start_ms double, d_duration_ms double, w_win_id int, a_append int, segs array<struct<utf8:string,t_offset_ms:double>>")
    assert "hello there." in caption_files(events, "fr", lower).collect()[0].vtt
    assert X.translate_to_bilingual(cues.limit(0), "fr", lower).count() == 0


def test_tasks_grow_with_prompts(spark):
    rows = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("prompt"))
    out = X._asked(rows, {"": lambda p: p}, lambda d: d, per_task=64)
    assert out.rdd.getNumPartitions() == 16 and out.where("content = prompt").count() == 1000


def test_tasks_of_large_jobs_hold_many_calls(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("prompt"))
    out = X._asked(rows, {"": lambda p: p if len(p) <= 64 else []}, lambda d: d)
    assert out.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism and out.where("content = prompt").count() == 20_000


def test_rounds_after_the_first_compute_no_cues_again(spark):
    plans = []

    def keep(d):
        plans.append(d._jdf.queryExecution().optimizedPlan().toString())
        return written(d)

    broken = lambda prompts: ["no array" if len(items(p)) > 1 else lower([p])[0] for p in prompts]
    out = X.translate_to_bilingual(cues_of(spark, 7).repartition(2), "fr", broken, checkpoint=keep)
    assert [r.translated_text for r in out.orderBy("cue_index").collect()] == [f"line a{k} is here" for k in range(7)]
    assert len(plans) > 4 and not any("Join" in p or "Aggregate" in p for p in plans[1:])


@pytest.mark.parametrize(("items", "chars", "before", "after"), [(12, 900, 2, 1), (3, 40, 2, 1), (1, 900, 3, 3), (4, 30, 0, 0), (2, 15, 5, 4)])
def test_batches_with_context_in_one_pass(spark, items, chars, before, after):
    import random

    r = random.Random(items * chars)
    rows = [(t, k, 0.0, 1.0, r.choice(["", "a", "some words", "a longer line of words"])) for t in ("a", "b", "c") for k in range(r.randrange(1, 30))]
    cues = spark.createDataFrame(rows, CUES).repartition(3)
    want = X.context_lines(cues, X.plan_batches(cues, items, chars), before, after)
    got = X.batches_with_context(cues, items, chars, before, after)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert X.batches_with_context(cues.limit(0)).count() == 0
