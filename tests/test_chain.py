"""Tracks without rows, repaired lines and guidance, and the whole chain."""

import json
import re
import sys

from pyspark import cloudpickle

from subweave.operators import segments, translate
from subweave.operators.pipeline import caption_files
from subweave.params import Params
from subweave.sources.timedtext import parse_webvtt

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models run on executors, which don't have this file

CUES = "track_id string, cue_index int, start_ms double, end_ms double, text string"
EVENTS = "track_id string, event_index int, t_start_ms double, d_duration_ms double, w_win_id int, a_append int, segs array<struct<utf8:string,t_offset_ms:double>>"


def _items(prompt):
    return re.findall(r"^\[(\d+)\] (.*)$", prompt.split("Lines to work on:")[1].split("\n\nAnswer with")[0], re.M)


def lower(prompts):
    return [json.dumps([{"id": int(k), "translation": t.lower()} for k, t in _items(p)]) for p in prompts]


def upper(prompts):
    return [json.dumps([{"id": int(k), "restored": t.upper()} for k, t in _items(p)]) for p in prompts]


def test_tracks_without_rows_go_through_their_cues(spark):
    events = spark.createDataFrame([("a", 0, 0.0, 3000.0, 1, None, [("Hello", 0.0), (" world.", 300.0)]), ("b", 0, 0.0, 3000.0, 1, 1, [("\n", 0.0)])], EVENTS)
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:00:00.000 --> 00:00:02.000 align:left\nI have a\n\n00:02.000 --> 00:04.000\ndream today.\n\n00:09.000 --> 00:12.000\nNext line here"
    cues = parse_webvtt(spark.createDataFrame([("b", vtt), ("a", vtt)], "track_id string, payload string"))
    assert [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in cues.where("track_id = 'b'").orderBy("cue_index").collect()] == [(0, 0.0, 2000.0, "I have a"), (1, 2000.0, 4000.0, "dream today."), (2, 9000.0, 12000.0, "Next line here")]
    out = {}
    for r in segments.build_source_segments(events, timing=False, cues=cues).orderBy("track_id", "cue_index").collect():
        out.setdefault(r.track_id, []).append(r.text)
    assert out["a"] == ["Hello world."]
    want = segments.optimize_source_cues(segments.merge_cues(cues.where("track_id = 'b'"))).orderBy("cue_index").collect()
    assert out["b"] == [r.text for r in want] and " ".join(out["b"]) == "I have a dream today. Next line here"
    kept = segments.build_source_segments(events, timing=False, cues=cues, keep_timing=True)
    assert " ".join(r.text for r in kept.where("track_id = 'b'").orderBy("cue_index").collect()) == "I have a dream today. Next line here"


def test_restored_lines_are_translated_and_paired_with_the_lines_as_they_were(spark):
    cues = spark.createDataFrame([("t", k, 1000.0 * k, 1000.0 * k + 900, f"Line number {k} is Here") for k in range(5)], CUES)

    def model(prompts):
        assert all("LINE NUMBER" in p for p in prompts)
        return lower(prompts)

    out = translate.translate_to_bilingual(cues, "fr", model, checkpoint=lambda d: d.cache(), restore_fn=upper)
    rows = out.orderBy("cue_index").collect()
    assert [(r.source_text, r.translated_text) for r in rows] == [(f"Line number {k} is Here", f"line number {k} is here") for k in range(5)]
    broken = translate.restore_cues(cues, lambda p: ["no array"] * len(p), checkpoint=lambda d: d.cache())
    assert [r.text for r in broken.orderBy("cue_index").collect()] == [f"Line number {k} is Here" for k in range(5)]


def test_guidance_reaches_the_prompts_and_may_fail(spark):
    cues = spark.createDataFrame([(t, k, 1000.0 * k, 1000.0 * k + 900, f"Line {k}") for t in "ab" for k in range(3)], CUES)

    def advice(prompts):
        if any(p.startswith("Summarise") for p in prompts):
            raise RuntimeError("no summary")
        return ["GLOSSED" for _ in prompts]

    got = translate.guidance(cues, "fr", ["summary", "glossary"], advice, checkpoint=lambda d: d.cache()).orderBy("track_id").collect()
    assert [(r.track_id, r.summary, r.glossary) for r in got] == [("a", None, "GLOSSED"), ("b", None, "GLOSSED")]

    def model(prompts):
        assert all("Glossary:\nGLOSSED" in p and "Summary:" not in p for p in prompts)
        return lower(prompts)

    out = translate.translate_to_bilingual(cues, "fr", model, checkpoint=lambda d: d.cache(), guidance_fn=advice)
    assert {r.translated_text for r in out.collect()} == {"line 0", "line 1", "line 2"}


def test_whole_chain(spark):
    line = lambda k, text: ("a", k, 4000.0 * k, 3000.0, 1, None, [(w if i == 0 else " " + w, 300.0 * i) for i, w in enumerate(text.split())])
    events = spark.createDataFrame([line(0, "The first sentence is a rather long one for a test."), line(1, "The second sentence follows it at once and ends.")], EVENTS)
    out = caption_files(events, "fr", lower, checkpoint=lambda d: d.cache()).collect()
    assert [r.track_id for r in out] == ["a"] and out[0].vtt.startswith("WEBVTT\nKind: captions\nLanguage: fr")
    said = " ".join(r.text for r in parse_webvtt(spark.createDataFrame([("a", out[0].vtt)], "track_id string, payload string")).orderBy("cue_index").collect())
    assert "the first sentence" in said.replace("\n", " ") and "ends." in said
    both = caption_files(events, "fr", lower, Params(mode="bilingual"), checkpoint=lambda d: d.cache()).collect()
    assert "The first" in both[0].vtt and "the first" in both[0].vtt
