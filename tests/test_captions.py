"""Sources, sinks, timing, translation, jobs and streams on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from subweave.functions import text as T
from subweave.operators import folds, jobs, segments, timing, translate
from subweave.params import Params
from subweave.sources import sinks, timedtext
from subweave.streaming import requests as streams

CUE = "track_id string, cue_index int, start_ms double, end_ms double, text string"


def cues(spark, rows):
    return spark.createDataFrame([("t", k, float(a), float(b), t) for k, (a, b, t) in enumerate(rows)], CUE)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("track_id", "cue_index").collect()]


def test_json_document_to_atoms_and_rows(spark):
    doc = {"events": [{"tStartMs": 0, "dDurationMs": 3000, "wWinId": 1, "segs": [{"utf8": "Hello"}, {"utf8": " world", "tOffsetMs": 300}, {"utf8": ".", "tOffsetMs": 600}]}, {"tStartMs": 3000, "dDurationMs": 10, "wWinId": 1, "aAppend": 1, "segs": [{"utf8": "\n"}]}, {"tStartMs": 3010, "dDurationMs": 3000, "wWinId": 1, "segs": [{"utf8": "Next"}, {"utf8": " sentence", "tOffsetMs": 300}]}, {"tStartMs": 6010, "dDurationMs": 10, "wWinId": 1, "aAppend": 1, "segs": [{"utf8": "\n"}]}]}
    raw = spark.createDataFrame([("t", json.dumps(doc)), ("bad", "{}"), ("worse", "no json"), ("none", None)], "track_id string, payload string")
    events = timedtext.read_timedtext_json(raw)
    assert {r.track_id for r in timedtext.rejected_json(raw).collect()} == {"bad", "worse", "none"}
    assert timedtext.scrolling_tracks(events).first().scrolling is True
    assert rows(timing.scrolling_rows(events), "start_ms", "end_ms", "text") == [(0.0, 3010.0, "Hello world."), (3010.0, 6020.0, "Next sentence")]
    assert rows(segments.assemble_scrolling_cues(events), "start_ms", "end_ms", "text") == [(0.0, 3010.0, "Hello world."), (3010.0, 6020.0, "Next sentence")]
    assert segments.build_source_segments(events).count() >= 1


def test_webvtt_and_srv3(spark):
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:00:01.500 --> 00:02.250 align:start\nHello\nyou\n\n3.5 --> 4\nbye\n\nno time\n"
    assert rows(timedtext.parse_webvtt(spark.createDataFrame([("t", vtt)], "track_id string, payload string")), "start_ms", "end_ms", "text") == [(1500.0, 2250.0, "Hello\nyou"), (3500.0, 4000.0, "bye")]
    xml = '<p t="0" d="100">a<br/>b &amp;lt; &#65;&#x0a;c</p><p t="x" d="1">no</p><P T="5" D="6"><s>d</s></P>'
    assert rows(timedtext.parse_srv3(spark.createDataFrame([("t", xml)], "track_id string, payload string")), "start_ms", "end_ms", "text") == [(0.0, 100.0, "a\nb < A\nc"), (5.0, 11.0, "d")]


def test_render_and_read_again(spark):
    c = cues(spark, [(1000, 4000, "Hello\n<你好> & 'x'"), (3000, 6200, "World")])
    xml = sinks.render_srv3(c).select("track_id", F.col("xml").alias("payload"))
    assert rows(timedtext.parse_srv3(xml), "start_ms", "end_ms", "text") == [(1000.0, 2900.0, "Hello\n<你好> & 'x'"), (3000.0, 6200.0, "World")]
    doc = json.loads(sinks.render_timedtext_json(c).first().json)
    assert len(doc["events"]) == 3 and doc["events"][0]["dDurationMs"] >= 6200


def test_timing(spark):
    c = cues(spark, [(0, 300, "a"), (2000, 5000, "b"), (4000, 4100, "c")])
    assert rows(timing.optimize_timing(c), "start_ms", "end_ms") == [(0.0, 1000.0), (2000.0, 3900.0), (4000.0, 5000.0)]
    parts = spark.createDataFrame([("t", 0, k, 0.0, 1000.0, w, "x") for k, w in enumerate((1, 1, 8))], "track_id string, cue_index int, part_index int, start_ms double, end_ms double, weight int, text string")
    assert [(r.start_ms, r.end_ms) for r in timing.spread_duration(parts, 400).orderBy("part_index").collect()] == [(0.0, 400.0), (400.0, 800.0), (800.0, 1000.0)]
    assert [r.run_id for r in timing.gap_runs(c, 1000).orderBy("cue_index").collect()] == [0, 1, 1]


def test_python_and_column_predicates_agree(spark):
    samples = ["", "  ", "...", ", so", "go home", "We went to the", "ab-", "(x)", "你好吗", "今天我们去公园玩和", "今天我们去公园玩了很久。", ">> hi   there", "yes, of course we can do that", "A B", "こんにちは、世界のみなさん", "x " * 50]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(samples)], "k int, text string")
    t = F.col("text")
    got = d.select("k", T.is_dangling(t).alias("a"), T.is_dangling(t, False).alias("b"), T.text_length(t).alias("n"), T.normalize_cue(t).alias("c"), T.normalize_merged(t).alias("m")).orderBy("k").collect()
    for r, s in zip(got, samples, strict=True):
        assert (r.a, r.b, r.n, r.c, r.m) == (folds.dangling(s), folds.dangling(s, False), folds.size(s), folds.cue_text(s), folds.merged_text(s)), s


def test_hash_is_of_utf16_units(spark):
    d = spark.createDataFrame([("hello",), ("",), ("😀a",)], "s string").select(T.source_hash(F.col("s")).alias("h"))
    assert [int(r.h, 36) for r in d.collect()][:2] == [99162322, 0]
    units = [0xD83D, 0xDE00, 97]
    h = 0
    for u in units:
        h = (h * 31 + u) % 2**32
    assert int(d.collect()[2].h, 36) == (2**32 - h if h >= 2**31 else h)


def test_batches_and_answers(spark):
    c = cues(spark, [(0, 1, "x" * 120), (1, 2, "y" * 120), (2, 3, "z" * 120)])
    b = translate.plan_batches(c, 24, 288)
    assert [(r.start, r.end) for r in b.orderBy("batch_no").collect()] == [(0, 2), (2, 3)]
    ctx = translate.context_lines(c, b, 1, 1).orderBy("batch_no").collect()
    assert [x["index"] for x in ctx[0].following] == [2] and [x["index"] for x in ctx[1].preceding] == [1]
    a = spark.createDataFrame([("t", 0, '```json\n[{"id":0,"translation":"A"},{"id":"1","text":" B "}]\n```', 2), ("t", 1, '[{"id":2}]', 1), ("t", 2, "sorry", 1), ("t", 3, "[]", 1), ("t", 4, None, 1)], "track_id string, batch_no int, content string, expected int")
    p = translate.parse_answers(a)
    assert {(r.batch_no, r.cue_index, r.text, r.error) for r in p.collect()} == {(0, 0, "A", None), (0, 1, "B", None), (1, None, None, "text"), (2, None, None, "no array"), (3, None, None, "count"), (4, None, None, "no array")}
    assert rows(translate.apply_answers(c, p), "translated_text")[:2] == [("A",), ("B",)]
    assert translate.audit_answers(c, p).collect()[0].problem == "missing"


def test_translation_rounds(spark, tmp_path):
    c = cues(spark, [(k, k + 1, f"line number {k} of the talk") for k in range(5)])

    def model(prompts):
        import json as j
        import re as r

        out = []
        for p in prompts:
            lines = r.findall(r"^\[(\d+)\] (.*)$", p.split("Lines to work on:")[1], r.M)
            items = [{"id": int(i), "translation": "..." if i == "3" and len(lines) > 1 else t.upper()} for i, t in lines]
            out.append(j.dumps(items[:-1] if len(lines) > 3 else items))  # too long batches lose a line
        return out

    kept = []

    def keep(df):
        kept.append(str(tmp_path / str(len(kept))))
        df.write.parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    got = translate.translate_to_bilingual(c, "fr", model, checkpoint=keep)
    assert [r.translated_text for r in got.orderBy("cue_index").collect()] == [f"LINE NUMBER {k} OF THE TALK" for k in range(5)]


@pytest.mark.parametrize("bare", [False, True])
def test_single_lines_are_asked_again(spark, tmp_path, bare):
    # one-cue tracks: a model that fails on the first prompt of "no answer", and is suspicious on "dots" unless asked strictly
    c = spark.createDataFrame([("a", 0, 0.0, 1.0, "no answer at first"), ("b", 0, 0.0, 1.0, "dots at first")], CUE)

    def said(text, strict, count):
        return ("" if count == 1 else text.upper()) if text.startswith("no") else text.upper() if strict else "..."

    def count(text):
        with open(tmp_path / text.split()[0], "a+") as f:
            f.write("x")
            return f.tell()

    def model(prompts):
        import json as j
        import re as r

        lines = [r.findall(r"^\[(\d+)\] (.*)$", p.split("Lines to work on:")[1], r.M)[0] for p in prompts]
        return [j.dumps([{"id": int(i), "translation": said(t, "Leave nothing out" in p, count(t))}]) for p, (i, t) in zip(prompts, lines, strict=True)]

    def line_model(prompts):
        return [said(p.split("Text: ")[1], "Leave nothing out" in p, count(p.split("Text: ")[1])) for p in prompts]

    kept = []

    def keep(df):
        kept.append(str(tmp_path / f"kept{len(kept)}"))
        df.write.parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    got = translate.translate_to_bilingual(c, "fr", model, params=Params(retries=1), checkpoint=keep, line_fn=line_model if bare else None)
    assert [r.translated_text for r in got.orderBy("track_id").collect()] == ["NO ANSWER AT FIRST", "DOTS AT FIRST"]


def test_jobs_upsert_and_lookup(spark):
    from subweave.schemas import JOB

    key = ("v", "en", "zh-CN", "asr", "json3", "h")
    held = spark.createDataFrame([("1", *key, "done", 0, None, None, None, "old", 1, 1, 10)], JOB)
    more = jobs.new_jobs(spark.createDataFrame([key, ("w", *key[1:])], jobs.NATURAL_KEY), 5)
    out = {r.video_id: r for r in jobs.upsert_jobs(held, more, 5).collect()}
    assert (out["v"].id, out["v"].status, out["v"].bilingual_json, out["v"].created_at, out["v"].updated_at) == ("1", "pending", None, 1, 5)
    assert out["w"].status == "pending"
    req = spark.createDataFrame([(1, "v", "en", "zh-CN", "asr", "json3")], "id int, video_id string, lang string, tlang string, track string, fmt string")
    assert jobs.lookup_cached(req, held).first().cache_status == "hit"
    assert jobs.lookup_cached(req, held, True, 11).first().cache_status == "miss"
    assert jobs.cache_hit_rate(jobs.lookup_cached(req, held).limit(0)).first().hit_rate == 0.0
    kept, children = jobs.expire_jobs(held, spark.createDataFrame([("1", "s")], "job_id string, id string"), 11)
    assert kept.count() == 0 and children.count() == 0


def test_daily_counters_drop_late_rows(spark, tmp_path):
    days = [[("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 2), ("2024-01-03 00:00:00", 4), ("2024-01-05 00:00:00", 4)], [("2024-01-01 12:00:00", 100), ("2024-01-09 00:00:00", 1)]]
    for k, batch in enumerate(days):
        df = spark.createDataFrame([(ts, "a", "x", n, 0.5) for ts, n in batch], "ts string, provider string, endpoint string, token_count long, cost_usd double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.windowed_counters(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {str(r.window_start)[:10]: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == 3 and got["2024-01-03"] == 4


def test_streamed_requests_and_sessions(spark, tmp_path):
    r = spark.createDataFrame([("2024-01-01 10:00:00", "h"), ("2024-01-01 10:01:00", "h"), ("2024-01-01 10:02:00", "i")], "ts string, source_hash string").withColumn("ts", F.to_timestamp("ts"))
    r = r.selectExpr("ts", "source_hash", *[f"'{c}' as {c}" for c in ("video_id", "lang", "tlang", "track", "fmt")])
    r.write.parquet(str(tmp_path / "in"))
    once = streams.dedupe_in_flight(spark.readStream.schema(r.schema).parquet(str(tmp_path / "in")))
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.source_hash for x in spark.table("once").collect()) == ["h", "i"]
    c = spark.createDataFrame([("t", "2024-01-01 10:00:00", 1000), ("t", "2024-01-01 10:00:02", 1000), ("t", "2024-01-01 10:00:10", 500)], "track_id string, ts string, duration_ms long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(x.n for x in streams.gap_sessions(c).collect()) == [1, 2]


def test_streams_read_folders_whole(spark, tmp_path):
    from subweave.plans import job_queries

    # files of a folder, out of time order by days; an event on the newest day
    for day in (9, 1, 30):
        e = spark.createDataFrame([(2 * day, f"2024-01-{day:02d} 10:00:00", "view", 1.5), (2 * day + 2, f"2024-01-{day:02d} 11:00:00", "view", 1.5)], "event_id long, ts string, event_type string, value double")
        e.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = job_queries.streaming_daily_counters(spark, str(tmp_path)).orderBy("window_start").collect()
    assert [(datetime.datetime.fromtimestamp(r.window_start, datetime.UTC).day, r.calls, r.tokens) for r in got] == [(1, 2, 30), (9, 2, 30), (30, 2, 30)]
