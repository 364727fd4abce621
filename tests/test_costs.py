"""What the plans of costly steps hold: words stay in their rows, texts are computed once, and few shuffles."""

from pyspark.sql import functions as F

from subweave.functions.text import collapsed, is_suspicious, unless_blank, visible_length, word_count
from subweave.operators import layout, merging, quality, timing, translate

EVENTS = "track_id string, event_index int, t_start_ms double, d_duration_ms double, w_win_id int, a_append int, segs array<struct<utf8:string,t_offset_ms:double>>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_made_without_a_row_for_each_word(spark):
    events = spark.createDataFrame([("a", 0, 0.0, 900.0, 1, None, [("One", 0.0), (" two", 300.0), ("\n", 600.0)]), ("a", 2, 1000.0, 900.0, 1, None, [(" ", 0.0)])], EVENTS)
    rows = timing.scrolling_rows(events)
    assert "posexplode(segs" not in _plan(rows)
    assert [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in rows.collect()] == [(0, 0.0, 900.0, "One two")]


def test_a_text_is_computed_once_where_blank_ones_go(spark):
    d = spark.range(3).select(F.when(F.col("id") == 1, F.lit(" \n ")).when(F.col("id") == 2, F.lit(" a  b ")).alias("raw"))
    out = d.select(unless_blank(collapsed(F.col("raw"))).alias("text"))
    assert [r.text for r in out.collect()] == ["a b"]
    assert sum("regexp_replace(" in line for line in _plan(out).splitlines()) == 1


def test_layout_shuffles_once_for_each_pass_over_a_track(spark):
    b = spark.createDataFrame([("t", 0, 0.0, 9000.0, "a b", "c d")], "track_id string, cue_index int, start_ms double, end_ms double, source_text string, translated_text string")
    plan = layout.prepare_for_render(b, "vtt")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 3
    assert [(r.start_ms, r.end_ms, r.text) for r in layout.prepare_for_render(b, "vtt").collect()] == [(0.0, 9000.0, "c d")]


def test_lines_are_counted_as_they_are_wrapped():
    for t in ["", "one", "a b c d e f g h", "one, two ; three four five six", "字字字字字字字字，字字字 abc 字字", "aé b c d e"]:
        for limit in (1, 2, 3, 20):
            assert layout._rows_in(t, limit) == len(layout.wrap(t, limit)), (t, limit)


def test_failed_batches_are_looked_up_once(spark):
    batches = spark.createDataFrame([("t", 0, 0, 5), ("t", 1, 5, 6), ("t", 2, 6, 9)], "track_id string, batch_no int, start int, end int")
    parsed = spark.createDataFrame([("t", 0, None, None, "count", None), ("t", 1, None, None, "id", None), ("t", 2, 7, "...", None, "a line of some length")], "track_id string, batch_no int, cue_index int, text string, error string, source_text string")
    plan = translate.fallback_plan(batches, parsed, 0)
    assert _plan(plan).count("Join") == 1
    assert sorted(tuple(r) for r in plan.collect()) == [("t", 0, 3, 0, "half"), ("t", 3, 5, 0, "half"), ("t", 5, 6, 0, "line"), ("t", 7, 8, 0, "line")]


ODD = ["a b", " a  b\t", "\u3000x\u00a0y ", "\u6211\u548c", "- -", ",a b", "...", "\u00e9 \u2014 b", "", " ", "one two\u2003three\u2026", "\u266a la", "\u4f60\u597d\u3000\u5440 "]


def test_examples_look_at_a_text_once(spark):
    cues = spark.createDataFrame([("t", k, k * 1000.0, k * 1000.0 + 1000, t) for k, t in enumerate(ODD)], "track_id string, cue_index int, start_ms double, end_ms double, text string")
    out = quality.suspicious_examples(cues, 30)
    assert _plan(out).count("trim(text") == 1
    assert {r.cue_index: (r.reasons, r.preview) for r in out.collect()}[2] == ("short_words", "x y")
    m = quality._measured(cues).select("text", "t", "chars", "words", visible_length(F.col("t")).alias("c"), word_count(F.col("t")).alias("w"), "bare_punctuation", "leading_punctuation", "connector_end").collect()
    assert all((r.chars, r.words) == (r.c, r.w) for r in m)
    assert [(r.bare_punctuation, r.leading_punctuation, r.connector_end) for r in m] == [(i in (4, 6), i in (5, 6), i == 3) for i in range(len(ODD))]


def test_doubtful_answers_of_odd_texts(spark):
    d = spark.createDataFrame([(s, t) for s in ("a line of twenty letters or more", *ODD[:6]) for t in ODD], "s string, t string")
    bare = d.select(is_suspicious(F.col("s"), F.col("t"), False).alias("x"), is_suspicious(F.col("s"), F.col("t")).alias("y"), "s", "t").collect()
    assert {r.t for r in bare if r.x} == {"- -", "...", "", " ", "one two\u2003three\u2026"}
    assert {r.t for r in bare if r.y and r.s.startswith("a line")} - {r.t for r in bare if r.x} == {"a b", " a  b\t", "\u3000x\u00a0y ", "\u6211\u548c", ",a b", "\u00e9 \u2014 b", "\u266a la", "\u4f60\u597d\u3000\u5440 "}


def test_columns_describe_a_cue_as_the_fold_does(spark):
    texts = ["one ( two", "and >> four", "five . six", "[la]", "\u6211\u548c", "- -", "wait-", "because", "one, two.", "\u00e9 \u2014 b,"]
    cues = spark.createDataFrame([("t", k, k * 1000.0, k * 1000.0 + 900, t) for k, t in enumerate(texts)], "track_id string, cue_index int, start_ms double, end_ms double, text string")
    d = merging._with_descriptions(cues)
    both = d.select(F.struct(*merging.DESCRIPTION).alias("a"), merging._described(F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("b")).collect()
    assert all(tuple(r.a) == tuple(r.b) for r in both)
    assert [r.a.open for r in both] == [True, True, True, *[False] * 2, False, *[False] * 4]
