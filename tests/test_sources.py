"""Mixed caption documents in one pass, and folders of caption files."""

import json

from subweave.sources.timedtext import parse_any, parse_srv3, parse_webvtt, read_captions, read_timedtext_json, standard_cues

JSON = json.dumps({"events": [None, {"tStartMs": 10, "dDurationMs": 20, "segs": [{"utf8": "Hello "}, {"utf8": " world ."}]}, {"tStartMs": 50}, {"segs": [{"utf8": "no start"}]}, {"tStartMs": 90, "segs": [{"utf8": "\n"}]}]})
VTT = "WEBVTT\n\nNOTE x\n\n1\n00:00:01.000 --> 00:00:02.500 align:left\nI have\na dream &amp; more\n\n00:02.500 --> 00:04.000\n策略 text\n\nno time\nhere\n\n3\n00:05.000 --> 00:06.000\n"
SRV3 = '<timedtext><body>\r\n<p t="100" d="50">a<br/>b &amp;lt; &#169;</p><p t="x" d="1">no</p><P T="300" d="10" w="1"><s>two</s><s> three</s></P><p t="5" d="5"> </p></body></timedtext>'


def rows(d):
    return sorted((r.track_id, r.cue_index, r.start_ms, r.end_ms, r.text) for r in d.collect())


def test_one_pass_reads_what_each_parser_reads(spark):
    raw = [("j", JSON, None), ("v", VTT, None), ("s", SRV3, None), ("typed", JSON, "application/json"), ("null", None, None), ("empty", "", None), ("odd", "[1, 2]", None), ("text", "no captions at all", "text/plain"), ("null-json", None, "application/json")]
    table = spark.createDataFrame(raw, "track_id string, payload string, content_type string")
    of = lambda *names: table.where(table.track_id.isin(*names))
    want = rows(standard_cues(read_timedtext_json(of("j", "typed")))) + rows(parse_webvtt(of("v"))) + rows(parse_srv3(of("s")))
    out = parse_any(table)
    assert rows(out) == sorted(want) and len(want) == 8
    assert {(r.track_id, r.format) for r in out.collect()} == {("j", "json3"), ("typed", "json3"), ("v", "vtt"), ("s", "srv3")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
    assert parse_any(table.limit(0)).count() == 0


def test_folders_of_caption_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, text in (("one.json", JSON), ("deep/two, b.vtt", VTT), ("deep/er/three.srv3", SRV3), ("deep/notes.txt", "no"), ("v+1.x.vtt", VTT)):
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.vtt").write_bytes(VTT.encode() + b"\n\n00:07.000 --> 00:08.000\n\xff\xfe!")
    found = read_captions(spark, f"file://{tmp_path}")
    assert sorted(r.track_id for r in found.collect()) == ["bad", "one", "three", "two, b", "v+1.x"]
    cues = rows(parse_any(found))
    assert {t for t, *_ in cues} == {"bad", "one", "three", "two, b", "v+1.x"} and [t for k, *_, t in cues if k == "bad"][-1].endswith("!")
    assert sorted(r.track_id for r in read_captions(spark, f"file://{tmp_path}", formats=("vtt",)).collect()) == ["bad", "two, b", "v+1.x"]
    chosen = read_captions(spark, f"file://{tmp_path}", tracks=["two, b", "one"])
    assert sorted((r.track_id, r.content_type) for r in chosen.collect()) == [("one", "application/json"), ("two, b", "text/vtt")]
    assert "two" in chosen.inputFiles()[0] + chosen.inputFiles()[-1] and len(chosen.inputFiles()) == 2
