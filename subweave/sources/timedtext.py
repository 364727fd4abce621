"""Reading caption documents: timed-text JSON, WebVTT and timed-text XML, into events and cues.

All are built-in expressions over one row per track; nothing shuffles. Cues are (track_id, cue_index, start_ms, end_ms, text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subweave.functions.text import normalize_event, trimmed
from subweave.schemas import DOCUMENT


def read_timedtext_json(raw: DataFrame) -> DataFrame:
    """raw (track_id, payload) -> events. Documents without an events array give no row; see rejected_json."""
    doc = F.from_json("payload", DOCUMENT)
    events = raw.select("track_id", F.posexplode(doc["events"]).alias("event_index", "e")).where("e is not null")
    return events.select("track_id", "event_index", F.coalesce("e.tStartMs", F.lit(0.0)).alias("t_start_ms"), F.col("e.dDurationMs").alias("d_duration_ms"), F.col("e.wWinId").alias("w_win_id"), F.col("e.aAppend").alias("a_append"), F.transform("e.segs", lambda s: F.struct(s["utf8"].alias("utf8"), s["tOffsetMs"].alias("t_offset_ms"))).alias("segs"))


def rejected_json(raw: DataFrame) -> DataFrame:
    """Rows whose payload isn't a document with events."""
    return raw.where(F.from_json("payload", DOCUMENT)["events"].isNull())


def segment_text(segs: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(segs, lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), F.lit(""))


def renumbered(cues: Column) -> Column:
    """Numbers an array of cue structs by position."""
    return F.transform(cues, lambda c, i: F.struct(i.alias("cue_index"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["text"].alias("text")))


def standard_cues(events: DataFrame) -> DataFrame:
    """One cue for each event with text; its end is its start plus its duration."""
    e = events.select("track_id", "event_index", F.struct("event_index", F.col("t_start_ms").alias("start_ms"), (F.col("t_start_ms") + F.coalesce("d_duration_ms", F.lit(0.0))).alias("end_ms"), normalize_event(segment_text(F.col("segs"))).alias("text")).alias("c")).where("c.text <> ''")
    whole = e.groupBy("track_id").agg(F.array_sort(F.collect_list("c")).alias("cues"))
    return _rows(whole.select("track_id", renumbered(F.col("cues")).alias("cues")))


def _rows(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.explode("cues").alias("c")).select("track_id", "c.*")


def scrolling_tracks(events: DataFrame) -> DataFrame:
    """(track_id, scrolling): whether any event has a window and appends."""
    return events.groupBy("track_id").agg(F.coalesce(F.bool_or(F.col("w_win_id").isNotNull() & (F.col("a_append") == 1)), F.lit(False)).alias("scrolling"))


def _number(text: Column, pattern: str) -> Column:
    """The number that a text starts with, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def _clock(text: Column) -> Column:
    """HH:MM:SS.mmm, MM:SS.mmm or SS.mmm in milliseconds; what follows the time is ignored."""
    parts = F.split(F.regexp_extract(trimmed(text), r"\A(\S*)", 1), ":")
    whole, real = r"\A\s*([+-]?\d+)", r"\A\s*([+-]?(?:\d+\.?\d*|\.\d+))"
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    n = F.size(parts)
    seconds = F.when(n == 3, _number(at(0), whole) * 3600 + _number(at(1), whole) * 60 + _number(at(2), real)).when(n == 2, _number(at(0), whole) * 60 + _number(at(1), real)).otherwise(_number(at(0), real))
    return seconds * 1000


def parse_webvtt(raw: DataFrame) -> DataFrame:
    """Blocks between empty lines, each an optional number, a line with -->, and the text; header and notes are skipped."""
    # one column after the other, as expressions inside a lambda would be computed again wherever they are used
    b = raw.select("track_id", F.posexplode(F.split("payload", "\n\n+")).alias("block", "b"))
    b = b.select("track_id", "block", F.split(trimmed(F.col("b")), "\n").alias("lines")).where(~F.get("lines", F.lit(0)).rlike(r"\A(?:WEBVTT|NOTE)"))
    b = b.withColumn("at", F.when(F.get("lines", F.lit(0)).rlike(r"\A\d+\z"), 1).otherwise(0))
    b = b.select("track_id", "block", F.get("lines", F.col("at")).alias("time"), trimmed(F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "\n")).alias("text"))
    b = b.where(F.col("time").contains("-->") & (F.col("text") != "")).withColumn("ends", F.split("time", "-->"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("block")) - 1
    return b.select("track_id", number.alias("cue_index"), _clock(F.get("ends", F.lit(0))).alias("start_ms"), _clock(F.get("ends", F.lit(1))).alias("end_ms"), "text")


def _entities(text: Column) -> Column:
    """XML entities in a fixed order, the ampersand first; numbers last."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.replace(F.regexp_replace(text, "(?i)&#x0a;", "\n"), F.lit("&#10;"), F.lit("\n")), "&#13;", "")
    # what stands between number entities, and the characters of these
    between = F.split(text, r"&#\d+;", -1)
    codes = F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1))
    code = lambda c: F.pmod(c.try_cast("decimal(38,0)"), F.lit(65536)).cast("int")
    one = lambda c: F.decode(F.unhex(F.lpad(F.hex(code(c).cast("long")), 4, "0")), "UTF-16BE")
    put = F.transform(F.sequence(F.lit(0), F.size(between) - 1), lambda i: F.concat(F.get(between, i), F.coalesce(one(F.get(codes, i)), F.lit(""))))
    return F.when(text.rlike(r"&#\d+;"), F.array_join(put, "")).otherwise(text)


def parse_srv3(raw: DataFrame) -> DataFrame:
    """Paragraph elements with whole-number t and d attributes; line breaks kept, other tags dropped, entities decoded."""
    payload = F.replace(F.col("payload"), F.lit("\r\n"), F.lit("\n"))
    pattern = r"(?is)<p\b([^>]*)>(.*?)</p>"
    zipped = F.arrays_zip(F.regexp_extract_all(payload, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(payload, F.lit(pattern), F.lit(2)).alias("b"))

    def cue(z: Column) -> Column:
        attribute = lambda n: _number(F.regexp_extract(z["a"], f'(?i){n}="([^"]*)"', 1), r"\A\s*([+-]?\d+)")
        start, duration = attribute("t"), attribute("d")
        body = F.regexp_replace(F.regexp_replace(z["b"], r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
        text = _entities(trimmed(body))
        return F.when(start.isNotNull() & duration.isNotNull() & (text != ""), F.struct(start.alias("start_ms"), (start + duration).alias("end_ms"), text.alias("text")))

    cues = F.filter(F.transform(zipped, cue), lambda c: c.isNotNull())
    return _rows(raw.select("track_id", renumbered(cues).alias("cues")))


def payload_format(payload: Column, content_type: Column) -> Column:
    text = trimmed(payload)
    return F.when(text.rlike(r"\A[{\[]") | F.coalesce(content_type.contains("json"), F.lit(False)), "json3").when(text.startswith("WEBVTT"), "vtt").otherwise("srv3")


def _pieces(payload: Column, form: Column) -> Column:
    """array<struct<a, b, start, duration>>: a document's events (a: text), blocks (a) or paragraph elements (a: attributes, b: body); only its own format is looked at."""
    none = lambda t: F.lit(None).cast(t)
    piece = lambda a, b=None, start=None, duration=None: F.struct(a.alias("a"), (none("string") if b is None else b).alias("b"), (none("double") if start is None else start).alias("start"), (none("double") if duration is None else duration).alias("duration"))
    events = F.filter(F.from_json(payload, DOCUMENT)["events"], lambda e: e.isNotNull())
    xml, pattern = F.replace(payload, F.lit("\r\n"), F.lit("\n")), r"(?is)<p\b([^>]*)>(.*?)</p>"
    zipped = F.arrays_zip(F.regexp_extract_all(xml, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(xml, F.lit(pattern), F.lit(2)).alias("b"))
    of_json = F.transform(events, lambda e: piece(segment_text(e["segs"]), None, e["tStartMs"], e["dDurationMs"]))
    return F.when(form == "json3", of_json).when(form == "vtt", F.transform(F.split(payload, "\n\n+"), lambda b: piece(b))).otherwise(F.transform(zipped, lambda z: piece(z["a"], z["b"])))


def parse_any(raw: DataFrame) -> DataFrame:
    """raw (track_id, payload, content_type) of mixed formats -> cues and their format, in one pass over the payloads.

    Each payload is cut into its pieces by its own format; the pieces of all formats are then rows of one table, whose
    columns are read by the row's format. Payloads that are null or hold no cue give no row.
    """
    form = F.col("format")
    p = raw.where("payload is not null").select("track_id", "payload", payload_format(F.col("payload"), F.col("content_type")).alias("format"))
    p = p.select("track_id", "format", F.posexplode(_pieces(F.col("payload"), form)).alias("at", "p")).select("track_id", "format", "at", "p.*")
    # columns one after the other, so that nothing is computed again where it is used
    p = p.withColumn("lines", F.when(form == "vtt", F.split(trimmed(F.col("a")), "\n")))
    p = p.withColumn("number", F.when(F.get("lines", F.lit(0)).rlike(r"\A\d+\z"), 1).otherwise(0))
    p = p.withColumn("time", F.get("lines", F.col("number")))
    p = p.where((form != "vtt") | (~F.get("lines", F.lit(0)).rlike(r"\A(?:WEBVTT|NOTE)") & F.col("time").contains("-->")))
    p = p.withColumn("ends", F.split("time", "-->"))
    attribute = lambda n: _number(F.regexp_extract("a", f'(?i){n}="([^"]*)"', 1), r"\A\s*([+-]?\d+)")
    start = F.when(form == "json3", F.coalesce("start", F.lit(0.0))).when(form == "vtt", _clock(F.get("ends", F.lit(0)))).otherwise(attribute("t"))
    p = p.withColumn("start_ms", start)
    end = F.when(form == "json3", F.col("start_ms") + F.coalesce("duration", F.lit(0.0))).when(form == "vtt", _clock(F.get("ends", F.lit(1)))).otherwise(F.col("start_ms") + attribute("d"))
    bare = F.regexp_replace(F.regexp_replace("b", r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    text = F.when(form == "json3", normalize_event(F.col("a"))).when(form == "vtt", trimmed(F.array_join(F.slice("lines", F.col("number") + 2, F.size("lines")), "\n"))).otherwise(_entities(trimmed(bare)))
    p = p.withColumns({"end_ms": end, "text": text}).where((F.col("text") != "") & ((form != "srv3") | (F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())))
    index = F.row_number().over(Window.partitionBy("track_id").orderBy("at")) - 1
    return p.select("track_id", index.alias("cue_index"), "start_ms", "end_ms", "text", "format")


FORMAT_FILES = {"json3": "json,json3", "vtt": "vtt", "srv3": "srv3,xml,ttml"}


def read_captions(spark: SparkSession, folder: str, formats: tuple[str, ...] = ("json3", "vtt", "srv3"), tracks: list[str] | None = None) -> DataFrame:
    """(track_id, payload, content_type) of the caption files below a folder, for parse_any; a file's track is its name without the ending.

    Formats, and tracks if a list of them is given (it becomes part of a file pattern, so thousands at most), choose files before any is opened.
    Files that aren't UTF-8 have their faulty bytes replaced.
    """
    endings = ",".join(FORMAT_FILES[f] for f in formats)
    escaped = [re.sub(r"([\\*?\[\]{},])", r"\\\1", t) for t in tracks or []]
    names = "*" if tracks is None else "{" + ",".join(escaped) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{names}.{{{endings}}}").load(folder)
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\z", 1), r"\+", "%2B"))
    ending = F.regexp_extract(name, r"\.([^.]+)\z", 1)
    kind = F.when(ending.isin("json", "json3"), "application/json").when(ending == "vtt", "text/vtt").otherwise("text/xml")
    return files.select(F.regexp_extract(name, r"\A(.*)\.[^.]+\z", 1).alias("track_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("payload"), kind.alias("content_type"))
