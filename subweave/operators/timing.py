"""Windows over the cues of a track. All share one partitioning, by track_id, so Spark shuffles once for a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subweave.functions.text import is_cjk, let, normalize_event, unless_blank

HINT_MS, ATOM_MS = 220.0, 1600.0


def track():  # noqa: ANN201
    """The cues of a track in order."""
    return Window.partitionBy("track_id").orderBy("cue_index")


def _in_ranges(cues: DataFrame, ranges: int, *edges: Column) -> DataFrame:
    """cues + part (ranges of so many cue numbers) and edges of each part, computed in a window over its track's parts.

    edges: columns over first and last (the part's first and last row), n (its rows) and total (of the column `step`, if there is one).
    """
    p = cues.withColumn("part", F.floor(F.col("cue_index") / ranges))
    row = F.struct("start_ms", "end_ms")
    total = F.sum("step") if "step" in cues.columns else F.count(F.lit(1))
    small = p.groupBy("track_id", "part").agg(F.min_by(row, "cue_index").alias("first"), F.max_by(row, "cue_index").alias("last"), total.alias("total"))
    return p.join(small.select("track_id", "part", *edges), ["track_id", "part"])


def _parts():  # noqa: ANN202
    return Window.partitionBy("track_id").orderBy("part")


def _part():  # noqa: ANN202
    return Window.partitionBy("track_id", "part").orderBy("cue_index")


def _next_start(cues: DataFrame, ranges: int | None) -> DataFrame:
    """cues + next_ms, the start of the next cue.

    ranges: for tracks too long for one task: cuts them by ranges of so many cue numbers, whose edges pass over a small table; all of
    a track's ranges are worked on at once, and rows are the same. So for the functions below. Track ids are not null then.
    """
    if ranges is None:
        return cues.withColumn("next_ms", F.lead("start_ms").over(track()))
    c = _in_ranges(cues, ranges, F.lead("first").over(_parts()).alias("beyond"))
    own = F.lead(F.struct("start_ms")).over(_part())
    return c.withColumn("next_ms", F.when(own.isNull(), F.col("beyond.start_ms")).otherwise(own["start_ms"])).drop("part", "beyond")


def _end_before(cues: DataFrame, ranges: int | None) -> DataFrame:
    """cues + before_ms, the end of the cue before."""
    if ranges is None:
        return cues.withColumn("before_ms", F.lag("end_ms").over(track()))
    c = _in_ranges(cues, ranges, F.lag("last").over(_parts()).alias("beyond"))
    own = F.lag(F.struct("end_ms")).over(_part())
    return c.withColumn("before_ms", F.when(own.isNull(), F.col("beyond.end_ms")).otherwise(own["end_ms"])).drop("part", "beyond")


def _running(cues: DataFrame, ranges: int | None, name: str) -> DataFrame:
    """cues with the running sum of step, under a name, in its place."""
    upto = lambda w: F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if ranges is None:
        return cues.withColumn(name, upto(track())).drop("step")
    c = _in_ranges(cues, ranges, F.sum("total").over(_parts().rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return c.withColumn(name, upto(_part()) + F.coalesce("carried", F.lit(0))).drop("step", "part", "carried")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _has_text(t: Column) -> Column:
    return F.coalesce(t.rlike(r"\S"), F.lit(False))


def event_end_hint(events: DataFrame) -> DataFrame:
    """events + end_hint_ms for events with text: the end of the next appending event or the start of the next one with text, whichever comes first; else its own end."""
    has_text = F.exists(F.coalesce("segs", F.array().cast("array<struct<utf8:string,t_offset_ms:double>>")), lambda s: _has_text(s["utf8"]))
    appends = F.coalesce(F.col("a_append") == 1, F.lit(False))
    own_end = F.col("t_start_ms") + F.coalesce("d_duration_ms", F.lit(0.0))
    mark = F.when(appends, own_end).when(has_text, F.col("t_start_ms"))
    after = Window.partitionBy("track_id").orderBy(F.col("event_index").desc()).rowsBetween(Window.unboundedPreceding, -1)  # running, in reverse
    own = F.when(own_end != 0, own_end).otherwise(F.col("t_start_ms") + HINT_MS)
    return events.withColumn("end_hint_ms", F.coalesce(F.last(mark, ignorenulls=True).over(after), own))


def build_atoms(events: DataFrame) -> DataFrame:
    """Words with times: segments with text of events that don't append. A word ends where the next begins or after 1.6 s, the last of an event at its hint; after 220 ms at least."""
    e = event_end_hint(events).where(~F.coalesce(F.col("a_append") == 1, F.lit(False)))
    s = e.select("track_id", "event_index", "t_start_ms", "end_hint_ms", F.posexplode("segs").alias("segment_index", "seg"))
    s = s.where(_has_text(F.col("seg.utf8")))
    s = s.select("track_id", "event_index", "segment_index", (F.col("t_start_ms") + F.coalesce("seg.t_offset_ms", F.lit(0.0))).alias("start_ms"), "end_hint_ms", F.col("seg.utf8").alias("text"))
    order = Window.partitionBy("track_id").orderBy("start_ms", "event_index", "segment_index")
    following = F.lead("start_ms").over(order)
    same = F.coalesce(F.lead("event_index").over(order) == F.col("event_index"), F.lit(False))
    end = F.when(same, F.least(following, F.col("start_ms") + ATOM_MS)).otherwise(F.col("end_hint_ms"))
    return s.select("track_id", "event_index", "segment_index", "start_ms", F.greatest(end, F.col("start_ms") + HINT_MS).alias("end_ms"), "text")


def combined_atoms(texts: Column) -> Column:
    """Words joined by a blank unless there is one, or what stands there so far is in a script without blanks."""
    joined = F.aggregate(texts, F.lit(""), lambda a, t: F.when((a != "") & ~is_cjk(a) & ~a.endswith(" ") & ~t.startswith(" "), F.concat(a, F.lit(" "), t)).otherwise(F.concat(a, t)))
    # without such a script the order of blanks doesn't matter, as they are collapsed afterwards
    return normalize_event(let(F.array_join(texts, " "), lambda plain: F.when(is_cjk(plain), joined).otherwise(plain)))


def scrolling_rows(events: DataFrame) -> DataFrame:
    """One cue for each event with words: their text, from the first word's start to the later of the last word's end and the event's.

    The words stay in their event's row: what follows an event's last word is another event's, so it ends at its hint, and no other
    word's end is asked for.
    """
    own = F.col("t_start_ms") + F.coalesce("d_duration_ms", F.lit(0.0))
    e = event_end_hint(events).withColumn("event_end", own).where(~F.coalesce(F.col("a_append") == 1, F.lit(False)))
    start = lambda s: F.col("t_start_ms") + F.coalesce(s["t_offset_ms"], F.lit(0.0))
    word = lambda s, i: F.struct(start(s).alias("start_ms"), i.alias("segment_index"), s["utf8"].alias("text"), F.greatest("end_hint_ms", start(s) + HINT_MS).alias("end_ms"))
    words = F.filter(F.transform("segs", word), lambda w: _has_text(w["text"]))
    rows = e.select("track_id", "event_index", words.alias("w"), "event_end")
    rows = rows.groupBy("track_id", "event_index").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w"), F.max("event_end").alias("event_end"))
    rows = rows.select("track_id", "event_index", F.get("w", 0)["start_ms"].alias("start_ms"), F.greatest(F.element_at("w", -1)["end_ms"], "event_end").alias("end_ms"), unless_blank(combined_atoms(F.transform("w", lambda w: w["text"]))).alias("text"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "event_index")) - 1
    return rows.select("track_id", number.alias("cue_index"), "start_ms", "end_ms", "text")


def truncate_overlap(cues: DataFrame, ranges: int | None = None) -> DataFrame:
    """A cue ends no later than the next begins."""
    return _next_start(cues, ranges).withColumn("end_ms", F.least("end_ms", "next_ms")).drop("next_ms")


def optimize_timing(cues: DataFrame, ranges: int | None = None) -> DataFrame:
    """Shown for a second where there is room, clear of the next cue; cues without a duration are dropped."""
    start, end = F.col("start_ms"), F.col("end_ms")
    c = _next_start(cues, ranges)
    following = F.col("next_ms")
    cut = F.when(end > following - 100, following - 100).otherwise(end)
    longer = F.when(cut - start < 1000, F.when(start + 1000 > following, following - 100).otherwise(start + 1000)).otherwise(cut)
    least = F.greatest(longer, start + 500)
    c = c.withColumn("end_ms", F.when(following.isNotNull(), F.least(following - 50, least)).otherwise(least))
    return c.where("end_ms > start_ms").drop("next_ms")


def clamp_overlap(cues: DataFrame, gap_ms: int = 100, ranges: int | None = None) -> DataFrame:
    """cues + duration_ms: up to gap_ms before the next cue, 0 at least."""
    own = F.col("end_ms") - F.col("start_ms")
    return _next_start(cues, ranges).withColumn("duration_ms", F.greatest(F.lit(0.0), F.least(own, F.col("next_ms") - gap_ms - F.col("start_ms")))).drop("next_ms")


def number_cues(cues: DataFrame, ranges: int | None = None) -> DataFrame:
    if ranges is None:
        return cues.withColumn("cue_no", F.row_number().over(track()))
    return _running(cues.withColumn("step", F.lit(1)), ranges, "cue_no").withColumn("cue_no", F.col("cue_no").cast("int"))


def cue_gaps(cues: DataFrame, ranges: int | None = None) -> DataFrame:
    c, before = _end_before(cues, ranges), F.col("before_ms")
    return c.withColumn("gap_ms", F.col("start_ms") - before).withColumn("overlaps", F.coalesce(F.col("start_ms") < before, F.lit(False))).drop("before_ms")


def gap_runs(cues: DataFrame, gap_ms: float, ranges: int | None = None) -> DataFrame:
    """cues + run_id: a new run begins where the gap to the cue before exceeds gap_ms."""
    fresh = F.coalesce(F.col("start_ms") - F.col("before_ms") > gap_ms, F.lit(False)).cast("int")
    return _running(_end_before(cues, ranges).withColumn("step", fresh).drop("before_ms"), ranges, "run_id")


def spread_duration(parts: DataFrame, floor_ms: float) -> DataFrame:
    """Gives the parts of a cue their shares of its time.

    parts: track_id, cue_index, part_index, start_ms and end_ms of the cue, weight, text. Every part but the last gets its
    share by weight, floor_ms at least; none ends after the cue; the last takes the rest. Parts without time are dropped.
    """
    own = Window.partitionBy("track_id", "cue_index")
    order = own.orderBy("part_index")
    share = F.greatest(F.lit(float(floor_ms)), round_half_up(F.col("weight") / F.sum("weight").over(own) * (F.col("end_ms") - F.col("start_ms"))))
    p = parts.withColumn("share", share).withColumn("upto", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("stop", F.when(F.lead("part_index").over(order).isNull(), F.col("end_ms")).otherwise(F.least("end_ms", F.col("start_ms") + F.col("upto"))))
    p = p.withColumn("start_ms", F.coalesce(F.lag("stop").over(order), "start_ms")).withColumn("end_ms", F.col("stop"))
    return p.where("end_ms > start_ms").drop("share", "upto", "stop")


def sort_cues(cues: DataFrame) -> DataFrame:
    """Numbers a track's cues anew by their starts; equal ones keep their order."""
    order = Window.partitionBy("track_id").orderBy("start_ms", "cue_index")
    return cues.withColumn("cue_index", F.row_number().over(order) - 1)


def deduplicate_cues(cues: DataFrame) -> DataFrame:
    """Keeps the first of cues with the same times and text, and numbers the rest anew."""
    same = Window.partitionBy("track_id", "start_ms", "end_ms", "text").orderBy("cue_index")
    kept = cues.withColumn("r", F.row_number().over(same)).where("r = 1").drop("r")
    return kept.withColumn("cue_index", F.row_number().over(track()) - 1)
