"""Registered queries over captions made from the driver's documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.functions import text as T
from subweave.operators import layout, quality, segments, timing
from subweave.operators.jobs import rejected_cues, validate_cues
from subweave.plans.registry import query
from subweave.sources import sinks, timedtext
from subweave.sources.adapters import cues_from_documents, events_from_documents, raw_from_events, table

CUES = """
l as (select cast(doc_id as varchar) as track_id, lang, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) as ls from documents),
c0 as (select track_id, lang, cast(i as integer) as cue_index, ls[i + 1] as text, cast(greatest(400, 60 * length(ls[i + 1])) as double) as d,
  cast(case when i % 7 = 6 then 1500 when i % 5 = 4 then 1100 when i % 3 = 2 then -150 else 0 end as double) as g from l, unnest(range(len(ls))) as u(i)),
c1 as (select track_id, lang, cue_index, text, d, greatest(0.0, coalesce(sum(d) over (partition by track_id order by cue_index rows between unbounded preceding and 1 preceding), 0)
  + sum(g) over (partition by track_id order by cue_index rows unbounded preceding)) as start_ms from c0),
cues as (select track_id, lang, cue_index, start_ms, start_ms + d as end_ms, text from c1)"""
MEASURED = r"""
m0 as (select *, trim(text) as t, lag(end_ms) over (partition by track_id order by cue_index) as before from cues),
m as (select *, length(regexp_replace(text, '\s', '', 'g')) as chars, len(regexp_split_to_array(trim(text), '\s+')) as words, end_ms - start_ms as ms, coalesce(start_ms < before, false) as "overlaps",
  regexp_full_match(t, '[\p{P}\p{S}\s]+') as bare, regexp_matches(t, '^[,.;:!?]') as lead_mark from m0)"""
_COUNTED = {"short_cjk": "false", "long_cjk": "false", "short_words": "words between 1 and 3", "long_words": "words > 16", "bare_punctuation": "bare", "leading_punctuation": "lead_mark", "connector_end": "false", "too_brief": "ms < 900", "too_long": "ms > 8000", "overlaps": '"overlaps"'}
COUNTERS = "count(*) as n_cues, " + ", ".join(f"cast(count_if({v}) as bigint) as n_{k}" for k, v in _COUNTED.items()) + ", cast(max(chars) as integer) as max_chars, max(ms) as max_ms"


def _sql(body: str, *more: str) -> str:
    return "with " + ",".join([CUES, *more]) + "\n" + body


def _longs(d: DataFrame, *columns: str) -> DataFrame:
    return d.withColumns({c: F.col(c).cast("long") for c in columns})


@query(_sql(f"select lang, {COUNTERS} from m group by lang", MEASURED))
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cue_quality_metrics(cues_from_documents(spark, sf_dir, ("lang",)), ["lang"])


@query(_sql(f"select track_id, {COUNTERS} from m group by track_id", MEASURED))
def quality_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cue_quality_metrics(cues_from_documents(spark, sf_dir), ["track_id"])


@query(_sql(r""", r as (select *, row_number() over (partition by track_id, t order by cue_index) > 1 as again from m)
select lang, round(sum(chars) / (sum(ms) / 1000), 6) as chars_per_s, round(sum(words) / (sum(ms) / 1000), 6) as words_per_s, round(count_if(words between 1 and 3) / count(*), 6) as short_ratio,
  round(count_if(words > 16) / count(*), 6) as long_ratio, round(count_if(words = 1) / count(*), 6) as single_word_ratio, round(count_if(again) / count(*), 6) as repeated_ratio from r group by lang""", MEASURED).replace("\n, r as", ", r as"))
def readability_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.readability_metrics(cues_from_documents(spark, sf_dir, ("lang",)), ["lang"])


@query(_sql(r""", f as (select *, concat_ws(',', case when words between 1 and 3 then 'short_words' end, case when words > 16 then 'long_words' end, case when bare then 'bare_punctuation' end,
  case when lead_mark then 'leading_punctuation' end, case when ms < 900 then 'too_brief' end, case when ms > 8000 then 'too_long' end, case when "overlaps" then 'overlaps' end) as reasons from m),
k as (select *, row_number() over (partition by track_id order by cue_index) as r from f where reasons <> '')
select track_id, cue_index, start_ms, end_ms, reasons, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180) as preview from k where r <= 30""", MEASURED).replace("\n, f as", ", f as"))
def suspicious_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.suspicious_examples(cues_from_documents(spark, sf_dir), 30)


@query(_sql("select track_id, string_agg(trim(text), chr(10) order by cue_index) as text from cues group by track_id"))
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.transcripts(cues_from_documents(spark, sf_dir))


@query(_sql("""select track_id, 'parsed' as stage, count(*) as n from cues group by track_id union all
select track_id, 'unique', count(*) from (select distinct track_id, start_ms, end_ms, text from cues) group by track_id"""))
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues_from_documents(spark, sf_dir)
    return quality.stage_counts({"parsed": c, "unique": timing.deduplicate_cues(c)})


@query(_sql("select track_id, cue_index, start_ms - before as gap_ms, coalesce(start_ms < before, false) as overlaps from (select *, lag(end_ms) over (partition by track_id order by cue_index) as before from cues)"))
def cue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.cue_gaps(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "gap_ms", "overlaps")


@query(_sql("""select track_id, cue_index, cast(sum(case when start_ms - before > 1000 then 1 else 0 end) over (partition by track_id order by cue_index rows unbounded preceding) as bigint) as run_id
from (select *, lag(end_ms) over (partition by track_id order by cue_index) as before from cues)"""))
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.gap_runs(cues_from_documents(spark, sf_dir), 1000).select("track_id", "cue_index", "run_id")


@query(_sql("select track_id, cue_index, start_ms, least(end_ms, coalesce(lead(start_ms) over (partition by track_id order by cue_index), end_ms)) as end_ms from cues"))
def truncate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.truncate_overlap(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "start_ms", "end_ms")


TIMED = """
n0 as (select *, lead(start_ms) over (partition by track_id order by cue_index) as n from cues),
n1 as (select *, case when n is not null and end_ms > n - 100 then n - 100 else end_ms end as e1 from n0),
n2 as (select *, case when e1 - start_ms < 1000 then case when n is not null and start_ms + 1000 > n then n - 100 else start_ms + 1000 end else e1 end as e2 from n1),
timed as (select track_id, cue_index, start_ms, case when n is not null then least(n - 50, greatest(e2, start_ms + 500)) else greatest(e2, start_ms + 500) end as end_ms, text from n2)"""


@query(_sql("select track_id, cue_index, start_ms, end_ms from timed where end_ms > start_ms", TIMED))
def optimize_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.optimize_timing(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "start_ms", "end_ms")


@query(_sql("select track_id, cue_index, greatest(0.0, least(end_ms - start_ms, coalesce(lead(start_ms) over (partition by track_id order by cue_index) - 100 - start_ms, end_ms - start_ms))) as duration_ms from cues"))
def clamp_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.clamp_overlap(cues_from_documents(spark, sf_dir), 100).select("track_id", "cue_index", "duration_ms")


@query(_sql("select track_id, cue_index, cast(row_number() over (partition by track_id order by cue_index) as integer) as cue_no from cues"))
def number_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.number_cues(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "cue_no")


@query(_sql("select track_id, cast(row_number() over (partition by track_id order by start_ms, cue_index) - 1 as integer) as cue_index, start_ms, end_ms from cues"))
def sort_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.sort_cues(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "start_ms", "end_ms")


@query(_sql("""select track_id, cast(row_number() over (partition by track_id order by cue_index) - 1 as integer) as cue_index, start_ms, end_ms, text
from (select track_id, min(cue_index) as cue_index, start_ms, end_ms, text from cues group by track_id, start_ms, end_ms, text)"""))
def deduplicate_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.deduplicate_cues(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "start_ms", "end_ms", "text")


@query(_sql(r"select track_id, cue_index, false as is_cjk, cast(len(regexp_split_to_array(trim(text), '\s+')) as integer) as length, cast(length(regexp_replace(text, '\s', '', 'g')) as integer) as visible, cast(greatest(1, length(regexp_replace(text, '\s', '', 'g'))) as integer) as weight from cues"))
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    c = cues_from_documents(spark, sf_dir).select("track_id", "cue_index", T.text_stats(t).alias("s"), T.visible_length(t).alias("visible"), T.cue_weight(t).alias("weight"))
    return c.select("track_id", "cue_index", "s.is_cjk", "s.length", "visible", "weight")


@query(_sql(r"""select track_id, cue_index, round((30 * length(regexp_replace(text, '[^\s]', '', 'g')) + 72 * length(regexp_replace(text, '[^A-Z]', '', 'g')) + 62 * length(regexp_replace(text, '[^a-z0-9]', '', 'g'))
  + 50 * length(regexp_replace(text, '[\sA-Za-z0-9]', '', 'g'))) / 100.0, 2) as width from cues"""))
def render_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues_from_documents(spark, sf_dir).select("track_id", "cue_index", F.round(T.render_width(F.col("text")), 2).alias("width"))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '^>>\s*', ''), '>>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(_sql(rf"select track_id, cue_index, {NORMAL} as cue, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) as event from cues"))
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return cues_from_documents(spark, sf_dir).select("track_id", "cue_index", T.normalize_cue(t).alias("cue"), T.normalize_event(t).alias("event"))


@query(_sql(rf"""select track_id, cue_index, case when t = '' or regexp_matches(t, '^[\[(♪]') then false when regexp_full_match(t, '[\p{{P}}\p{{S}}\s]+') or regexp_matches(t, '^[,.;:!?]') then true
  else list_contains(string_split('{" ".join(T.WEAK_LAST_WORDS)}', ' '), lower(regexp_extract(t, '([A-Za-z][A-Za-z''\-]*)\z', 1))) or regexp_matches(t, '[A-Za-z][A-Za-z''\-]*-\z')
    or (len(regexp_split_to_array(t, '\s+')) <= 3 and not regexp_matches(t, '[.!?…]\z')) end as dangling from (select *, {NORMAL} as t from cues)"""))
def dangling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues_from_documents(spark, sf_dir).select("track_id", "cue_index", T.is_dangling(F.col("text")).alias("dangling"))


@query(_sql("select cast(doc_id as varchar) as track_id, coalesce(ok, false) as ok from documents left join (select track_id, bool_and(start_ms >= 0 and end_ms >= start_ms and trim(text) <> '') as ok from cues group by track_id) q on q.track_id = cast(doc_id as varchar)"))
def validate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_cues(cues_from_documents(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("track_id")))


@query(_sql("select track_id, cue_index from cues where start_ms < 0 or end_ms < start_ms or trim(text) = ''"))
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_cues(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index")


# the 31 * h + c hash by a fold over the characters, all of which are single UTF-16 units here
@query("""select track_id, cast(case when h >= 2147483648 then 4294967296 - h else h end as bigint) as h from (
select cast(doc_id as varchar) as track_id, list_reduce(list_prepend(cast(0 as bigint), list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: cast(ord(c) as bigint))), lambda a, c: (a * 31 + c) % 4294967296) as h from documents)""")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = F.conv(T.source_hash(F.coalesce("text", F.lit(""))), 36, 10).cast("long")
    return d.select(F.col("doc_id").cast("string").alias("track_id"), h.alias("h"))


@query("select cast(doc_id as varchar) as track_id, sha256(text) as h from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("track_id"), T.content_hash(F.col("text")).alias("h"))


@query("select cast(doc_id as varchar) as track_id, round(ceil(length(text) / 4.0) / 1e6 * 0.15 + ceil(length(text) / 4.0) / 1e6 * 0.6, 12) as cost, case lang when 'es' then 'Spanish' when 'fr' then 'French' when 'de' then 'German' else lang end as language from documents")
def estimated_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("track_id"), F.round(T.estimated_cost(F.col("text"), F.lit("gpt-4o-mini")), 12).alias("cost"), T.language_name(F.col("lang")).alias("language"))


EVENTS = """
w as (select track_id, cue_index, start_ms, list_filter(string_split(text, ' '), lambda x: x <> '') as ws from cues),
a as (select track_id, cue_index * 2 as event_index, cast(i as integer) as segment_index, start_ms + 300 * i as start_ms, start_ms + 300 * len(ws) + 500 as own_end, len(ws) as n, case when i = 0 then ws[i + 1] else ' ' || ws[i + 1] end as text, start_ms as event_start from w, unnest(range(len(ws))) as u(i)),
b as (select *, lead(start_ms) over (partition by track_id order by start_ms, event_index, segment_index) as nxt, lead(event_index) over (partition by track_id order by start_ms, event_index, segment_index) as nxt_event from a),
atoms as (select track_id, event_index, segment_index, start_ms, greatest(case when nxt_event = event_index then least(nxt, start_ms + 1600) else event_start + 300 * n + 500 end, start_ms + 220) as end_ms, text, own_end from b)"""


@query(_sql("select track_id, event_index, segment_index, start_ms, end_ms, text from atoms", EVENTS))
def build_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.build_atoms(events_from_documents(spark, sf_dir))


@query(_sql(r"""select track_id, cast(row_number() over (partition by track_id order by start_ms, event_index) - 1 as integer) as cue_index, start_ms, end_ms, text from (
select track_id, event_index, min(start_ms) as start_ms, greatest(arg_max(end_ms, segment_index), max(own_end)) as end_ms,
  trim(regexp_replace(regexp_replace(string_agg(text, '' order by segment_index), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) as text from atoms group by track_id, event_index)""", EVENTS))
def scrolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.scrolling_rows(events_from_documents(spark, sf_dir))


@query(_sql("select track_id, true as scrolling from cues group by track_id"))
def scrolling_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timedtext.scrolling_tracks(timedtext.read_timedtext_json(raw_from_events(events_from_documents(spark, sf_dir))))


@query(_sql(r"""select track_id, cast(row_number() over (partition by track_id order by cue_index) - 1 as integer) as cue_index, start_ms, start_ms + 300 * len(ws) + 500 as end_ms, trim(regexp_replace(regexp_replace(array_to_string(ws, ' '), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) as text from w""", EVENTS))
def standard_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timedtext.standard_cues(timedtext.read_timedtext_json(raw_from_events(events_from_documents(spark, sf_dir))))


FLOORED = "select track_id, cue_index, floor(start_ms) as start_ms, floor(end_ms) as end_ms, trim(text) as text from cues"


@query(_sql(FLOORED.replace("trim(text)", "replace(replace(replace(trim(text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")))
def webvtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vtt = sinks.render_webvtt(cues_from_documents(spark, sf_dir)).withColumnRenamed("vtt", "payload")
    return timedtext.parse_webvtt(vtt).withColumns({c: F.floor(F.col(c) + 0.0001).cast("double") for c in ("start_ms", "end_ms")})


@query(_sql("""select track_id, cue_index, start_ms, start_ms + greatest(0.0, least(end_ms - start_ms, coalesce(n - 100 - start_ms, end_ms - start_ms))) as end_ms, trim(text) as text
from (select *, lead(start_ms) over (partition by track_id order by cue_index) as n from cues)"""))
def srv3_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = sinks.render_srv3(cues_from_documents(spark, sf_dir)).withColumnRenamed("xml", "payload")
    return timedtext.parse_srv3(xml)


@query(_sql(r"select track_id, cue_index, start_ms, end_ms, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) as text, 'json3' as format from cues"))
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sinks.render_timedtext_json(cues_from_documents(spark, sf_dir)).select("track_id", F.col("json").alias("payload"), F.lit(None).cast("string").alias("content_type"))
    return timedtext.parse_any(raw)


@query("with " + CUES + f""", v as ({FLOORED.replace("trim(text)", "replace(replace(replace(trim(text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")})
select *, 'vtt' as format from v where track_id::bigint % 3 = 1
union all select track_id, cue_index, start_ms, end_ms, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g')), 'json3' from cues where track_id::bigint % 3 = 0
union all select track_id, cue_index, start_ms, start_ms + greatest(0.0, least(end_ms - start_ms, coalesce(n - 100 - start_ms, end_ms - start_ms))), trim(text), 'srv3' from (select *, lead(start_ms) over (partition by track_id order by cue_index) as n from cues) where track_id::bigint % 3 = 2""")
def parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three formats in one table, read in one pass."""
    cues, of = cues_from_documents(spark, sf_dir), lambda k: F.col("track_id").cast("long") % 3 == k
    raw = [sinks.render_timedtext_json(cues.where(of(0))).withColumnRenamed("json", "payload"), sinks.render_webvtt(cues.where(of(1))).withColumnRenamed("vtt", "payload"), sinks.render_srv3(cues.where(of(2))).withColumnRenamed("xml", "payload")]
    out = timedtext.parse_any(raw[0].union(raw[1]).union(raw[2]).withColumn("content_type", F.lit(None).cast("string")))
    floored = {c: F.when(F.col("format") == "vtt", F.floor(F.col(c) + 0.0001).cast("double")).otherwise(F.col(c)) for c in ("start_ms", "end_ms")}
    return out.withColumns(floored)


PARTS = rf"""
s0 as (select *, list_filter(list_transform(regexp_extract_all({NORMAL}, '.*?[,.;:!?]\s+|.+\z'), lambda x: trim(x)), lambda x: x <> '') as parts from cues),
s1 as (select track_id, cue_index, start_ms, end_ms, i as part_index, parts[i + 1] as text, greatest(1, len(regexp_split_to_array(parts[i + 1], '\s+'))) as weight from s0, unnest(range(len(parts))) as u(i)),
s2 as (select *, greatest(400.0, floor(weight / sum(weight) over (partition by track_id, cue_index) * (end_ms - start_ms) + 0.5)) as share, lead(part_index) over (partition by track_id, cue_index order by part_index) as more from s1),
s3 as (select *, case when more is null then end_ms else least(end_ms, start_ms + sum(share) over (partition by track_id, cue_index order by part_index rows unbounded preceding)) end as stop from s2),
s4 as (select *, coalesce(lag(stop) over (partition by track_id, cue_index order by part_index), start_ms) as begin from s3)"""


@query(_sql("select track_id, cast(row_number() over (partition by track_id order by cue_index, part_index) - 1 as integer) as cue_index, begin as start_ms, stop as end_ms, text from s4 where stop > begin", PARTS))
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_sentences(cues_from_documents(spark, sf_dir), 400)


@query(_sql(r""", g0 as (select *, length(text) as n, case when length(text) > 200 then list_filter(regexp_extract_all(text, '(?s).*?[.!?…]+\s+|.+\z'), lambda x: trim(x) <> '') else [text] end as ps from cues),
g1 as (select track_id, cue_index, start_ms, end_ms, n, len(ps) as k, i, ps[i + 1] as text from g0, unnest(range(len(ps))) as u(i)),
g2 as (select *, case when i = k - 1 then end_ms else start_ms + sum(floor(length(text) / n * (end_ms - start_ms))) over (partition by track_id, cue_index order by i rows unbounded preceding) end as stop from g1)
select track_id, cast(row_number() over (partition by track_id order by cue_index, i) - 1 as integer) as cue_index, coalesce(lag(stop) over (partition by track_id, cue_index order by i), start_ms) as start_ms, stop as end_ms, case when k > 1 then trim(text) else text end as text from g2""").replace("\n, g0 as", ", g0 as"))
def split_long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_long_paragraphs(cues_from_documents(spark, sf_dir))


# numeric folds as recursive SQL; folds over text have no SQL and are held against invariants and cases in tests
@query("with recursive " + CUES + r""", t as (select track_id, cue_index, start_ms, end_ms, text, length(text) as chars, len(regexp_split_to_array(text, '\s+')) as words, regexp_matches(text, '[.!?…]\z') as stop from (select track_id, cue_index, start_ms, end_ms, """ + NORMAL + r""" as text from cues)),
r as (select track_id, cue_index, 0 as g, start_ms as gs, end_ms as le, chars, words, true as open from t where cue_index = 0 union all
  select n.track_id, n.cue_index, n.g, n.gs, n.end_ms, n.chars, n.words, not (not n.fresh and n.end_ms - n.gs >= 3000 and (n.stop or n.chars >= 160 or n.words >= 30)) from (
    select t.track_id, t.cue_index, t.end_ms, t.stop, not r.open or t.end_ms - r.gs >= 7000 or t.start_ms - r.le > 1200 as fresh, case when fresh then r.g + 1 else r.g end as g, case when fresh then t.start_ms else r.gs end as gs,
      case when fresh then t.chars else r.chars + t.chars + 1 end as chars, case when fresh then t.words else r.words + t.words end as words from r join t on t.track_id = r.track_id and t.cue_index = r.cue_index + 1) n),
p as (select r.track_id, g, min(gs) as start_ms, arg_max(le, cue_index) as end_ms, arg_max(open, cue_index) as open, string_agg(t.text, ' ' order by cue_index) as text from r join t using (track_id, cue_index) group by r.track_id, g),
q as (select *, lead(g) over (partition by track_id order by g) is null and open and end_ms - start_ms < 3000 and g > 0 as tail from p)
select track_id, cast(g as integer) as cue_index, min(start_ms) as start_ms, max(end_ms) as end_ms,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_agg(text, ' ' order by k), '\s+([,.;:!?])', '\1', 'g'), '([(\[{“‘])\s+', '\1', 'g'), '\s+([)\]}\'"”’])', '\1', 'g'), '\s{2,}', ' ', 'g')) as text
from (select track_id, case when tail then g - 1 else g end as g, g as k, start_ms, end_ms, text from q) group by track_id, g""".replace("\\'", "''"))
def merge_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_cues(cues_from_documents(spark, sf_dir)).select("track_id", "cue_index", "start_ms", "end_ms", "text")


@query()
def compact_short_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.compact_short_cues(cues_from_documents(spark, sf_dir))


@query()
def semantic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.semantic_segments(cues_from_documents(spark, sf_dir))


@query()
def optimize_source_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.optimize_source_cues(cues_from_documents(spark, sf_dir))


@query()
def split_readable_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_readable_cues(cues_from_documents(spark, sf_dir))


@query()
def assemble_scrolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assemble_scrolling_cues(events_from_documents(spark, sf_dir))


@query()
def source_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.build_source_segments(events_from_documents(spark, sf_dir))


def _same_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues_from_documents(spark, sf_dir).select("track_id", "cue_index", "start_ms", "end_ms", F.col("text").alias("source_text"), F.col("text").alias("translated_text"))


@query()
def prepare_for_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.prepare_for_render(_same_both(spark, sf_dir), "vtt")


@query()
def apply_line_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.apply_line_limits(_same_both(spark, sf_dir), "json3").select("track_id", "cue_index", "text")


@query()
def repair_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repair_boundaries(cues_from_documents(spark, sf_dir))


@query()
def compact_render_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.compact_render_cues(cues_from_documents(spark, sf_dir))


@query()
def split_for_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.display_cues(cues_from_documents(spark, sf_dir))
