"""Registered queries over jobs, requests, translations and streams made from the driver's tables, with their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.functions import text as T
from subweave.operators import jobs as J
from subweave.operators import translate as X
from subweave.operators.pipeline import caption_files
from subweave.operators.quality import transcripts
from subweave.operators.segments import optimize_bilingual_cues
from subweave.plans.caption_queries import CUES
from subweave.plans.registry import query
from subweave.sources import adapters as A
from subweave.sources.job_table import JobTable
from subweave.sources.shared import new_path, written
from subweave.sources.sinks import segments, write_jobs
from subweave.streaming import requests as R

NOW = 870_000_000_000  # a fixed "now" among the dates of orders
JOBS = """
jobs as (select cast(o_orderkey as varchar) as id, 'v' || lpad(cast(o_custkey as varchar), 10, '0') as video_id, case o_orderpriority[1] when '1' then 'en' when '2' then 'fr' when '3' then 'de' else 'es' end as lang, 'zh-CN' as tlang,
  case when o_custkey % 2 = 0 then 'asr' else 'manual' end as track, case o_custkey % 3 when 0 then 'json3' when 1 then 'vtt' else 'srv3' end as fmt, cast(o_custkey % 3 as varchar) as source_hash,
  case when o_custkey % 10 = 0 then 'translating' when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'F' then 'done' else 'failed' end as status, cast(o_orderkey % 5 as integer) as retry_count,
  case when o_custkey % 3 <> 0 then epoch_ms(date_trunc('day', o_orderdate)) + 5000 end as next_retry_at, cast(null as varchar) as error_code, cast(null as varchar) as error_message,
  case when o_orderstatus = 'F' and o_custkey % 4 <> 0 then 'r' || o_orderkey end as bilingual_json, epoch_ms(date_trunc('day', o_orderdate)) as created_at, epoch_ms(date_trunc('day', o_orderdate)) as updated_at,
  epoch_ms(date_trunc('day', o_orderdate)) + 2592000000 as expires_at from orders),
newest as (select * from (select *, row_number() over (partition by video_id, lang, tlang, track, fmt, source_hash order by created_at desc, id desc) as r from jobs) where r = 1),
done as (select * from (select *, row_number() over (partition by video_id, lang, tlang, track, fmt order by created_at desc, id desc) as r from jobs where status = 'done') where r = 1)"""
REQUESTS = """
requests as (select event_id as request_id, ts, case when event_id % 50 = 0 then 'v1234' else 'v' || lpad(cast(user_id as varchar), 10, '0') end as video_id, case when event_id % 70 = 0 then null else ['en', 'fr', 'de', 'es'][event_id % 4 + 1] end as lang, 'zh-CN' as tlang,
  case when user_id % 2 = 0 then 'asr' else 'manual' end as track, case user_id % 3 when 0 then 'json3' when 1 then 'vtt' else 'srv3' end as fmt, cast(user_id % 3 as varchar) as source_hash from events),
valid as (select * from requests where regexp_full_match(video_id, '[a-zA-Z0-9_-]{11}') and length(lang) between 1 and 10)"""
KEY = "video_id, lang, tlang, track, fmt"


def _sql(body: str, *parts: str) -> str:
    return "with " + ",".join(parts) + "\n" + body


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.validate_requests(A.requests_from_events(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).where("error is null")


@query(_sql("select request_id, case when not coalesce(regexp_full_match(video_id, '[a-zA-Z0-9_-]{11}'), false) then 'video' when not coalesce(length(lang) between 1 and 10, false) then 'lang' end as error from requests", REQUESTS))
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", "error")


@query(_sql("select request_id, concat_ws('|', video_id, lang, tlang, track, fmt) as key, track || '/' || fmt as parts from valid", REQUESTS))
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _valid(spark, sf_dir)
    key = T.request_key(F.col("v"), F.col("lang"), F.col("tlang"), F.col("kind"), F.col("fmt"))
    k = r.select("request_id", key.alias("key"))
    s = T.split_key(F.col("key"))
    return k.select("request_id", "key", F.concat_ws("/", s["track"], s["fmt"]).alias("parts"))


@query(_sql("select id, status, created_at from newest", JOBS))
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY).select("id", "status", "created_at")


@query(_sql(f"select request_id, case when bilingual_json is not null then 'hit' else 'miss' end as cache_status, bilingual_json as result from valid left join done using ({KEY})", JOBS, REQUESTS))
def lookup_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lookup_cached(_valid(spark, sf_dir), A.jobs_from_orders(spark, sf_dir)).select("request_id", "cache_status", "result")


@query(_sql(f"select count_if(hit) ::bigint as hits, count_if(not hit) ::bigint as misses, floor(count_if(hit) / count(*) * 10000 + 0.5) / 100 as hit_rate from (select bilingual_json is not null as hit from valid left join done using ({KEY}))", JOBS, REQUESTS))
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cache_hit_rate(J.lookup_cached(_valid(spark, sf_dir), A.jobs_from_orders(spark, sf_dir)))


@query(_sql(f"select distinct {KEY}, source_hash from valid v where not exists (select 1 from newest n where n.status in ('pending', 'translating') and " + " and ".join(f"n.{c} = v.{c}" for c in J.NATURAL_KEY) + ")", JOBS, REQUESTS))
def plan_new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.plan_new_jobs(_valid(spark, sf_dir), A.jobs_from_orders(spark, sf_dir)).select(*J.NATURAL_KEY)


@query(_sql("select count(*) as total, count_if(status = 'done') ::bigint as done, count_if(status = 'pending') ::bigint as pending, count_if(status = 'failed') ::bigint as failed from jobs", JOBS))
def job_status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_status_stats(A.jobs_from_orders(spark, sf_dir))


@query("""select key, cast(sum(value) as bigint) as value, max(updated_at) as updated_at from (select event_type as key, cast(1 as bigint) as value, event_id as updated_at from events
union all select event_type, 100, -1 from (select distinct event_type from events)) group by key""")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    old = e.select(F.col("event_type").alias("key")).distinct().select("key", F.lit(100).cast("long").alias("value"), F.lit(-1).cast("long").alias("updated_at"))
    return J.merge_counters(old, e.select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("value"), F.col("event_id").alias("updated_at")))


CALLS = "calls as (select ts, case when event_id % 2 = 0 then 'alpha' else 'beta' end as provider, event_type as endpoint, cast(floor(value * 10) as bigint) as token_count, value / 1000 as cost_usd, event_id % 500 as latency_ms from events)"


@query(_sql("select provider, endpoint, cast(ts as date) as date, count(*) as requests, cast(sum(token_count) as bigint) as tokens, round(sum(cost_usd), 6) as cost_usd, avg(latency_ms) as avg_latency_ms from calls group by 1, 2, 3", CALLS))
def api_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.api_usage_daily(A.calls_from_events(spark, sf_dir))


@query(_sql("select id, created_at from jobs order by created_at desc, id desc limit 10", JOBS))
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent_jobs(A.jobs_from_orders(spark, sf_dir), 10).select("id", "created_at")


@query(_sql(f"select id, created_at from jobs where status in ('pending', 'failed') and retry_count < 3 and (next_retry_at is null or next_retry_at <= {NOW}) order by created_at, id limit 10", JOBS))
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.due_jobs(A.jobs_from_orders(spark, sf_dir), NOW).select("id", "created_at")


@query(_sql(f"""select id, case when v.video_id is not null then 'pending' else status end as status, case when v.video_id is not null then null else bilingual_json end as bilingual_json, case when v.video_id is not null then {NOW} else updated_at end as updated_at
from newest n left join (select distinct {KEY}, source_hash from valid) v using ({KEY}, source_hash) union all
select sha256(concat_ws('|', {KEY}, source_hash)), 'pending', null, {NOW} from (select distinct {KEY}, source_hash from valid) v where not exists (select 1 from newest n where """ + " and ".join(f"n.{c} = v.{c}" for c in J.NATURAL_KEY) + ")", JOBS, REQUESTS))
def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY)
    incoming = J.new_jobs(_valid(spark, sf_dir).select(*J.NATURAL_KEY).dropDuplicates(), NOW)
    return J.upsert_jobs(held, incoming, NOW).select("id", "status", "bilingual_json", "updated_at")


@query(_sql(f"""select id, case when k = 0 then 'failed' when k = 1 then 'done' else status end as status, case when k = 0 then 'E1' when k = 1 then null else error_code end as error_code,
case when k = 1 then 'new' else bilingual_json end as bilingual_json, case when k < 2 then {NOW} else updated_at end as updated_at from (select *, cast(id as bigint) % 3 as k from newest)""", JOBS))
def update_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY)
    k = F.col("id").cast("long") % 3
    failed = F.when(k == 0, "E1")
    updates = held.where(k < 2).select(*J.NATURAL_KEY, F.when(k == 0, "failed").otherwise("done").alias("new_status"), failed.alias("error_code"), failed.alias("error_message"), F.lit("new").alias("result"))
    return J.update_job_status(held, updates, NOW).select("id", "status", "error_code", "bilingual_json", "updated_at")


@query(_sql(f"select id, case when status = 'failed' then retry_count + 1 else retry_count end as retry_count, case when status = 'failed' then cast({NOW} + 5000 * power(2, retry_count) as bigint) else next_retry_at end as next_retry_at from newest", JOBS))
def schedule_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY)
    return J.schedule_retry(held, held.where("status = 'failed'"), NOW).select("id", "retry_count", "next_retry_at")


@query(_sql(f"select 'job' as kind, id from jobs where expires_at >= {NOW} union all select 'segment', cast(l_orderkey as varchar) || '-' || l_linenumber from lineitem where cast(l_orderkey as varchar) in (select id from jobs where expires_at >= {NOW})", JOBS))
def expire_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    kept, segments = J.expire_jobs(A.jobs_from_orders(spark, sf_dir), lines, NOW)
    return kept.select(F.lit("job").alias("kind"), "id").union(segments.select(F.lit("segment"), "id"))


TURNS = """
t0 as (select cast(conv_id as varchar) as track_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as next_text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) * 50.0 as since from conversations window w as (partition by conv_id order by turn)),
pairs as (select track_id, cast(row_number() over (partition by track_id order by turn) - 1 as integer) as cue_index, cast(since as double) as start_ms, cast(since + 50.0 * length(text) as double) as end_ms, text as source_text, next_text as translated_text from t0 where role = 'user' and next_role = 'assistant' and next_text is not null)"""


@query(_sql("select * from pairs", TURNS))
def bilingual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bilingual_join(*A.bilingual_from_conversations(spark, sf_dir))


@query(_sql("select track_id, cue_index, 'primary' as side, case when trim(translated_text) <> '' then trim(translated_text) else trim(source_text) end as shown from pairs", TURNS))
def select_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bilingual_join(*A.bilingual_from_conversations(spark, sf_dir))
    return b.select("track_id", "cue_index", F.lit("primary").alias("side"), T.select_output(F.col("source_text"), F.col("translated_text"))["primary"].alias("shown"))


@query(_sql("""select track_id, cue_index, 'bilingual' as mode, trim(coalesce(source_text, '')) as shown, trim(coalesce(translated_text, '')) as below from pairs
union all select track_id, cue_index, 'original-only', trim(coalesce(source_text, '')), '' from pairs""", TURNS))
def select_output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bilingual_join(*A.bilingual_from_conversations(spark, sf_dir))
    of = lambda mode: b.select("track_id", "cue_index", F.lit(mode).alias("mode"), T.select_output(F.col("source_text"), F.col("translated_text"), mode).alias("x"))
    return of("bilingual").unionByName(of("original-only")).select("track_id", "cue_index", "mode", F.col("x.primary").alias("shown"), F.col("x.secondary").alias("below"))


@query(_sql(r"""select track_id, cue_index, nt = 0 or (regexp_matches(translated_text, '\.{3}|…|⋯') and not regexp_matches(source_text, '\.{3}|…|⋯')) or (ns >= 12 and nt <= 2) or (ns >= 18 and nt <= 4) or (ns >= 28 and nt <= 6) or (ns >= 40 and nt <= 8)
  or regexp_full_match(trim(translated_text), '[\p{P}\p{S}\s]+') as suspicious from (select *, length(regexp_replace(source_text, '\s', '', 'g')) as ns, length(regexp_replace(translated_text, '\s', '', 'g')) as nt from pairs)""", TURNS))
def suspicious_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bilingual_join(*A.bilingual_from_conversations(spark, sf_dir))
    return b.select("track_id", "cue_index", T.is_suspicious(F.col("source_text"), F.col("translated_text")).alias("suspicious"))


_PARTS_OF = r"list_filter(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace({x}, '^>>\s*', ''), '>>', ' ', 'g'), '\s+', ' ', 'g')), '.*?[,.;:!?]\s+|.+\z'), lambda x: trim(x)), lambda x: x <> '')"
_N_WORDS = r"case when trim({x}) = '' then 0 else len(regexp_split_to_array(trim({x}), '\s+')) end"


@query(_sql(rf"""select track_id, cue_index, start_ms, end_ms, source_text, translated_text from (
select track_id, cue_index, start_ms, case when n is not null then least(n - 50, greatest(e2, start_ms + 500)) else greatest(e2, start_ms + 500) end as end_ms, source_text, translated_text from (
  select *, case when e1 - start_ms < 1000 then case when n is not null and start_ms + 1000 > n then n - 100 else start_ms + 1000 end else e1 end as e2 from (
    select *, case when n is not null and end_ms > n - 100 then n - 100 else end_ms end as e1 from (select *, lead(start_ms) over (partition by track_id order by cue_index) as n from numbered)))) where end_ms > start_ms""", TURNS, rf"""
b0 as (select *, {_PARTS_OF.format(x="source_text")} as ps, {_PARTS_OF.format(x="translated_text")} as pt from pairs),
b1 as (select *, trim(translated_text) <> '' and ({_N_WORDS.format(x="source_text")} > 14 or {_N_WORDS.format(x="translated_text")} > 14) and end_ms - start_ms >= 2400 and greatest(len(ps), len(pt)) > 1 as cut from b0),
b2 as (select track_id, cue_index, start_ms, end_ms, i as part, case when cut then coalesce(ps[i + 1], '') else source_text end as source_text, case when cut then coalesce(pt[i + 1], '') else translated_text end as translated_text
  from b1, unnest(range(case when cut then greatest(len(ps), len(pt)) else 1 end)) as u(i)),
b3 as (select *, greatest(1, {_N_WORDS.format(x="source_text")} + {_N_WORDS.format(x="translated_text")}) as weight from b2),
b4 as (select *, greatest(500.0, floor(weight / sum(weight) over (partition by track_id, cue_index) * (end_ms - start_ms) + 0.5)) as share, lead(part) over (partition by track_id, cue_index order by part) as more from b3),
b5 as (select *, case when more is null then end_ms else least(end_ms, start_ms + sum(share) over (partition by track_id, cue_index order by part rows unbounded preceding)) end as stop from b4),
b6 as (select *, coalesce(lag(stop) over (partition by track_id, cue_index order by part), start_ms) as begin from b5),
numbered as (select track_id, cast(row_number() over (partition by track_id order by cue_index, part) - 1 as integer) as cue_index, begin as start_ms, stop as end_ms, source_text, translated_text from b6 where stop > begin)"""))
def optimize_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize_bilingual_cues(X.bilingual_join(*A.bilingual_from_conversations(spark, sf_dir)))


BATCHES = r"""
n as (select track_id, cue_index, text, greatest(1, length(trim(text))) as n from cues),
r as (select track_id, cue_index, 0 as batch_no, 1 as items, n as chars from n where cue_index = 0 union all
  select n.track_id, n.cue_index, case when r.items >= 12 or r.chars + n.n > 900 then r.batch_no + 1 else r.batch_no end, case when r.items >= 12 or r.chars + n.n > 900 then 1 else r.items + 1 end, case when r.items >= 12 or r.chars + n.n > 900 then n.n else r.chars + n.n end
  from r join n on n.track_id = r.track_id and n.cue_index = r.cue_index + 1),
batches as (select track_id, batch_no, min(cue_index) as start, max(cue_index) + 1 as stop from r group by track_id, batch_no)"""


@query("with recursive " + CUES + "," + BATCHES + """ select track_id, batch_no, cast(start as integer) as start, cast(stop as integer) as "end" from batches""")
def plan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.plan_batches(A.cues_from_documents(spark, sf_dir))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.batches_with_context(A.cues_from_documents(spark, sf_dir))


@query("with recursive " + CUES + "," + BATCHES + """ select b.track_id, b.batch_no, cast(count_if(c.cue_index < start) as integer) as n_before, cast(count_if(c.cue_index >= start and c.cue_index < stop) as integer) as n_current, cast(count_if(c.cue_index >= stop) as integer) as n_after,
  string_agg(c.text, chr(10) order by c.cue_index) as lines from batches b join cues c on c.track_id = b.track_id and c.cue_index >= start - 2 and c.cue_index < stop + 1 group by 1, 2""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.transform(F.concat("preceding", "current", "following"), lambda x: x["text"]), "\n")
    return _batches(spark, sf_dir).select("track_id", "batch_no", F.size("preceding").alias("n_before"), F.size("current").alias("n_current"), F.size("following").alias("n_after"), lines.alias("lines"))


def _prompt_sql(head: str, ask: str) -> str:
    """The SQL of a prompt with context: batches of plan_batches with two lines before and one after."""
    lines = lambda where: f"coalesce(string_agg(case when {where} then '[' || c.cue_index || '] ' || c.text end, chr(10) order by c.cue_index), '(none)')"
    nl = "chr(10)"
    parts = [f"'{head}'", nl, nl, "'Context'", nl, nl, "'Lines before:'", nl, "p", nl, nl, "'Lines after:'", nl, "f", nl, nl, "'Lines to work on:'", nl, "c", nl, nl, f"'Answer with a JSON array of exactly ' || n || ' items, each {ask}.'"]
    return "with recursive " + CUES + "," + BATCHES + f""" select track_id, batch_no, {' || '.join(parts)} as prompt from (select b.track_id, b.batch_no, count_if(c.cue_index >= start and c.cue_index < stop) as n,
  {lines("c.cue_index < start")} as p, {lines("c.cue_index >= start and c.cue_index < stop")} as c, {lines("c.cue_index >= stop")} as f
  from batches b join cues c on c.track_id = b.track_id and c.cue_index >= start - 2 and c.cue_index < stop + 1 group by 1, 2)"""


@query(_prompt_sql("Translate subtitles to French. Translate each line by itself and keep its number. Don''t merge, move or leave out lines. Use the lines around only to understand.", '{"id": number, "translation": text}'))
def translation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.translation_prompts(_batches(spark, sf_dir), "fr").select("track_id", "batch_no", "prompt")


@query(_prompt_sql("Repair punctuation, case and broken sentences of these subtitle lines in their own language. Keep each number; add and leave out nothing.", '{"id": number, "restored": text}'))
def restore_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.restore_prompts(_batches(spark, sf_dir)).select("track_id", "batch_no", "prompt")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model: lower-cased lines, with known faults."""
    b = _batches(spark, sf_dir)
    items = F.transform("current", lambda x: F.struct(x["index"].alias("id"), F.when(x["index"] % 7 == 6, "...").otherwise(F.lower(x["text"])).alias("translation")))
    items = F.when(F.col("batch_no") % 11 == 10, F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)
    content = F.to_json(items)
    content = F.when(F.col("batch_no") % 13 == 12, F.concat(F.lit("```json\n"), content, F.lit("\n```"))).otherwise(content)
    return b.select("track_id", "batch_no", "start", "end", content.alias("content"), F.size("current").alias("expected"))


ANSWERED = CUES + "," + BATCHES + """,
good as (select r.track_id, r.batch_no, r.cue_index, case when r.cue_index % 7 = 6 then '...' else lower(trim(c.text)) end as text from r join cues c using (track_id, cue_index) where r.batch_no % 11 <> 10)"""


@query("with recursive " + ANSWERED + " select track_id, batch_no, cue_index, text, cast(null as varchar) as error from good union all select track_id, batch_no, null, null, 'count' from batches where batch_no % 11 = 10")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.parse_answers(_answers(spark, sf_dir))


@query("with recursive " + ANSWERED + " select c.track_id, c.cue_index, coalesce(g.text, c.text) as translated_text from cues c left join good g using (track_id, cue_index)")
def apply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.apply_answers(A.cues_from_documents(spark, sf_dir), X.parse_answers(_answers(spark, sf_dir))).select("track_id", "cue_index", "translated_text")


@query("with recursive " + ANSWERED + " select c.track_id, c.cue_index, 'missing' as problem from cues c anti join good g using (track_id, cue_index)")
def audit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.audit_answers(A.cues_from_documents(spark, sf_dir), X.parse_answers(_answers(spark, sf_dir)))


@query("with recursive " + ANSWERED + """, f as (select * from batches where batch_no % 11 = 10), one as (select track_id, start, stop from f where stop - start = 1 union all select g.track_id, g.cue_index, g.cue_index + 1 from good g join cues c using (track_id, cue_index) where g.text = '...' and not contains(c.text, '...'))
select track_id, cast(start as integer) as start, cast(stop as integer) as "end", 'line' as how from one union all
select track_id, start, cast(start + ceil((stop - start) / 2) as integer), 'half' from f where stop - start > 1 union all select track_id, cast(start + ceil((stop - start) / 2) as integer), stop, 'half' from f where stop - start > 1""")
def fallback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    parsed = X.parse_answers(a).join(A.cues_from_documents(spark, sf_dir).select("track_id", "cue_index", F.col("text").alias("source_text")), ["track_id", "cue_index"], "left")
    return X.fallback_plan(a, parsed, 0).select("track_id", "start", "end", "how")


CHUNKS = "with recursive " + CUES + """,
x as (select track_id, string_agg(trim(text), chr(10) order by cue_index) as text from cues group by track_id),
k as (select track_id, 0 as pos, 0 as stop, text from x union all select track_id, stop, case when far < length(text) and nl > stop + 6000 then nl else far end, text from (
  select track_id, text, stop, far, case when contains(sub, chr(10)) then stop + length(sub) - strpos(reverse(sub), chr(10)) else -1 end as nl from (
    select track_id, text, stop, least(stop + 12000, length(text)) as far, substr(text, stop + 1, 12001) as sub from k where stop < length(text)))),
y as (select track_id, pos, trim(substr(text, pos + 1, stop - pos), ' ' || chr(10)) as text from k where stop > pos)"""


@query(CHUNKS + """
select track_id, cast(row_number() over (partition by track_id order by pos) - 1 as integer) as chunk_no, text from y where text <> ''""")
def transcript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_transcripts(transcripts(A.cues_from_documents(spark, sf_dir)), 12_000)


_GUIDANCE_SQL = CHUNKS + f""",
z as (select track_id, cast(row_number() over (partition by track_id order by pos) - 1 as integer) as chunk_no, text from y where text <> '')
select track_id, 'summary' as kind, chunk_no, '{X.GUIDANCE["summary", "map"]}' || chr(10) || chr(10) || text as prompt from z
union all select track_id, 'glossary', chunk_no, '{X.GUIDANCE["glossary", "map"]} French.' || chr(10) || chr(10) || text from z
union all select track_id, 'summary', -1, '{X.GUIDANCE["summary", "reduce"]}' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by chunk_no) from z group by track_id
union all select track_id, 'glossary', -1, '{X.GUIDANCE["glossary", "reduce"]} French.' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by chunk_no) from z group by track_id"""


@query(_GUIDANCE_SQL)
def guidance_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and glossary prompts: one for each chunk, and one for each track (chunk -1) that combines what the chunks gave (here their texts)."""
    chunks = X.chunk_transcripts(transcripts(A.cues_from_documents(spark, sf_dir)), 12_000)
    out = None
    for kind in ("summary", "glossary"):
        each = X.guidance_prompts(chunks, kind, "map", "French").select("track_id", F.lit(kind).alias("kind"), "chunk_no", "prompt")
        whole = X.guidance_prompts(chunks, kind, "reduce", "French").select("track_id", F.lit(kind).alias("kind"), F.lit(-1).alias("chunk_no"), "prompt")
        out = each.unionByName(whole) if out is None else out.unionByName(each).unionByName(whole)
    return out


def _lower_model(prompts: list[str]) -> list[str]:
    """A stand-in for a model: lower-cases the lines of a prompt."""
    out = []
    for p in prompts:
        lines = re.findall(r"^\[(\d+)\] (.*)$", p.split("Lines to work on:")[1].split("\n\nAnswer with")[0], re.M)
        out.append(json.dumps([{"id": int(k), "translation": t.lower()} for k, t in lines]))
    return out


def _lower_line(prompts: list[str]) -> list[str]:
    """The same for prompts of one line alone."""
    return [p.split("\n\nText: ", 1)[1].lower() for p in prompts]


@query(_sql(r"select track_id, cue_index, case when regexp_full_match(trim(text), '[\p{P}\p{S}\s]+') then text else lower(trim(text)) end as translated_text from cues", CUES))
def translate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.translate_to_bilingual(A.cues_from_documents(spark, sf_dir), "fr", _lower_model, line_fn=_lower_line, partitions=X.AS_DEALT)
    return out.select("track_id", "cue_index", "translated_text")


def _faulty_model(prompts: list[str]) -> list[str]:
    """A model that gets every batch wrong, by its first line's number: ids moved by one, one id for all, one item twice instead of another, or no answer at all."""
    out = []
    for answer in map(json.loads, _lower_model(prompts)):
        kind = answer[0]["id"] % 4
        if kind == 3:
            raise RuntimeError("the model is not there")
        for k, x in enumerate(answer):
            x["id"] = x["id"] + 1 if kind == 0 else answer[0]["id"] if kind == 1 else answer[min(k, len(answer) - 2)]["id"]
        out.append(json.dumps(answer))
    return out


def _faulty_line(prompts: list[str]) -> list[str]:
    """A model for lines that fails for some of them."""
    out = _lower_line(prompts)
    if any(len(x) % 11 == 3 for x in out):
        raise RuntimeError("a line that the model can't take")
    return out


@query(_sql(r"select track_id, cue_index, case when regexp_full_match(trim(text), '[\p{P}\p{S}\s]+') or length(text) % 11 = 3 then text else lower(trim(text)) end as translated_text from cues", CUES))
def translate_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with moved, repeated and missing ids and calls that raise: no line gets another's text, and no call costs other lines theirs."""
    out = X.translate_to_bilingual(A.cues_from_documents(spark, sf_dir), "fr", _faulty_model, line_fn=_faulty_line, ledger=X.Ledger(new_path(spark, "ledger"), "stand-in"), partitions=X.AS_DEALT)
    return out.select("track_id", "cue_index", "translated_text")


def _upper_model(prompts: list[str]) -> list[str]:
    """A stand-in for the model that repairs lines: upper-cases them."""
    out = []
    for p in prompts:
        lines = re.findall(r"^\[(\d+)\] (.*)$", p.split("Lines to work on:")[1].split("\n\nAnswer with")[0], re.M)
        out.append(json.dumps([{"id": int(k), "restored": t.upper()} for k, t in lines]))
    return out


def _advice_model(prompts: list[str]) -> list[str]:
    return [str(len(p)) for p in prompts]


@query(_sql(r"select track_id, cue_index, text as source_text, case when regexp_full_match(trim(text), '[\p{P}\p{S}\s]+') then upper(trim(text)) else lower(replace(trim(text), 'ß', 'ss')) end as translated_text from cues", CUES))
def translate_with_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with repaired lines, summaries and glossaries; the source texts stay as they were."""
    out = X.translate_to_bilingual(A.cues_from_documents(spark, sf_dir), "fr", _lower_model, line_fn=_lower_line, restore_fn=_upper_model, guidance_fn=_advice_model, partitions=X.AS_DEALT)
    return out.select("track_id", "cue_index", "source_text", "translated_text")


@query()
def caption_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to rendered translations in one chain; see operators/pipeline.py."""
    return caption_files(A.events_from_documents(spark, sf_dir), "fr", _lower_model, line_fn=_lower_line, partitions=X.AS_DEALT)


@query(_sql("select id, lang, status, created_at from jobs", JOBS))
def job_table_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jobs")
    write_jobs(A.jobs_from_orders(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "lang", "status", "created_at")


QUERY_OF_SESSIONS = _sql("select track_id, cast(min(start_ms) as bigint) as session_start, cast(max(end_ms) as bigint) + 1200 as session_end, count(*) as n from g group by track_id, k", CUES, """
s as (select track_id, cue_index, start_ms, end_ms, max(end_ms) over (partition by track_id order by start_ms, cue_index rows between unbounded preceding and 1 preceding) as far from cues),
g as (select *, sum(case when start_ms - far > 1200 then 1 else 0 end) over (partition by track_id order by start_ms, cue_index rows unbounded preceding) as k from s)""")


@query(QUERY_OF_SESSIONS)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.cues_from_documents(spark, sf_dir).select("track_id", F.timestamp_millis(F.col("start_ms").cast("long")).alias("ts"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return R.gap_sessions(c).select("track_id", F.unix_millis("session_start").alias("session_start"), F.unix_millis("session_end").alias("session_end"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, whether the table is one file or a folder of files."""
    reader = spark.readStream.schema(A.table(spark, sf_dir, "events").schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:  # noqa: ANN001
    """Runs a streaming query over the events until it has read them all, and returns what it wrote."""
    folder = new_path(spark, "stream")
    out = make(_events(spark, sf_dir))
    q = out.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(folder + "/out")


@query("""select epoch_us(date_trunc('day', cast(ts as timestamp))) // 1000000 as window_start, case when event_id % 2 = 0 then 'alpha' else 'beta' end as provider, event_type as endpoint, count(*) as calls,
cast(sum(cast(floor(value * 10) as bigint)) as bigint) as tokens, round(sum(value / 1000), 6) as cost_usd from events group by 1, 2, 3""")
def streaming_daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days with all their rows: no row is late within the table's own span, and each window's last update counts, so open ones do too."""
    calls = lambda e: e.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"), F.col("event_type").alias("endpoint"), F.floor(F.col("value") * 10).cast("long").alias("token_count"), (F.col("value") / 1000).alias("cost_usd"))
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = A.table(spark, sf_dir, "events").agg((F.max(ts) - F.min(ts)).alias("s")).first().s or 0
    folder = new_path(spark, "stream")
    out = R.windowed_counters(calls(_events(spark, sf_dir)), delay=f"{span + 2 * 86_400} seconds")
    schema = out.schema.add("epoch", "long")

    def update(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/none")
    out.writeStream.foreachBatch(update).option("checkpointLocation", folder + "/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    key = ["window_start", "provider", "endpoint"]
    last = F.max_by(F.struct("calls", "tokens", "cost_usd"), "epoch").alias("x")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder + "/out").groupBy(*key).agg(last).select(F.unix_seconds("window_start").alias("window_start"), *key[1:], "x.calls", "x.tokens", F.round("x.cost_usd", 6).alias("cost_usd"))


@query(_sql(f"select request_id, case when bilingual_json is not null then 'hit' when b.id is not null then 'in-progress' else 'new' end as state from valid v left join done d using ({KEY}) left join (select id, {KEY}, source_hash from newest where status in ('pending', 'translating')) b on " + " and ".join(f"b.{c} = v.{c}" for c in J.NATURAL_KEY), JOBS, REQUESTS))
def classify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.classify_requests(A.requests_from_events(spark, sf_dir), A.jobs_from_orders(spark, sf_dir))
    return out.where("state <> 'invalid'").select("request_id", "state")




@query(_sql(f"select distinct {KEY}, source_hash from valid", REQUESTS))
def streaming_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys stay in flight for as long as the table spans."""

    def once(events: DataFrame) -> DataFrame:
        r = J.validate_requests(A.requests_of(events)).where("error is null").withColumn("ts", F.col("ts").cast("timestamp"))
        return R.dedupe_in_flight(r, "3650 days").select(*J.NATURAL_KEY)

    return _streamed(spark, sf_dir, once)


def _table_of_orders(spark: SparkSession, sf_dir: str) -> JobTable:
    """The newest job of each natural key of the orders, in cells."""
    table = JobTable(spark, new_path(spark, "jobs"), buckets=8, days=360)
    table.upsert(written(J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY)), NOW)
    return table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fifth customer a result for the newest job of each key, under another id, and a job of a key that isn't there."""
    held = J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY).where(F.substring("video_id", 2, 10).cast("long") % 5 == 0)
    other = held.withColumns({"source_hash": F.lit("new"), "id": F.concat(F.lit("n"), "id")})
    other = other.groupBy(*J.NATURAL_KEY).agg(F.min(F.struct(*[F.col(c) for c in other.columns])).alias("x")).select("x.*")
    changed = held.withColumns({"id": F.concat(F.lit("c"), "id"), "status": F.lit("done"), "bilingual_json": F.lit("made")})
    return written(changed.unionByName(other.select(changed.columns)))


_TABLE = f"""
f as (select * from newest where cast(substr(video_id, 2) as bigint) % 5 = 0),
o0 as (select id, video_id, lang, tlang, track, fmt, status, retry_count, bilingual_json, created_at, expires_at, row_number() over (partition by {KEY} order by 'n' || id) as k from f),
held as (select id, status, bilingual_json, updated_at, retry_count, expires_at from newest where not cast(substr(video_id, 2) as bigint) % 5 = 0
  union all select id, 'done', 'made', {NOW}, retry_count, expires_at from f
  union all select 'n' || id, status, bilingual_json, created_at, retry_count, expires_at from o0 where k = 1)"""


@query(_sql("select * from held", JOBS, _TABLE))
def job_table_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that rewrites only the cells it hits, read by the newest manifest."""
    table = _table_of_orders(spark, sf_dir)
    table.upsert(_changes(spark, sf_dir), NOW)
    return table.jobs().select("id", "status", "bilingual_json", "updated_at", "retry_count", "expires_at")


@query(_sql(f"""select id, case when failed then 'failed' else status end as status, case when failed then 'E1' end as error_code, case when failed then {NOW} else updated_at end as updated_at,
  case when failed then retry_count + 1 else retry_count end as retry_count, case when failed then cast({NOW} + 5000 * power(2, retry_count) as bigint) else next_retry_at end as next_retry_at from (select *, cast(substr(video_id, 2) as bigint) % 3 = 0 as failed from newest)""", JOBS))
def job_table_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures written to the table and their retries planned, by the cells that hold them."""
    table = _table_of_orders(spark, sf_dir)
    failed = written(table.jobs().where(F.substring("video_id", 2, 10).cast("long") % 3 == 0).select(*J.NATURAL_KEY, F.lit("failed").alias("new_status"), F.lit("E1").alias("error_code"), F.lit("failed").alias("error_message"), F.lit(None).cast("string").alias("result")))
    table.update_status(failed, NOW)
    table.schedule_retry(failed, NOW)
    return table.jobs().select("id", "status", "error_code", "updated_at", "retry_count", "next_retry_at")


def _lines_as_segments(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The order lines as segments of the jobs (id, job_key: the order's number)."""
    l = A.table(spark, sf_dir, "lineitem").join(ids.withColumnRenamed("id", "job_id"), F.col("l_orderkey") == F.col("job_key"))
    at = F.col("l_linenumber") * 1000.0
    return segments(l.select("job_id", F.col("l_linenumber").alias("cue_index"), at.alias("start_ms"), (at + 900).alias("end_ms"), F.col("l_returnflag").alias("source_text"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("translated_text")), NOW)


@query(_sql("""select n.id || '-' || l_linenumber as id, n.id as job_id, cast(l_linenumber as integer) as segment_index, cast(l_linenumber * 1000 as bigint) as start_ms, l_returnflag as source_text, case when l_linenumber % 2 = 0 and l_linestatus <> '' then 'done' else 'pending' end as status
  from newest n join lineitem on l_orderkey = cast(n.id as bigint)""", JOBS))
def job_table_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments committed with their jobs; written twice, the second time under other ids, which changes nothing."""
    table = JobTable(spark, new_path(spark, "jobs"), buckets=8, days=360)
    newest = written(J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY))
    for prefix in ("", "again"):
        jobs = newest.withColumn("id", F.concat(F.lit(prefix), "id"))
        lines = _lines_as_segments(spark, sf_dir, newest.select(F.concat(F.lit(prefix), "id").alias("id"), F.col("id").cast("long").alias("job_key")))
        table.upsert(jobs, NOW, segments=lines)
    return table.segments().select("id", "job_id", "segment_index", "start_ms", "source_text", "status")


@query(_sql(f"select 'job' as kind, id from newest where expires_at >= {NOW} union all select 'segment', n.id || '-' || l_linenumber from newest n join lineitem on l_orderkey = cast(n.id as bigint) where expires_at >= {NOW}", JOBS))
def job_table_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry by leaving out the cells of past days, with their segments."""
    table = JobTable(spark, new_path(spark, "jobs"), buckets=8, days=360)
    newest = written(J.latest_job(A.jobs_from_orders(spark, sf_dir), J.NATURAL_KEY))
    table.upsert(newest, NOW, segments=_lines_as_segments(spark, sf_dir, newest.select("id", F.col("id").cast("long").alias("job_key"))))
    table.expire(NOW)
    return table.jobs().select(F.lit("job").alias("kind"), "id").union(table.segments().select(F.lit("segment"), "id"))


def _arriving(rows: DataFrame, chunk: str, n: int, start: Callable[[DataFrame], object]) -> None:
    """Streams the rows chunk after chunk, each read by a query that is started anew from its checkpoint."""
    spark = rows.sparkSession
    rows, source = written(rows), new_path(spark, "arrivals")
    for k in range(n):
        rows.where(F.col(chunk) == k).drop(chunk).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.drop(chunk).schema).parquet(source)).awaitTermination()


def _each(step: Callable[[DataFrame, int], None], state: str) -> Callable[[DataFrame], object]:
    return lambda stream: stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


_WEEK = "cast(floor((epoch_ms(cast(ts as timestamp)) - 1704067200000) / 604800000) as integer)"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the week in which they arrive."""
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("week", F.floor((F.unix_millis("ts") - 1_704_067_200_000) / 604_800_000).cast("int"))


@query(_sql(f"""select request_id, case when bilingual_json is not null then 'hit' when b.id is not null or w.week > min(w.week) over (partition by {KEY}, v.source_hash) then 'in-progress' else 'new' end as state
  from valid v join (select event_id as request_id, {_WEEK} as week from events) w using (request_id) left join d0 d using ({KEY}) left join (select id, {KEY}, source_hash from newest where status in ('pending', 'translating')) b on """ + " and ".join(f"b.{c} = v.{c}" for c in J.NATURAL_KEY), JOBS, REQUESTS, f"""
d0 as (select {KEY}, bilingual_json from (select *, row_number() over (partition by {KEY} order by created_at desc, id desc) as k from newest where status = 'done') where k = 1)""").replace("partition by video_id, lang, tlang, track, fmt, v.source_hash", "partition by v.video_id, v.lang, v.tlang, v.track, v.fmt, v.source_hash"))
def streaming_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against the job table as they arrive week by week: what one week's batch adds is in progress for the next."""
    table, states = _table_of_orders(spark, sf_dir), new_path(spark, "states")
    e = _weeks(spark, sf_dir)
    requests = A.requests_of(e).join(e.select(F.col("event_id").alias("request_id"), "week"), "request_id")
    _arriving(requests, "week", 5, _each(R.job_arrivals(table, "requests", states, lambda: NOW), new_path(spark, "state")))
    return spark.read.parquet(f"{states}/batch=*").where("state <> 'invalid'").select("request_id", "state")


@query(_sql(f"""select {KEY}, source_hash, epoch_us(ts) as since from (select v.*, cast(e.ts as timestamp) as ts, lag(cast(e.ts as timestamp)) over (partition by {KEY}, source_hash order by e.ts, event_id) as before from valid v join events e on event_id = request_id)
  where before is null or ts > before + interval 1 day""", REQUESTS))
def streaming_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task a key while it is in flight, a day from its last request; a key that returns later starts anew."""
    e = _weeks(spark, sf_dir)
    r = J.validate_requests(A.requests_of(e)).where("error is null").join(e.select(F.col("event_id").alias("request_id"), "week"), "request_id")
    folder = new_path(spark, "tasks")
    _arriving(r.select(*J.NATURAL_KEY, "ts", "week"), "week", 5, _each(R.in_flight_batches(folder, "1 day"), new_path(spark, "state")))
    return spark.read.parquet(f"{folder}/tasks/batch=*").select(*J.NATURAL_KEY, F.unix_micros("since").alias("since"))


@query("""select epoch_us(date_trunc('day', cast(ts as timestamp))) // 1000000 as window_start, case when event_id % 2 = 0 then 'alpha' else 'beta' end as provider, event_type as endpoint, count(*) as calls,
cast(sum(cast(floor(value * 10) as bigint)) as bigint) as tokens, round(sum(value / 1000), 6) as cost_usd from events group by 1, 2, 3""")
def streaming_counters_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters from a stream in which every ninth event comes two weeks late: state is bounded by an hour, late rows are counted apart, none is lost."""
    e = _weeks(spark, sf_dir).withColumn("week", F.when(F.col("event_id") % 9 == 0, F.least(F.lit(4), F.col("week") + 2)).otherwise(F.col("week")))
    calls = e.select("ts", F.when(F.col("event_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"), F.col("event_type").alias("endpoint"), F.floor(F.col("value") * 10).cast("long").alias("token_count"), (F.col("value") / 1000).alias("cost_usd"), "week")
    folder = new_path(spark, "counters")
    _arriving(calls, "week", 5, _each(R.counter_batches(folder, "1 day", "1 hour"), new_path(spark, "state")))
    return R.counters_of(spark, folder).select(F.unix_seconds("window_start").alias("window_start"), "provider", "endpoint", "calls", "tokens", F.round("cost_usd", 6).alias("cost_usd"))


@query(QUERY_OF_SESSIONS)
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of cues that arrive in three parts, up to four seconds out of order, with ten seconds of state."""
    c = A.cues_from_documents(spark, sf_dir).withColumn("at", F.col("start_ms") + F.pmod(F.xxhash64("track_id", "cue_index"), F.lit(5)) * 1000)
    c = c.select("track_id", F.timestamp_millis(F.col("start_ms").cast("long")).alias("ts"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.when(F.col("at") < 30_000, 0).when(F.col("at") < 120_000, 1).otherwise(2).alias("part"))
    # a last row of no track moves the watermark past all others
    last = c.agg(F.max("ts")).select(F.lit("").alias("track_id"), (F.coalesce(F.max("max(ts)"), F.timestamp_millis(F.lit(0))) + F.expr("interval 1 day")).alias("ts"), F.lit(0.0).alias("duration_ms"), F.lit(3).alias("part"))
    folder, state = new_path(spark, "sessions"), new_path(spark, "state")

    def start(cues: DataFrame):  # noqa: ANN202
        return R.gap_sessions(cues, delay="10 seconds").writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()

    _arriving(c.unionByName(last), "part", 4, start)
    return spark.read.parquet(folder).select("track_id", F.unix_millis("session_start").alias("session_start"), F.unix_millis("session_end").alias("session_end"), "n")
