"""The table of translation jobs: requests against it, changes to it, counts over it.

A job's natural key is its five request columns and the hash of its source. Updates go by that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subweave.functions.text import request_error, trimmed
from subweave.operators.timing import round_half_up
from subweave.params import Params
from subweave.schemas import JOB_KEY

NATURAL_KEY = [*JOB_KEY, "source_hash"]


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests (v, lang, tlang, kind, fmt) + the key columns with their defaults and error (null where valid)."""
    filled = {"video_id": F.col("v"), "tlang": F.coalesce("tlang", F.lit("zh-CN")), "track": F.coalesce("kind", F.lit("asr")), "fmt": F.coalesce("fmt", F.lit("json3"))}
    return requests.withColumns(filled).withColumn("error", request_error(F.col("v"), F.col("lang")))


def latest_job(jobs: DataFrame, keys: list[str], status: str | None = None) -> DataFrame:
    """The newest job of each key (ties to the greatest id), by partial maximum rather than by sorting every key's history."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    order = ["created_at", "id"]
    newest = F.max(F.struct(*order, *[c for c in jobs.columns if c not in [*keys, *order]]))  # what passes through the shuffle holds no column twice
    return rows.groupBy(*keys).agg(newest.alias("j")).select(*[F.col(c) if c in keys else F.col(f"j.{c}") for c in jobs.columns])


def lookup_cached(requests: DataFrame, jobs: DataFrame, check_expiry: bool = False, now_ms: int | None = None) -> DataFrame:
    """requests + cache_status (hit or miss) and result, from the newest finished job of their five key columns; a job without a result is a miss."""
    done = latest_job(jobs, JOB_KEY, "done")
    if check_expiry:
        done = done.where(F.col("expires_at") >= now_ms)
    out = requests.join(done.select(*JOB_KEY, F.col("bilingual_json").alias("result")), JOB_KEY, "left")
    return out.withColumn("cache_status", F.when(F.col("result").isNotNull(), "hit").otherwise("miss"))


def plan_new_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each natural key of the requests, without those whose newest job is pending or in work."""
    busy = latest_job(jobs, NATURAL_KEY).where(F.col("status").isin("pending", "translating")).select(*NATURAL_KEY)
    return requests.select(*NATURAL_KEY).dropDuplicates().join(busy, NATURAL_KEY, "left_anti")


def new_jobs(planned: DataFrame, now_ms: int, params: Params | None = None) -> DataFrame:
    """Pending jobs for planned keys."""
    p = params or Params()
    now = F.lit(now_ms).cast("long")
    none = lambda t: F.lit(None).cast(t)
    return planned.select(
        F.sha2(F.concat_ws("|", *NATURAL_KEY), 256).alias("id"), *NATURAL_KEY, F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), none("long").alias("next_retry_at"), none("string").alias("error_code"),
        none("string").alias("error_message"), none("string").alias("bilingual_json"), now.alias("created_at"), now.alias("updated_at"), (now + p.ttl_ms).alias("expires_at"),
    )


def job_status_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "pending", "failed")])


def cache_hit_rate(lookups: DataFrame) -> DataFrame:
    """hits, misses and hit_rate in per cent with two decimals, 0 without requests."""
    hits, n = F.count_if(F.col("cache_status") == "hit"), F.count(F.lit(1))
    return lookups.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n == 0, 0.0).otherwise(round_half_up(hits / n * 10000) / 100).alias("hit_rate"))


def merge_counters(counters: DataFrame, increments: DataFrame) -> DataFrame:
    """(key, value, updated_at): values added by key, newest time kept."""
    return counters.unionByName(increments).groupBy("key").agg(F.sum("value").alias("value"), F.max("updated_at").alias("updated_at"))


def api_usage_daily(calls: DataFrame) -> DataFrame:
    """Requests, tokens, cost and mean latency by provider, endpoint and day."""
    return calls.groupBy("provider", "endpoint", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("requests"), F.sum("token_count").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.avg("latency_ms").alias("avg_latency_ms"))


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def due_jobs(jobs: DataFrame, now_ms: int, max_retries: int = 3, n: int = 10) -> DataFrame:
    """The oldest n jobs that wait or failed, have retries left and whose time has come."""
    due = F.col("status").isin("pending", "failed") & (F.col("retry_count") < max_retries) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now_ms))
    return jobs.where(due).orderBy("created_at", "id").limit(n)


def upsert_jobs(jobs: DataFrame, incoming: DataFrame, now_ms: int) -> DataFrame:
    """Adds jobs; where the natural key is there already, only status, result and updated_at change, and the old id stays. incoming: one row a key."""
    rest = [c for c in jobs.columns if c not in NATURAL_KEY]
    new = incoming.select(*NATURAL_KEY, F.struct(*rest).alias("new"))
    old = jobs.select(*NATURAL_KEY, F.struct(*rest).alias("old"))
    both = old.join(new, NATURAL_KEY, "full")

    def value(c: str) -> Column:
        kept = F.col(f"old.{c}")
        if c in ("status", "bilingual_json"):
            kept = F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(kept)
        elif c == "updated_at":
            kept = F.when(F.col("new").isNotNull(), F.lit(now_ms).cast("long")).otherwise(kept)
        return F.when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(kept).alias(c)

    return both.select(*[value(c) if c in rest else F.col(c) for c in jobs.columns])


def update_job_status(jobs: DataFrame, updates: DataFrame, now_ms: int) -> DataFrame:
    """updates: natural key, new_status, error_code, error_message, result. With an error the result is kept; without one it is replaced and the error cleared."""
    u = updates.select(*NATURAL_KEY, "new_status", F.col("error_code").alias("new_code"), F.col("error_message").alias("new_message"), "result", F.lit(True).alias("changed"))
    j = jobs.join(u, NATURAL_KEY, "left")
    changed, failed = F.col("changed").isNotNull(), F.col("new_code").isNotNull()
    pick = lambda c, new: F.when(changed, new).otherwise(F.col(c)).alias(c)
    new = {
        "status": pick("status", F.col("new_status")), "error_code": pick("error_code", F.col("new_code")), "error_message": pick("error_message", F.col("new_message")),
        "bilingual_json": F.when(changed & ~failed, F.col("result")).otherwise(F.col("bilingual_json")).alias("bilingual_json"), "updated_at": pick("updated_at", F.lit(now_ms).cast("long")),
    }
    return j.select(*[new.get(c, F.col(c)) for c in jobs.columns])


def schedule_retry(jobs: DataFrame, failed_keys: DataFrame, now_ms: int, base_ms: int = 5000) -> DataFrame:
    """Counts a retry of the failed keys; each waits twice as long as the one before."""
    j = jobs.join(failed_keys.select(*NATURAL_KEY).distinct().withColumn("hit", F.lit(True)), NATURAL_KEY, "left")
    hit = F.col("hit").isNotNull()
    wait = (F.lit(now_ms) + base_ms * F.pow(F.lit(2.0), F.col("retry_count"))).cast("long")
    new = {"retry_count": F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"), "next_retry_at": F.when(hit, wait).otherwise(F.col("next_retry_at")).alias("next_retry_at")}
    return j.select(*[new.get(c, F.col(c)) for c in jobs.columns])


def expire_jobs(jobs: DataFrame, segments: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without expired jobs and their segments."""
    kept = jobs.where(F.col("expires_at") >= now_ms)
    return kept, segments.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(*segments.columns)


def validate_cues(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, ok): tracks with cues, all of them with start >= 0, end >= start and text."""
    good = (F.col("start_ms") >= 0) & (F.col("end_ms") >= F.col("start_ms")) & (trimmed(F.col("text")) != "")
    ok = cues.groupBy("track_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("ok"))
    return tracks.select("track_id").distinct().join(ok, "track_id", "left").select("track_id", F.coalesce("ok", F.lit(False)).alias("ok"))


def rejected_cues(cues: DataFrame) -> DataFrame:
    bad = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | (trimmed(F.col("text")) == "")
    return cues.where(F.coalesce(bad, F.lit(True)))

