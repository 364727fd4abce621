"""Arrival work as Structured Streaming: one task a key, hits and misses, counters, sessions.

The functions of a stream drop late rows by their watermark; those for foreachBatch keep them, carry bounded state from batch to
batch in the shared folder, and give the same when a batch comes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subweave.operators.jobs import NATURAL_KEY, latest_job, new_jobs, validate_requests
from subweave.schemas import JOB_KEY
from subweave.sources.job_table import JobTable
from subweave.sources.shared import deleted, exists, file_system, new_path


def dedupe_in_flight(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first request of each natural key within the delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(NATURAL_KEY)


def classify_requests(requests: DataFrame, jobs: DataFrame, unique: bool = False) -> DataFrame:
    """requests + state: invalid, hit, in-progress or new, against a static job table. unique: jobs have one row a natural key, as in a JobTable."""
    made = jobs.where("status = 'done'").select(*JOB_KEY, "created_at", "id", F.col("bilingual_json").isNotNull().alias("made"))
    done = latest_job(made, JOB_KEY).where("made").select(*JOB_KEY, F.lit(True).alias("is_done"))
    newest = jobs if unique else latest_job(jobs.select(*NATURAL_KEY, "created_at", "id", "status"), NATURAL_KEY)
    busy = newest.where(F.col("status").isin("pending", "translating")).select(*NATURAL_KEY, F.lit(True).alias("is_busy"))
    out = validate_requests(requests).join(done, JOB_KEY, "left").join(busy, NATURAL_KEY, "left")
    state = F.when(F.col("error").isNotNull(), "invalid").when(F.col("is_done"), "hit").when(F.col("is_busy"), "in-progress").otherwise("new")
    return out.withColumn("state", state).drop("is_done", "is_busy")


def job_arrivals(table: JobTable, name: str, states: str, now_ms: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over requests: classifies a batch against the newest job table and adds a pending job for every new key.

    What became of each request is written to the folder `states`, one folder a batch. A batch that comes again after a crash finds in the
    table's manifest that the stream `name` has applied it, classifies by the version that it saw the first time, and adds nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        last, before = table.manifest()["applied"].get(name, [-1, 0])
        jobs = table.jobs(before if last == epoch else None)
        place = f"{states}/batch={epoch}"
        classify_requests(batch, jobs, unique=True).write.mode("overwrite").parquet(place)
        # no key of a new request is busy, as its state says
        fresh = batch.sparkSession.read.parquet(place).where("state = 'new'").select(*NATURAL_KEY).dropDuplicates()
        now, added = now_ms(), new_path(batch.sparkSession, "added")
        new_jobs(fresh, now).write.parquet(added)
        try:
            table.upsert(batch.sparkSession.read.parquet(added), now, applied=(name, epoch))
        finally:
            deleted(batch.sparkSession, added)

    return run


def windowed_counters(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost of each provider and endpoint by tumbling window of the event time."""
    return _counted(events.withWatermark("ts", delay), window)


def _counted(events: DataFrame, window: str) -> DataFrame:
    e = events.groupBy(F.window("ts", window).alias("w"), "provider", "endpoint")
    out = e.agg(F.count(F.lit(1)).alias("calls"), F.sum("token_count").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    return out.select(F.col("w.start").alias("window_start"), "provider", "endpoint", "calls", "tokens", "cost_usd")


COUNTERS = "window_start timestamp, provider string, endpoint string, calls long, tokens long, cost_usd double"


def counter_batches(path: str, window: str = "1 day", delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over calls: counters by window in bounded state, without losing late rows.

    A window is open until the greatest time of all earlier batches is later than its end by the delay. Each batch adds to the open
    windows' counters (folder open), appends those that it closes (closed) and diverts what comes for closed windows (late). A
    batch's folders are overwritten if it comes again; the open counters, all that is carried on, are those within the delay.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = lambda kind, n: f"{path}/{kind}/batch={n}"
        carried = spark.read.parquet(place("open", epoch - 1)) if epoch and exists(spark, place("open", epoch - 1)) else spark.createDataFrame([], COUNTERS + ", seen timestamp")
        seen = carried.agg(F.max("seen")).first()[0]
        ends = F.col("window_start") + F.expr(f"interval {window}")
        closed = F.lit(False) if seen is None else ends <= F.lit(seen) - F.expr(f"interval {delay}")
        rows = batch.select("ts", "provider", "endpoint", "token_count", "cost_usd")
        counted = _counted(rows, window).withColumn("late", closed)
        counted.where("late").drop("late").write.mode("overwrite").parquet(place("late", epoch))
        newest = rows.agg(F.max("ts")).first()[0]
        newest = max(x for x in (seen, newest) if x is not None) if seen or newest else None
        sums = carried.where("window_start is not null").drop("seen").unionByName(counted.where("not late").drop("late"))
        sums = sums.groupBy("window_start", "provider", "endpoint").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "cost_usd")])
        shut = F.lit(False) if newest is None else ends <= F.lit(newest) - F.expr(f"interval {delay}")
        sums.where(shut).write.mode("overwrite").parquet(place("closed", epoch))
        mark = spark.createDataFrame([(newest,)], "seen timestamp")
        still = sums.where(~shut).withColumn("seen", F.lit(newest).cast("timestamp"))
        still.unionByName(mark, allowMissingColumns=True).write.mode("overwrite").parquet(place("open", epoch))
        deleted(spark, place("open", epoch - 2))

    return run


def counters_of(spark: SparkSession, path: str) -> DataFrame:
    """All counters so far of counter_batches: closed and late ones, and those of the windows that are still open, added up by key."""
    last = max(int(f.split("batch=")[1]) for f in _folders(spark, f"{path}/open"))
    read = spark.read.schema(COUNTERS)
    rows = read.parquet(*[f"{path}/{kind}/batch=*" for kind in ("closed", "late")]).unionByName(read.parquet(f"{path}/open/batch={last}"))
    return rows.where("window_start is not null").groupBy("window_start", "provider", "endpoint").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "cost_usd")])


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, place = file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)]


IN_FLIGHT = "video_id string, lang string, tlang string, track string, fmt string, source_hash string, last timestamp"


def in_flight_batches(path: str, delay: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over valid requests (natural key, ts): one task for each key while it is in flight.

    A key is in flight until the delay has passed since its last request; a request after that begins a new task (folder tasks: the
    key and since). State (folder state) are the keys that were asked for within the delay of the greatest time seen. A row that
    comes late begins a task only if its key isn't in the state.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = lambda kind, n: f"{path}/{kind}/batch={n}"
        state = spark.read.schema(IN_FLIGHT).parquet(place("state", epoch - 1)) if epoch and exists(spark, place("state", epoch - 1)) else spark.createDataFrame([], IN_FLIGHT)
        wait = F.expr(f"interval {delay}")
        # rows in one window of the delay's length are one burst, so a key that very many rows have is few rows
        bursts = batch.groupBy(*NATURAL_KEY, F.window("ts", delay).alias("w")).agg(F.min("ts").alias("since"), F.max("ts").alias("to")).drop("w")
        before = F.coalesce(F.lag("to").over(Window.partitionBy(*NATURAL_KEY).orderBy("since")), F.col("last"))
        fresh = bursts.join(state, NATURAL_KEY, "left").withColumn("before", before)
        fresh.where(F.col("before").isNull() | (F.col("since") > F.col("before") + wait)).select(*NATURAL_KEY, "since").write.mode("overwrite").parquet(place("tasks", epoch))
        last = state.unionByName(bursts.select(*NATURAL_KEY, F.col("to").alias("last"))).groupBy(*NATURAL_KEY).agg(F.max("last").alias("last"))
        seen = last.agg(F.max("last")).first()[0]
        kept = last if seen is None else last.where(F.col("last") + wait >= F.lit(seen))
        kept.write.mode("overwrite").parquet(place("state", epoch))
        deleted(spark, place("state", epoch - 2))

    return run


def gap_sessions(cues: DataFrame, gap_ms: int = 1200, delay: str = "1 minute") -> DataFrame:
    """Sessions of a track's cues: a gap of more than gap_ms after a cue's end begins a new one. cues: track_id, ts (start), duration_ms."""
    gap = F.concat(F.ceil(F.col("duration_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    s = cues.withWatermark("ts", delay).groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("track_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
