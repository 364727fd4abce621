"""The job table by cells and manifests, and the streams that carry bounded state from batch to batch."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from subweave.operators import jobs as J
from subweave.schemas import JOB
from subweave.sources.job_table import DAY_MS, Conflict, JobTable
from subweave.sources.sinks import segments
from subweave.streaming import requests as R

NOW = 1_000 * DAY_MS + 5000


def jobs_of(spark, n, first=0, status="pending", expires=lambda k: NOW + DAY_MS):
    rows = [(f"{status}{k}", f"v{k:010d}", "en", "zh-CN", "asr", "json3", "0", status, 0, None, None, None, f"r{k}" if status == "done" else None, NOW, NOW, expires(k)) for k in range(first, first + n)]
    return spark.createDataFrame(rows, JOB)


def held(table, *columns):
    return sorted(tuple(r) for r in table.jobs().select(*(columns or ("id", "status", "updated_at"))).collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_a_change_writes_the_cells_it_hits(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/t", buckets=32)
    assert table.version() == 0 and table.jobs().count() == 0 and table.segments().count() == 0
    table.upsert(jobs_of(spark, 4000), NOW)
    whole = size(tmp_path / "t" / "data")
    table.upsert(jobs_of(spark, 1, first=77, status="done"), NOW + 1)
    assert size(tmp_path / "t" / "data") - whole < whole / 10
    assert held(table)[77:79] != [] and ("pending77", "done", NOW + 1) in held(table) and len(held(table)) == 4000
    before = size(tmp_path / "t" / "data")
    table.upsert(jobs_of(spark, 1, first=9000), NOW)
    assert size(tmp_path / "t" / "data") - before < whole / 10 and table.jobs().count() == 4001 and table.version() == 3
    assert table.jobs(1).where("status = 'done'").count() == 0  # an older version is still there
    assert table.vacuum(versions=1) >= 1
    assert ("pending77", "done", NOW + 1) in held(table) and table.jobs().count() == 4001


def test_updates_and_retries_are_those_of_the_plain_functions(spark, tmp_path):
    table, jobs = JobTable(spark, f"file://{tmp_path}/t", buckets=4), jobs_of(spark, 50)
    table.upsert(jobs, NOW)
    updates = jobs.where("id in ('pending3', 'pending8')").select(*J.NATURAL_KEY, F.lit("failed").alias("new_status"), F.lit("E").alias("error_code"), F.lit("m").alias("error_message"), F.lit(None).cast("string").alias("result"))
    table.update_status(updates, NOW + 7)
    table.schedule_retry(updates, NOW + 7)
    want = J.schedule_retry(J.update_job_status(jobs, updates, NOW + 7), updates, NOW + 7)
    assert held(table, *jobs.columns) == sorted(tuple(r) for r in want.collect())
    version = table.version()
    table.upsert(jobs.limit(0), NOW)
    assert table.version() == version + 1 and table.jobs().count() == 50


def test_two_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one, two = JobTable(spark, path, buckets=2), JobTable(spark, path, buckets=2)
    one.upsert(jobs_of(spark, 3), NOW)
    stale, real = one.manifest(), two.manifest
    one.upsert(jobs_of(spark, 1, first=10), NOW)
    seen = iter([stale])
    monkeypatch.setattr(two, "manifest", lambda version=None: next(seen, None) or real(version))
    two.upsert(jobs_of(spark, 1, first=20), NOW)
    assert [x[0] for x in held(one)] == ["pending0", "pending1", "pending10", "pending2", "pending20"]
    monkeypatch.setattr(two, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        two.upsert(jobs_of(spark, 1, first=30), NOW)
    assert len(held(one)) == 5


def lines_of(spark, ids, text="x"):
    rows = [(i, k, 1000.0 * k, 1000.0 * k + 900, text, text if k else None) for i in ids for k in range(2)]
    return segments(spark.createDataFrame(rows, "job_id string, cue_index int, start_ms double, end_ms double, source_text string, translated_text string"), NOW)


def test_segments_go_with_their_jobs(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/t", buckets=3)
    table.upsert(jobs_of(spark, 20), NOW, segments=lines_of(spark, [f"pending{k}" for k in range(10)]))
    ids = lambda: sorted((r.id, r.job_id, r.source_text, r.status) for r in table.segments().collect())
    assert len(ids()) == 20 and ids()[0] == ("pending0-0", "pending0", "x", "pending")
    first = ids()
    # again under the ids of a later request: the table keeps its own
    again = jobs_of(spark, 10, status="done")
    table.upsert(again, NOW, segments=lines_of(spark, [f"done{k}" for k in range(10)]))
    assert ids() == first and table.jobs().where("status = 'done'").count() == 10
    table.upsert(again, NOW, segments=lines_of(spark, ["done4"], "y"))
    assert {x for x in ids() if x not in first} == {("pending4-0", "pending4", "y", "pending"), ("pending4-1", "pending4", "y", "done")} and len(ids()) == 20
    # a change without segments leaves those of the cells it rewrites
    table.upsert(jobs_of(spark, 1, first=4), NOW + 9)
    assert len(ids()) == 20


def test_expiry(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/t", buckets=2)
    when = {0: NOW - 3 * DAY_MS, 1: NOW - 1, 2: NOW, 3: NOW + 1, 4: NOW + DAY_MS, 5: None}
    table.upsert(jobs_of(spark, 6, expires=lambda k: when[k]), NOW, segments=lines_of(spark, [f"pending{k}" for k in range(6)]))
    table.expire(NOW)
    assert [x[0] for x in held(table)] == [f"pending{k}" for k in (2, 3, 4, 5)]
    assert {r.job_id for r in table.segments().collect()} == {f"pending{k}" for k in (2, 3, 4, 5)}
    # whole days go without any file being written
    before = size(tmp_path / "t" / "data")
    table.expire((NOW // DAY_MS + 1) * DAY_MS)
    assert [x[0] for x in held(table)] == ["pending4", "pending5"] and size(tmp_path / "t" / "data") == before
    version = table.version()
    assert table.expire(NOW) == version


START = datetime(2024, 1, 1)


def requests_of(spark, rows):
    return spark.createDataFrame([(n, START + timedelta(minutes=m), f"v{v:010d}", "en", None, None, None, "0") for n, m, v in rows], "request_id int, ts timestamp, v string, lang string, tlang string, kind string, fmt string, source_hash string")


def run(spark, source, schema, step, state):
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("crash", [False, True])
def test_requests_as_a_stream_that_crashes_after_its_commit(spark, tmp_path, crash):
    table, path = JobTable(spark, f"file://{tmp_path}/t", buckets=2), f"file://{tmp_path}"
    table.upsert(jobs_of(spark, 2, status="done").unionByName(jobs_of(spark, 2, first=2)), NOW)
    parts = [[(0, 0, 0), (1, 1, 2), (2, 2, 7), (3, 3, 7)], [(4, 4, 7), (5, 5, 8), (6, 6, 1)]]
    arrivals = R.job_arrivals(table, "s", f"{path}/states", lambda: NOW)
    fail = [crash, crash]

    def step(batch, epoch):
        arrivals(batch, epoch)
        if fail and fail.pop():
            raise RuntimeError("the driver is gone")

    for part in parts:
        rows = requests_of(spark, part)
        rows.write.mode("append").parquet(f"{path}/in")
        for _ in range(2):
            try:
                run(spark, f"{path}/in", rows.schema, step, f"{path}/state")
                break
            except Exception as e:  # noqa: BLE001
                assert "the driver is gone" in str(e)
    got = {r.request_id: r.state for r in spark.read.parquet(f"{path}/states/batch=*").collect()}
    assert got == {0: "hit", 1: "in-progress", 2: "new", 3: "new", 4: "in-progress", 5: "new", 6: "hit"}
    assert sorted(r.video_id for r in table.jobs().collect()) == [f"v{k:010d}" for k in (0, 1, 2, 3, 7, 8)]
    assert table.manifest()["applied"]["s"][0] == 1


def test_keys_in_flight(spark, tmp_path):
    path = f"{tmp_path}/f"
    step = R.in_flight_batches(path, "10 minutes")
    minutes = [[(0, 1), (3, 1), (9, 1), (0, 2), (25, 3)], [(19, 1), (26, 2)], [(29, 1), (40, 1), (45, 9), (20, 3)]]
    state = []
    for epoch, rows in enumerate(minutes):
        batch = J.validate_requests(requests_of(spark, [(0, m, v) for m, v in rows]))
        for _ in range(2):  # a batch that comes again changes nothing
            step(batch, epoch)
        state.append(spark.read.parquet(f"{path}/state/batch={epoch}").count())
    begun = sorted((int(r.video_id[1:]), int((r.since - START).total_seconds() // 60)) for r in spark.read.parquet(f"{path}/tasks/batch=*").collect())
    # 1: asked every ten minutes at most until 29, anew at 40; 2 anew at 26; 3 came late, in flight
    assert begun == [(1, 0), (1, 19), (1, 40), (2, 0), (2, 26), (3, 25), (9, 45)] or begun == [(1, 0), (1, 40), (2, 0), (2, 26), (3, 25), (9, 45)]
    assert state == [1, 3, 2] and not os.path.exists(f"{path}/state/batch=0")


def test_counters_keep_late_rows_and_little_state(spark, tmp_path):
    path = f"{tmp_path}/c"
    step = R.counter_batches(path, "1 day", "1 hour")
    call = lambda hours, n: [(START + timedelta(hours=h), "p", "e", n, 0.5) for h in hours]
    batches = [call([1, 23], 1), call([30, 49], 10), call([2, 50], 100), [], call([120, 3], 1000)]
    for epoch, rows in enumerate(batches):
        for _ in range(2):
            step(spark.createDataFrame(rows, "ts timestamp, provider string, endpoint string, token_count long, cost_usd double"), epoch)
    day = lambda rows: {(r.window_start - START).days: (r.calls, r.tokens) for r in rows}
    assert day(R.counters_of(spark, path).collect()) == {0: (4, 1102), 1: (1, 10), 2: (2, 110), 5: (1, 1000)}
    assert day(spark.read.parquet(f"{path}/late/batch=2").collect()) == {0: (1, 100)} and day(spark.read.parquet(f"{path}/late/batch=4").collect()) == {0: (1, 1000)}
    assert spark.read.parquet(f"{path}/open/batch=4").where("window_start is not null").count() == 1
    assert not os.path.exists(f"{path}/open/batch=2")
