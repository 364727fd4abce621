"""What a change of the job table costs: what it is given is made once, and jobs pass through few shuffles, each column once."""

from pyspark.sql import functions as F

from subweave.operators import jobs as J
from subweave.sources.job_table import JobTable
from subweave.streaming.requests import classify_requests
from tests.test_job_table import NOW, jobs_of, lines_of, requests_of


def counted(spark, rows, column):
    """rows whose column counts how often it is made."""
    n = spark.sparkContext.accumulator(0)

    def same(x):
        n.add(1)
        return x

    return rows.withColumn(column, F.udf(same, "string").asNondeterministic()(column)), n


def test_edited_jobs_are_made_once(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/t", buckets=2)
    table.upsert(jobs_of(spark, 20), NOW)
    made = []

    def edit(jobs):
        out, n = counted(spark, jobs.withColumn("status", F.when(F.col("id") == "pending3", "failed").otherwise(F.col("status"))), "status")
        made.append(n)
        return out

    table.change(jobs_of(spark, 20), edit)
    assert [n.value for n in made] == [20]
    assert table.jobs().where("status = 'failed'").count() == 1 and table.jobs().count() == 20
    assert not [x for x in (tmp_path / "t" / "edited").glob("*")]  # nothing of it is left


def test_segments_are_made_once(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/t", buckets=2)
    for text in ("x", "y"):
        rows, n = counted(spark, lines_of(spark, [f"pending{k}" for k in range(10)], text), "job_id")
        table.upsert(jobs_of(spark, 20), NOW, segments=rows)
        assert n.value == 20
    table.upsert(jobs_of(spark, 20), NOW, segments=lines_of(spark, ["pending4"], "z"))
    got = sorted((r.job_id, r.source_text) for r in table.segments().collect())
    assert got == sorted((f"pending{k}", "z" if k == 4 else "y") for k in range(10) for _ in range(2))


def test_requests_are_classified_by_the_columns_that_count(spark):
    jobs = jobs_of(spark, 2, status="done").unionByName(jobs_of(spark, 2, first=2)).unionByName(jobs_of(spark, 1, first=2, status="failed").withColumns({"created_at": F.lit(NOW - 5), "updated_at": F.lit(NOW)}))
    requests = requests_of(spark, [(0, 0, 0), (1, 1, 2), (2, 2, 7)])
    states = lambda d: sorted((r.request_id, r.state) for r in d.collect())
    assert states(classify_requests(requests, jobs)) == [(0, "hit"), (1, "in-progress"), (2, "new")]
    one = classify_requests(requests, jobs.where("status <> 'failed'"), unique=True)
    assert states(one) == [(0, "hit"), (1, "in-progress"), (2, "new")]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_the_newest_job_passes_each_column_once(spark):
    jobs = jobs_of(spark, 3).unionByName(jobs_of(spark, 1, status="done").withColumn("created_at", F.lit(NOW + 1))).unionByName(jobs_of(spark, 1, first=1, status="zdone"))
    newest = J.latest_job(jobs, J.NATURAL_KEY)
    assert newest.columns == jobs.columns
    assert sorted(r.id for r in newest.collect()) == ["done0", "pending2", "zdone1"]
    assert "max_by" not in newest._jdf.queryExecution().optimizedPlan().toString()
