"""What the operators share: written intermediate tables, column checks and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}  # of applications without the setting


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        path = _OWN.setdefault(name, "") or "file://" + tempfile.mkdtemp(prefix="subweave-")
        _OWN[name] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the table is written to the shared folder and read again, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) links -> (id, component): each linked id with the smallest id that it reaches.

    Alternating large-star and small-star rounds: every id points its neighbours to its smallest neighbour, by partial
    minimum and join, so a hub with very many links is never gathered in one place. Null ends take no part; repeated
    links and links of an id to itself change nothing; no links give no rows. Rounds stop when no link changes.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    last = None
    for _ in range(rounds):
        two_way = both(state)
        least = two_way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two_way.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: an id and its smaller neighbours all point to the smallest of them
        smaller = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(smaller, "b")
        new = star.select(F.col("m").alias("a"), "b").union(star.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")).distinct()
        new = written(new.coalesce(8 + last["n"] // 50_000) if last else new, "links")  # few links need few files
        digest = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(state)
        state = new
        if last == digest:
            break
        last = digest
    else:
        raise RuntimeError("links did not settle")
    return state.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(state.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
