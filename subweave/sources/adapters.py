"""Caption tables from general tables: lines of documents as cues, orders as jobs, events as requests and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gap(k):  # noqa: ANN001, ANN202
    return F.when(k % 7 == 6, 1500).when(k % 5 == 4, 1100).when(k % 3 == 2, -150).otherwise(0)


CHARS = 1 << 21  # characters in a partition of documents


def spread_by_text(docs: DataFrame) -> DataFrame:
    """docs (track_id, text) dealt by track, in as many partitions as their text needs.

    Lines and words take many times the room of the text that they come from, and all that works on tracks stays in these
    partitions. Their number is given, as those that Spark chooses by the size of the text would be too large for the words.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores * max(1, -(-chars // (CHARS * cores))), "track_id")  # whole waves of tasks


def cues_from_documents(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A cue for each line with text, 60 ms a character, with gaps and overlaps by number."""
    d = spread_by_text(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("track_id"), "text", *extra))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    c = d.select("track_id", *extra, F.posexplode(lines).alias("cue_index", "text"))
    duration = F.greatest(F.lit(400), 60 * F.length("text")).cast("double")
    w = Window.partitionBy("track_id").orderBy("cue_index")
    c = c.withColumns({"d": duration, "g": _gap(F.col("cue_index")).cast("double")})
    start = F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("start_ms", F.greatest(F.lit(0.0), start))
    return c.select("track_id", "cue_index", "start_ms", (F.col("start_ms") + F.col("d")).alias("end_ms"), "text", *extra)


def events_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timed-text event for each line, its words 300 ms apart, and an appending one with a line feed after each."""
    c = cues_from_documents(spark, sf_dir).withColumn("words", F.filter(F.split("text", " "), lambda x: x != ""))  # used in several places
    words = F.col("words")
    segs = F.transform(words, lambda x, i: F.struct(F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)).alias("utf8"), (i * 300).cast("double").alias("t_offset_ms")))
    n = F.size(words)
    line = F.struct((F.col("cue_index") * 2).alias("event_index"), F.col("start_ms").alias("t_start_ms"), (300 * n + 500).cast("double").alias("d_duration_ms"), F.lit(1).alias("w_win_id"), F.lit(None).cast("int").alias("a_append"), segs.alias("segs"))
    feed = F.array(F.struct(F.lit("\n").alias("utf8"), F.lit(0.0).alias("t_offset_ms")))
    more = F.struct((F.col("cue_index") * 2 + 1).alias("event_index"), (F.col("start_ms") + 300 * n + 490).alias("t_start_ms"), F.lit(10.0).alias("d_duration_ms"), F.lit(1).alias("w_win_id"), F.lit(1).alias("a_append"), feed.alias("segs"))
    return c.select("track_id", F.explode(F.array(line, more)).alias("e")).select("track_id", "e.*")


def raw_from_events(events: DataFrame) -> DataFrame:
    """(track_id, payload): the events as timed-text JSON documents."""
    segs = F.transform("segs", lambda s: F.struct(s["utf8"].alias("utf8"), s["t_offset_ms"].alias("tOffsetMs")))
    e = F.struct("event_index", F.struct(F.col("t_start_ms").alias("tStartMs"), F.col("d_duration_ms").alias("dDurationMs"), F.col("w_win_id").alias("wWinId"), F.col("a_append").alias("aAppend"), segs.alias("segs")).alias("e"))
    whole = events.groupBy("track_id").agg(F.array_sort(F.collect_list(e)).alias("es"))
    return whole.select("track_id", F.to_json(F.struct(F.transform("es", lambda x: x["e"]).alias("events"))).alias("payload"))


def jobs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, created = F.col("o_custkey"), F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1970-01-01"))).cast("long") * 86_400_000
    status = F.when(key % 10 == 0, "translating").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    lang = F.when(F.substring("o_orderpriority", 1, 1) == "1", "en").when(F.substring("o_orderpriority", 1, 1) == "2", "fr").when(F.substring("o_orderpriority", 1, 1) == "3", "de").otherwise("es")
    fmt = F.when(key % 3 == 0, "json3").when(key % 3 == 1, "vtt").otherwise("srv3")
    retries = (F.col("o_orderkey") % 5).cast("int")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("v"), F.lpad(key.cast("string"), 10, "0")).alias("video_id"), lang.alias("lang"), F.lit("zh-CN").alias("tlang"), F.when(key % 2 == 0, "asr").otherwise("manual").alias("track"), fmt.alias("fmt"),
        (key % 3).cast("string").alias("source_hash"), status.alias("status"), retries.alias("retry_count"), F.when(key % 3 != 0, created + 5000).alias("next_retry_at"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
        F.when((F.col("o_orderstatus") == "F") & (key % 4 != 0), F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("bilingual_json"), created.alias("created_at"), created.alias("updated_at"), (created + 30 * 86_400_000).alias("expires_at"),
    )


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as requests."""
    user, n = F.col("user_id"), F.col("event_id")
    video = F.when(n % 50 == 0, "v1234").otherwise(F.concat(F.lit("v"), F.lpad(user.cast("string"), 10, "0")))
    lang = F.when(n % 70 == 0, F.lit(None)).when(n % 4 == 0, "en").when(n % 4 == 1, "fr").when(n % 4 == 2, "de").otherwise("es")
    fmt = F.when(user % 3 == 0, F.lit(None)).when(user % 3 == 1, "vtt").otherwise("srv3")
    return e.select(n.alias("request_id"), "ts", video.alias("v"), lang.alias("lang"), F.lit(None).cast("string").alias("tlang"), F.when(user % 2 == 0, F.lit(None).cast("string")).otherwise("manual").alias("kind"), fmt.alias("fmt"), (user % 3).cast("string").alias("source_hash"))


def calls_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.when(F.col("event_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"), F.col("event_type").alias("endpoint"), F.floor(F.col("value") * 10).cast("long").alias("token_count"), (F.col("value") / 1000).alias("cost_usd"), (F.col("event_id") % 500).cast("long").alias("latency_ms"))


def bilingual_from_conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as originals and the assistant turns that answer them as translations, 50 ms a character."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("track_id"), "turn", "role", "text")
    w = Window.partitionBy("track_id").orderBy("turn")
    c = c.withColumns({"answer": F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)), "at": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 50.0})
    c = c.where("role = 'user' and answer is not null")
    c = c.withColumn("cue_index", F.row_number().over(w) - 1)
    cues = c.select("track_id", "cue_index", F.col("at").alias("start_ms"), (F.col("at") + 50.0 * F.length("text")).alias("end_ms"), "text", "answer")
    return cues.drop("answer"), cues.select("track_id", "cue_index", "start_ms", "end_ms", F.col("answer").alias("text"))
