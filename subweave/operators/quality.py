"""Caption quality by group, and the cues to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.functions.text import CONNECTOR_END, LEADING_PUNCTUATION, MARK, PUNCTUATION_ONLY, blanks_of, collapsed, first, is_cjk, last, odd_blanks, trimmed, trimmed_column, unless_blank, visible_length, word_count
from subweave.operators.timing import cue_gaps


def _measured(cues: DataFrame) -> DataFrame:
    t, odd, blanks = F.col("t"), F.col("odd"), F.col("blanks")
    # columns one after the other, each computed once; without odd blanks, visible characters and words follow from the number of blanks
    c = cue_gaps(cues).withColumn("t", trimmed_column("text")).withColumns({"odd": odd_blanks(t), "blanks": blanks_of(t), "head": first(t), "tail": last(t)})
    words = F.when(t == "", 0).when(odd, word_count(t)).otherwise(blanks + 1)
    c = c.withColumns({"cjk": is_cjk(t), "chars": F.when(odd, visible_length(t)).otherwise(F.length(t) - blanks), "words": words, "ms": F.col("end_ms") - F.col("start_ms")})
    cjk, chars, words = F.col("cjk"), F.col("chars"), F.col("words")
    return c.withColumns({
        "short_cjk": cjk & chars.between(1, 6), "long_cjk": cjk & (chars > 28), "short_words": ~cjk & words.between(1, 3), "long_words": ~cjk & (words > 16),
        "bare_punctuation": F.col("head").rlike(MARK) & t.rlike(PUNCTUATION_ONLY), "leading_punctuation": F.col("head").rlike(LEADING_PUNCTUATION), "connector_end": F.col("tail").rlike(CONNECTOR_END),
        "too_brief": F.col("ms") < 900, "too_long": F.col("ms") > 8000,
    })


FLAGS = ["short_cjk", "long_cjk", "short_words", "long_words", "bare_punctuation", "leading_punctuation", "connector_end", "too_brief", "too_long", "overlaps"]


def cue_quality_metrics(cues: DataFrame, by: list[str]) -> DataFrame:
    """Thirteen counters for each group. Overlaps are between neighbours of a track, so `by` columns must be constant in it."""
    counts = [F.count_if(f).alias(f"n_{f}") for f in FLAGS]
    return _measured(cues).groupBy(*by).agg(F.count(F.lit(1)).alias("n_cues"), *counts, F.max("chars").alias("max_chars"), F.max("ms").alias("max_ms"))


def suspicious_examples(cues: DataFrame, k: int = 30, preview: int = 180) -> DataFrame:
    """The first k cues of each track that any flag marks, with the reasons."""
    reasons = F.concat_ws(",", *[F.when(F.col(f), f) for f in FLAGS])
    c = _measured(cues).select("*", unless_blank(reasons).alias("reasons"))
    shown = F.when(F.col("odd"), collapsed(F.col("text"))).otherwise(F.col("t"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("cue_index"))
    return c.withColumn("r", rank).where(F.col("r") <= k).select("track_id", "cue_index", "start_ms", "end_ms", "reasons", F.substring(shown, 1, preview).alias("preview"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(track_id, stage, n) over the cue tables of several stages."""
    every = reduce(DataFrame.unionByName, [d.select("track_id", F.lit(s).alias("stage")) for s, d in stages.items()])
    return every.groupBy("track_id", "stage").agg(F.count(F.lit(1)).alias("n"))


def transcripts(cues: DataFrame) -> DataFrame:
    """(track_id, text): trimmed texts with anything in them, one a line, in order."""
    t = trimmed(F.col("text"))
    lines = F.array_sort(F.collect_list(F.when(t != "", F.struct("cue_index", t.alias("t")))))
    return cues.groupBy("track_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def readability_metrics(cues: DataFrame, by: list[str]) -> DataFrame:
    """Reading speed and shares of fragments, of overlong cues, of single words and of texts that the track repeats."""
    c = _measured(cues)
    again = F.row_number().over(Window.partitionBy("track_id", "t").orderBy("cue_index")) > 1
    c = c.withColumn("again", again)
    n = F.count(F.lit(1))
    seconds = F.sum("ms") / 1000
    short, long = F.col("short_cjk") | F.col("short_words"), F.col("long_cjk") | F.col("long_words")
    share = lambda x: F.round(F.count_if(x) / n, 6)
    return c.groupBy(*by).agg(
        F.round(F.sum("chars") / seconds, 6).alias("chars_per_s"), F.round(F.sum("words") / seconds, 6).alias("words_per_s"), share(short).alias("short_ratio"), share(long).alias("long_ratio"),
        share(F.col("words") == 1).alias("single_word_ratio"), share(F.col("again")).alias("repeated_ratio"),
    )
