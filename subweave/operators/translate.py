"""Translation as a batch job: plan batches, write prompts, read answers, plan again. The model is the caller's function."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from subweave.functions.text import LANGUAGES, is_suspicious, language_name, let, trimmed
from subweave.params import Params
from subweave.sources.shared import exists, whole_waves, written


def bilingual_join(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Pairs cues by number; times are the original's."""
    t = translated.select("track_id", "cue_index", F.col("text").alias("translated_text"))
    return original.withColumnRenamed("text", "source_text").join(t, ["track_id", "cue_index"])


def unequal_tracks(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Tracks with different numbers of cues on the two sides, which may not be paired."""
    n = lambda d, c: d.groupBy("track_id").agg(F.count(F.lit(1)).alias(c))
    return n(original, "n_original").join(n(translated, "n_translated"), "track_id", "full").na.fill(0).where("n_original <> n_translated")


def _number_batches(max_items: int, max_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the batch of each line; lines come track by track, in order, so only three counters are held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, number, items, chars = object(), 0, 0, 0
        for part in parts:
            out = []
            for t, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if t != track:
                    track, number, items, chars = t, 0, 0, 0
                elif items >= max_items or items and chars + n > max_chars:
                    number, items, chars = number + 1, 0, 0
                out.append(number)
                items, chars = items + 1, chars + n
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int32())], names=["track_id", "cue_index", "batch_no"])

    return run


def plan_batches(cues: DataFrame, max_items: int = 12, max_chars: int = 900) -> DataFrame:
    """(track_id, batch_no, start, end): greedy ranges of cues, `end` exclusive; a new one where the next line exceeds the items or characters.

    Where a batch begins depends on where the one before did, so it is a fold over each track's line lengths.
    """
    n = F.greatest(F.lit(1), F.length(trimmed(F.col("text"))))
    lines = cues.select("track_id", "cue_index", n.alias("n"))
    kind = f"track_id {lines.schema['track_id'].dataType.simpleString()}, cue_index int, batch_no int"
    placed = lines.repartition("track_id").sortWithinPartitions("track_id", "cue_index").mapInArrow(_number_batches(max_items, max_chars), kind)
    return placed.groupBy("track_id", "batch_no").agg(F.min("cue_index").alias("start"), (F.max("cue_index") + 1).alias("end"))


STRETCH = 8  # batches in a row, which share the lines around them


def _cut_stretches(max_items: int, max_chars: int, before: int, after: int, batches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines, track by track and in order, to stretches of batches with the lines in and around them; held are the lines of stretches that wait for what follows them."""
    parts_of = pa.list_(pa.struct([("batch_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, advice, number, items, chars, kinds = object(), None, 0, 0, 0, None
        lines: list[tuple[dict, int]] = []  # of the track, from what the first waiting stretch needs, each with its stretch
        waiting: list[tuple[int, list[dict]]] = []  # number of the stretch and its batches
        out: list[tuple] = []

        def ready(upto: float, growing: int = 0) -> None:
            while len(waiting) > growing and waiting[0][1][-1]["end"] + after <= upto:
                n, cuts = waiting.pop(0)
                lo, hi = cuts[0]["start"] - before, cuts[-1]["end"] + after
                out.append((track, [x if own == n else x | {"own": None} for x, own in lines if lo <= x["index"] < hi], cuts, advice))
                least = (waiting[0][1][0]["start"] if waiting else cuts[-1]["end"]) - before
                lines[:] = [x for x in lines if x[0]["index"] >= least]

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["track_id", "lines", "parts", "advice"])
            out.clear()
            return made

        for part in parts:
            own_kind = part.schema.field("own").type
            kinds = (part.schema.field("track_id").type, pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("own", own_kind)])), parts_of, part.schema.field("advice").type)
            for t, index, n, text, own, said in zip(*[part.column(k).to_pylist() for k in range(6)], strict=True):
                if t != track:
                    ready(float("inf"))
                    lines.clear()
                    track, advice, number, items, chars = t, said, 0, 0, 0
                elif items >= max_items or items and chars + n > max_chars:
                    number, items, chars = number + 1, 0, 0
                if items:
                    waiting[-1][1][-1]["end"] = index + 1
                else:
                    if number % batches == 0:
                        waiting.append((number // batches, []))
                    waiting[-1][1].append({"batch_no": number, "start": index, "end": index + 1})
                items, chars = items + 1, chars + n
                ready(index, growing=1)
                lines.append(({"index": index, "text": text, "own": own}, number // batches))
            if len(out) >= 200:
                yield rows()
        ready(float("inf"))
        if out:
            yield rows()

    return run


AS_DEALT = 0  # partitions: as they are, for cues that are dealt by track in whole waves


def stretches(cues: DataFrame, max_items: int = 12, max_chars: int = 900, before: int = 2, after: int = 1, partitions: int | None = None, carried: tuple[str, ...] = (), advice: DataFrame | None = None, batches: int = STRETCH) -> DataFrame:
    """(track_id, lines, parts, advice): several batches of plan_batches in a row (parts: batch_no, start, end) with the lines in and around them, once each.

    lines: index, text and, for the row's own lines and not those around, the cue's number and carried columns (own). One pass over each
    track; nothing is shuffled for it where cues are dealt by track already. partitions: deals them anew, in so many. advice: columns by
    track_id, which meet the cues in the tracks' partitions and pass on with a track's first line.
    """
    n, order = F.greatest(F.lit(1), F.length(trimmed(F.col("text")))), Window.partitionBy("track_id").orderBy("cue_index")
    dealt = cues.repartition(partitions, "track_id") if partitions else cues
    said = F.lit(None).cast("string")
    if advice is not None:
        dealt = dealt.join(advice.select("track_id", F.struct(*[c for c in advice.columns if c != "track_id"]).alias("said")), "track_id", "left")
        said = F.when(F.row_number().over(order) == 1, F.col("said"))
    own = F.struct("cue_index", *carried)
    at = F.row_number().over(order).alias("at")  # a window needs whole tracks in a partition, wherever they come from
    lines = dealt.select("track_id", F.col("cue_index").cast("int").alias("cue_index"), n.alias("n"), "text", own.alias("own"), said.alias("advice"), at)
    kind = lambda c: lines.schema[c].dataType
    line = StructType().add("index", "integer").add("text", "string").add("own", kind("own"))
    part = StructType().add("batch_no", "integer").add("start", "integer").add("end", "integer")
    made = StructType().add("track_id", kind("track_id")).add("lines", ArrayType(line)).add("parts", ArrayType(part)).add("advice", kind("advice"))
    return lines.sortWithinPartitions("track_id", "cue_index").mapInArrow(_cut_stretches(max_items, max_chars, before, after, batches), made)


def _between(lines: Column, lo: Column, hi: Column) -> Column:
    return F.filter(lines, lambda x: (x["index"] >= lo) & (x["index"] < hi))


def batches_with_context(cues: DataFrame, max_items: int = 12, max_chars: int = 900, before: int = 2, after: int = 1, partitions: int | None = None) -> DataFrame:
    """What context_lines gives for the batches of plan_batches, in one pass: the fold that cuts the batches puts their lines together too."""
    rows = stretches(cues, max_items, max_chars, before, after, partitions)
    plain = F.transform("lines", lambda x: F.struct(x["index"].alias("index"), x["text"].alias("text")))
    b = rows.select("track_id", F.explode("parts").alias("p"), plain.alias("lines")).select("track_id", "p.*", "lines")
    start, end, lines = F.col("start"), F.col("end"), F.col("lines")
    return b.select("track_id", "batch_no", "start", "end", _between(lines, start - before, start).alias("preceding"), _between(lines, start, end).alias("current"), _between(lines, end, end + after).alias("following"))


def context_lines(cues: DataFrame, batches: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """batches + preceding, current and following lines.

    Each batch names the numbers of its lines and their neighbours, which meet the cues by an equal join, so that the work
    grows with the lines and not with a track's length. Batches without any line give no row.
    """
    start, end = F.col("start"), F.col("end")
    wanted = batches.select(*batches.columns, F.explode(F.sequence(start - before, end + (after - 1))).alias("cue_index"))
    found = wanted.join(cues.select("track_id", "cue_index", "text"), ["track_id", "cue_index"])
    line = F.struct(F.col("cue_index").alias("index"), F.col("text").alias("text"))
    b = found.groupBy(*batches.columns).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cut = lambda lo, hi: F.filter("lines", lambda x: (x["index"] >= lo) & (x["index"] < hi))
    return b.select(*batches.columns, cut(start - before, start).alias("preceding"), cut(start, end).alias("current"), cut(end, end + after).alias("following"))


def chunk_transcripts(transcripts: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """(track_id, chunk_no, text): chunks of at most max_chars, cut at their last line end if that is in the second half."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            out, at, n = [], 0, len(text or "")
            while at < n:
                end = min(at + max_chars, n)
                if end < n:
                    line = text.rfind("\n", 0, end + 1)
                    end = line if line > at + max_chars // 2 else end
                out.append(text[at:end].strip())
                at = end
            return [x for x in out if x]

        return texts.map(one)

    return transcripts.select("track_id", F.posexplode(cut("text")).alias("chunk_no", "text"))


def _lines(lines: Column) -> Column:
    return F.when(F.size(lines) == 0, "(none)").otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["index"].cast("string"), F.lit("] "), x["text"])), "\n"))


def _context(title: str, preceding: Column, current: Column, following: Column) -> Column:
    return F.concat(F.lit(f"{title}\n\nLines before:\n"), _lines(preceding), F.lit("\n\nLines after:\n"), _lines(following), F.lit("\n\nLines to work on:\n"), _lines(current), F.lit("\n\n"))


STRICT = " Leave nothing out and write no ellipsis that the {} doesn't have."


def _strictly(strict: Column, what: str) -> Column:
    return F.when(strict, STRICT.format(what)).otherwise("")


def _advice(given: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.concat(F.lit(f"{c.capitalize()}:\n"), given[c], F.lit("\n\n")), F.lit("")) for c in ("summary", "glossary") if c in given]


def _translation_prompt(name: Column, strict: Column, advice: list[Column], preceding: Column, current: Column, following: Column) -> Column:
    rules = "Translate each line by itself and keep its number. Don't merge, move or leave out lines. Use the lines around only to understand."
    ask = F.concat(F.lit("Answer with a JSON array of exactly "), F.size(current).cast("string"), F.lit(' items, each {"id": number, "translation": text}.'))
    return F.concat(F.lit("Translate subtitles to "), name, F.lit(f". {rules}"), _strictly(strict, "line"), F.lit("\n\n"), *advice, _context("Context", preceding, current, following), ask)


def translation_prompts(batches: DataFrame, target: str | Column, strict: bool = False) -> DataFrame:
    """batches (with optional summary and glossary columns) + prompt: asks for a JSON array of {id, translation}, one for each line."""
    name = language_name(F.lit(target) if isinstance(target, str) else target)
    return batches.withColumn("prompt", _translation_prompt(name, F.lit(strict), _advice({c: F.col(c) for c in batches.columns}), F.col("preceding"), F.col("current"), F.col("following")))


def _line_prompt(name: Column, strict: Column, text: Column) -> Column:
    return F.concat(F.lit("Translate to "), name, F.lit(". Return only the translation."), _strictly(strict, "text"), F.lit("\n\nText: "), text)


def line_prompts(lines: DataFrame, target: str, strict: bool = False) -> DataFrame:
    """lines (text) + prompt for one line alone."""
    return lines.withColumn("prompt", _line_prompt(language_name(F.lit(target)), F.lit(strict), F.col("text")))


GUIDANCE = {
    ("summary", "map"): "Summarise this part of a transcript in its own language: tone, speakers, topics, names and terms, in a few points.",
    ("summary", "reduce"): "Combine these summaries of parts into one short summary in the same language.",
    ("glossary", "map"): 'List the key terms and names of this part of a transcript as a JSON array of {"source", "target", "note"}, translated to',
    ("glossary", "reduce"): "Combine these glossaries into one JSON array without repetitions, translated to",
}


def _guidance_said(kind: str, step: str, target: str | None) -> str:
    return GUIDANCE[kind, step] + (f" {target}." if kind == "glossary" else "")


def guidance_prompts(parts: DataFrame, kind: str, step: str, target: str | None = None) -> DataFrame:
    """map: (track_id, chunk_no, text) + prompt for each chunk. reduce: one prompt for each track from its chunks' answers."""
    said = _guidance_said(kind, step, target)
    if step == "map":
        return parts.withColumn("prompt", F.concat(F.lit(said + "\n\n"), F.col("text")))
    answers = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"])
    return parts.groupBy("track_id").agg(F.concat(F.lit(said + "\n\n"), F.array_join(answers, "\n\n")).alias("prompt"))


def _restore_prompt(preceding: Column, current: Column, following: Column) -> Column:
    ask = F.concat(F.lit("Answer with a JSON array of exactly "), F.size(current).cast("string"), F.lit(' items, each {"id": number, "restored": text}.'))
    said = "Repair punctuation, case and broken sentences of these subtitle lines in their own language. Keep each number; add and leave out nothing.\n\n"
    return F.concat(F.lit(said), _context("Context", preceding, current, following), ask)


def restore_prompts(batches: DataFrame) -> DataFrame:
    """batches + prompt to repair recognised speech in its own language: a JSON array of {id, restored}."""
    return batches.withColumn("prompt", _restore_prompt(F.col("preceding"), F.col("current"), F.col("following")))


def restore_limits(params: Params) -> tuple[int, int, int, int]:
    """Items, lines before, lines after and characters of a batch to restore."""
    return min(params.batch_items, 12), min(params.before, 2), min(params.after, 2), max(600, int(params.max_tokens * 1.5))


ANSWER_FIELDS = {"translation": ["translation", "translated_text", "text", "initial_translation"], "restore": ["restored", "text", "rewrite"]}


def parse_answers(answers: DataFrame, kind: str = "translation") -> DataFrame:
    """answers (track_id, batch_no, content, expected; with ids or start and end) -> track_id, batch_no, cue_index, text, error.

    The array between the first [ and the last ] of the content, without code fences. A batch with any fault gives one row with
    its error and no lines: no array, wrong number of items (count), an item without a whole id (id) or without text (text), two
    items of one id (repeated id), an id that isn't of the batch (unexpected id). As the number of items is right, a missing id
    comes with one of the last two. ids: array of the batch's line numbers; else start and end, if given, say which are its.
    """
    a = _read_answers(answers, kind)
    out = a.select("track_id", "batch_no", F.explode_outer(F.when(F.col("error").isNull(), F.col("items"))).alias("x"), "error").where("x is not null or error is not null")
    return out.select("track_id", "batch_no", F.col("x.id").cast("int").alias("cue_index"), F.col("x.text").alias("text"), "error")


def _items(content: Column, kind: str) -> Column:
    """The items of an answer: array of id (a number, as it was written) and text; null without an array."""
    fields = ANSWER_FIELDS[kind]
    bare = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(content, F.lit(""))), r"(?i)\A```(?:json)?\s*", ""), r"```\z", "")
    body = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    items = F.from_json(body, f"array<struct<id:string,{','.join(f'{f}:string' for f in fields)}>>")
    return F.transform(items, lambda x: F.struct(x["id"].try_cast("double").alias("id"), trimmed(F.coalesce(*[x[f] for f in fields])).alias("text")))


def _fault(items: Column, expected: Column, stray: Callable[[Column], Column] | None = None) -> Column:
    """The first fault of a batch's items, or null. stray: whether any of some numbers isn't of the batch."""
    whole = F.forall(items, lambda x: x["id"].isNotNull() & (x["id"] == F.floor(x["id"])))
    error = F.when(items.isNull(), "no array").when(F.size(items) != expected, "count").when(~F.coalesce(whole, F.lit(False)), "id").when(~F.coalesce(F.forall(items, lambda x: F.coalesce(x["text"] != "", F.lit(False))), F.lit(False)), "text")
    said = F.transform(items, lambda x: x["id"].cast("int"))
    error = error.when(F.size(F.array_distinct(said)) < F.size(said), "repeated id")
    return error if stray is None else error.when(stray(said), "unexpected id")


def _read_answers(answers: DataFrame, kind: str = "translation") -> DataFrame:
    """answers + items (array of id and text) and error, row by row."""
    stray = None
    if "ids" in answers.columns:
        stray = lambda said: F.size(F.array_except(said, "ids")) > 0
    elif {"start", "end"} <= set(answers.columns):
        stray = lambda said: F.exists(said, lambda k: (k < F.col("start")) | (k >= F.col("end")))
    return answers.withColumn("items", _items(F.col("content"), kind)).withColumn("error", _fault(F.col("items"), F.col("expected"), stray))


def apply_answers(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """cues + translated_text: the answer (of several the least), else the source text."""
    a = answers.where("cue_index is not null").groupBy("track_id", "cue_index").agg(F.min("text").alias("answer"))  # of several answers always the same one
    return cues.join(a, ["track_id", "cue_index"], "left").withColumn("translated_text", F.coalesce("answer", "text")).drop("answer")


def audit_answers(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """(track_id, cue_index, problem): lines without an answer (missing) and answers without a line (unexpected)."""
    key = ["track_id", "cue_index"]
    a = answers.where("cue_index is not null").select(*key).distinct()
    missing = cues.select(*key).join(a, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(a.join(cues.select(*key), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def fallback_plan(batches: DataFrame, parsed: DataFrame, attempt: int, retries: int = 0) -> DataFrame:
    """What to ask next: (track_id, start, end, attempt, how).

    batches: track_id, batch_no, start, end. A failed batch is asked again (retry) while retries are left, then halved, the first half the
    larger; a single line is asked alone (line). Of good batches only lines with suspicious answers are asked alone;
    parsed needs source_text beside text for that.
    """
    b = batches.select("track_id", "batch_no", "start", "end")
    failed = b.join(parsed.where("error is not null").select("track_id", "batch_no").distinct(), ["track_id", "batch_no"])
    size = F.col("end") - F.col("start")
    row = lambda s, e, a, how: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(a).alias("attempt"), F.lit(how).alias("how"))
    start, end, middle = F.col("start"), F.col("end"), F.col("start") + F.ceil(size / 2)
    if attempt < retries:
        parts = F.array(row(start, end, attempt + 1, "retry"))
    else:  # in one pass, as what came before would be computed for each part of a union
        parts = F.when(size == 1, F.array(row(start, end, 0, "line"))).when(size > 1, F.array(row(start, middle, 0, "half"), row(middle, end, 0, "half")))
    again = failed.select("track_id", F.explode(parts).alias("x")).select("track_id", "x.*")
    odd = parsed.where(F.col("error").isNull() & is_suspicious(F.col("source_text"), F.col("text")))
    return again.unionByName(odd.select("track_id", row(F.col("cue_index"), F.col("cue_index") + 1, 0, "line").alias("x")).select("track_id", "x.*"))


Model = Callable[[list[str]], list[str]]


Keep = Callable[[DataFrame], DataFrame]
Part = Callable[[Column], Column]  # of a row's part: start, end, attempt and how
Look = Callable[[Column, Column, Column], Column]  # of a row's lines, parts and answers: done, lines and parts that are left
COMMITTED = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}  # as each task ends


def answers_of(fn: Model, prompts: list[str]) -> list[str | None]:
    """The model's answers; where it raises or answers too few or too many, each half is asked by itself, so that one prompt costs no other's answer."""
    try:
        out = list(fn(prompts))
        if len(out) == len(prompts):
            return out
    except Exception:  # noqa: BLE001  the caller's model may fail in any way
        pass
    if len(prompts) < 2:
        return [None] * len(prompts)
    half = len(prompts) // 2
    return answers_of(fn, prompts[:half]) + answers_of(fn, prompts[half:])


def short_key(key: Column) -> Column:
    """Half of a key, which tells keys apart, as bytes."""
    return F.unhex(F.substring(key, 1, 32))


class Ledger:
    """Answers that were paid for, by the hash of model, attempt and prompt, as a table in a folder that outlives the job.

    Each task's answers are committed as the task ends, so a job that is killed and run again asks only for what it hadn't got.
    Rows of batches leave what becomes of them beside their answers, in a folder for each round, so that they need not meet them again.
    """

    SCHEMA = "key string, content string, keys array<string>, contents array<string>"  # an answer, or those of a row

    def __init__(self, path: str, model: str) -> None:
        self.path, self.model = path, model

    def key(self, attempt: Column, prompt: Column) -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(self.model), attempt.cast("string"), prompt), 256)

    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", self.key(F.col("attempt") if "attempt" in rows.columns else F.lit(0), F.col("prompt")))

    def _held(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self.path):
            return spark.createDataFrame([], self.SCHEMA)
        return spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def keys(self, spark: SparkSession) -> DataFrame:
        return self._held(spark).select(F.explode(F.when(F.col("key").isNull(), F.col("keys")).otherwise(F.array("key"))).alias("key"))

    def read(self, spark: SparkSession, only: DataFrame | None = None) -> DataFrame:
        """(key, content): one answer for each key (of those wanted, if given: a column short, see short_key)."""
        pair = lambda k, c: F.struct(k.alias("key"), c.alias("content"))
        pairs = F.when(F.col("key").isNull(), F.zip_with("keys", "contents", pair)).otherwise(F.array(pair(F.col("key"), F.col("content"))))
        held = self._held(spark).select(F.explode(pairs).alias("x")).select("x.*")
        return (held if only is None else held.withColumn("short", short_key(F.col("key"))).join(only, "short", "left_semi")).groupBy("key").agg(F.min("content").alias("content"))

    def answered(self, rows: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows + content; each prompt that has no answer yet is asked once, whatever number of rows have it. Failed calls aren't kept."""
        keyed, spark = self.keyed(rows), rows.sparkSession
        new = keyed.select("key", *[c for c in ("prompt", "by") if c in keyed.columns]).dropDuplicates(["key"]).join(self.keys(spark), "key", "left_anti")
        ask(new).where("content is not null").select("key", "content").write.mode("append").options(**COMMITTED).parquet(self.path)
        return keyed.join(self.read(spark), "key", "left").drop("key")

    def round(self, rows: DataFrame, prompt: Part, by: Part, ask: Callable[[Column, Column], Column], look: Look, tasks: int, keep: Keep) -> DataFrame:
        """rows looked at (see _asked_rows); each prompt that has no answer yet is asked once, by one of the rows that have it.

        Which row asks follows from keys alone, so that the rows are shuffled once: to be asked. Of the answers only those pass to other
        rows that others wait for, and those of earlier rounds or jobs.
        """
        spark, short = rows.sparkSession, short_key
        keys = F.transform("parts", lambda p: self.key(p["attempt"], prompt(p)))
        wanted = rows.select("row", F.explode(F.array_distinct(keys)).alias("key")).select("row", short(F.col("key")).alias("key"))
        held = self.keys(spark).select(short(F.col("key")).alias("key"))
        asker = wanted.groupBy("key").agg(F.min("row").alias("row"), (F.count(F.lit(1)) > 1).alias("shared")).join(held, "key", "left_anti")
        asks = asker.groupBy("row").agg(F.collect_list("key").alias("asks"), F.collect_list(F.when(F.col("shared"), F.col("key"))).alias("shared"))

        columns, no_keys = [c for c in rows.columns if c != "row"], F.array().cast("array<binary>")
        r, a = F.struct(*columns), F.struct("asks", "shared")
        both = rows.select("row", r.alias("r"), F.lit(None).cast(asks.select(a.alias("a")).schema["a"].dataType).alias("a")).unionByName(asks.select("row", F.lit(None).cast(rows.select(r.alias("r")).schema["r"].dataType).alias("r"), a.alias("a")))
        dealt = both.repartition(tasks, "row").groupBy("row").agg(F.first("r", True).alias("r"), F.first("a", True).alias("a"))
        dealt = dealt.select("row", "r.*", F.coalesce("a.asks", no_keys).alias("asks"), F.coalesce("a.shared", no_keys).alias("shared")).withColumn("wants", keys)
        own = F.transform("wants", lambda k, i: F.array_contains("asks", short(k)) & (F.array_position("wants", k) == i + 1))  # of equal ones the first
        mine = F.zip_with("parts", own, lambda p, is_own: F.struct(prompt(p).alias("prompt"), F.when(is_own, by(p)).alias("by")))
        got = dealt.withColumn("mine", mine).withColumn("said", ask(F.col("mine.prompt"), F.col("mine.by")))
        got = got.withColumn("answers", F.transform("wants", lambda k: F.struct(k.alias("key"), F.array_contains("asks", short(k)).alias("asked"), F.get("said", (F.array_position("wants", k) - 1).cast("int")).alias("content"))))
        waits, paid = F.exists("answers", lambda x: ~x["asked"]), F.array_distinct(F.filter("answers", lambda x: x["content"].isNotNull()))
        passed = F.array_distinct(F.filter("answers", lambda x: F.array_contains("shared", short(x["key"]))))
        looked = F.when(~waits, look(F.col("lines"), F.col("parts"), F.transform("answers", lambda x: x["content"])))
        still = lambda c: F.when(waits, F.col(c)).alias(c)
        rest = [c for c in columns if c not in ("lines", "parts")]
        folder = f"{self.path}/round={uuid.uuid4().hex}"
        made = got.select("row", *rest, looked.alias("looked"), still("lines"), still("parts"), still("answers"), waits.alias("waits"), F.transform(paid, lambda x: x["key"]).alias("keys"), F.transform(paid, lambda x: x["content"]).alias("contents"), passed.alias("passed"))
        made.write.options(**COMMITTED, compression="zstd").parquet(folder)
        made = spark.read.schema(made.schema).parquet(folder)
        out = made.where(~F.col("waits")).select("row", *rest, "looked.*")
        waiting = made.where("waits").select("row", *rest, "lines", "parts", "answers")
        if waiting.isEmpty():
            return out
        open_keys = waiting.select("row", F.explode(F.array_distinct(F.transform(F.filter("answers", lambda x: ~x["asked"]), lambda x: x["key"]))).alias("key"))
        found = made.select(F.explode("passed").alias("x")).select("x.key", "x.content")
        earlier = open_keys.select("key").distinct().join(found, "key", "left_anti").select(short(F.col("key")).alias("short"))  # that nobody had to ask
        if n := earlier.count():
            found = found.unionByName(self.read(spark, F.broadcast(earlier) if n <= FEW else earlier)).groupBy("key").agg(F.min("content").alias("content"))
        found = open_keys.join(found, "key").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "content"))).alias("found"))
        contents = F.transform("answers", lambda x: F.coalesce(x["content"], F.try_element_at("found", x["key"])))
        late = waiting.join(found, "row", "left").select("row", *rest, look(F.col("lines"), F.col("parts"), contents).alias("looked")).select("row", *rest, "looked.*")
        return out.unionByName(keep(late))


FEW = 1 << 20  # short keys that are sent to all tasks
CALL, MOST = 64, 2048  # prompts in a call of the model, and in a task of a large job


def _tasks(prompts: int, per_task: int, cores: int) -> int:
    """A task for every per_task prompts; beyond eight tasks a core they grow, up to MOST prompts, as each has its cost."""
    return max(1, min(-(-prompts // per_task), max(8 * cores, -(-prompts // MOST))))


def _said(fn: Model, prompts: list[str]) -> list[str | None]:
    return [x for k in range(0, len(prompts), CALL) for x in answers_of(fn, prompts[k : k + CALL])]


def _asked(rows: DataFrame, models: dict[str, Model], keep: Keep, ledger: Ledger | None = None, per_task: int = CALL) -> DataFrame:
    """rows with a prompt (and a model's name in `by`, if there are several models) + content: the answers, kept so that no call is repeated.

    A call that fails leaves its content null. per_task: prompts in a task, so that the number of tasks grows with them (see _tasks); a
    call has no more than CALL, whatever the task holds. Only prompts cross to Python.
    """
    rows = keep(rows)  # counted and asked
    tasks = _tasks(rows.count(), per_task, rows.sparkSession.sparkContext.defaultParallelism)

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, by in parts:
            content = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            for name, fn in models.items():
                chosen = prompts[by == name].tolist()
                if chosen:
                    content[by == name] = pd.Series(_said(fn, chosen), index=prompts.index[by == name], dtype=object)
            yield content

    ask = ask.asNondeterministic()  # never called twice for a row

    def spread(d: DataFrame) -> DataFrame:
        by = F.col("by") if "by" in d.columns else F.lit(next(iter(models)))
        return d.repartition(tasks, F.xxhash64("prompt")).withColumn("content", ask(F.col("prompt"), by))

    return keep(spread(rows) if ledger is None else ledger.answered(rows, spread))


def _asked_rows(rows: DataFrame, prompt: Part, by: Part, models: dict[str, Model], look: Look, keep: Keep, ledger: Ledger | None = None, tasks: int = AS_DEALT) -> DataFrame:
    """rows of several parts (row, track_id, lines, parts and more) as they are looked at: with done, lines and parts that are left in the place of lines and parts.

    A part's prompt is made where it is asked, from the lines that the parts share, and what is kept is what became of them, so neither
    prompts nor lines that are done with are shuffled or written. tasks: into which rows are dealt.
    """

    @F.pandas_udf("array<string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, by in batches:
            said: dict[tuple[int, int], str | None] = {}
            for name, fn in models.items():
                at = [(i, j) for i, names in enumerate(by) for j, x in enumerate(names) if x == name]
                said.update(zip(at, _said(fn, [prompts.iloc[i][j] for i, j in at]), strict=True))
            yield pd.Series([[said.get((i, j)) for j in range(len(names))] for i, names in enumerate(by)], index=prompts.index, dtype=object)

    ask = ask.asNondeterministic()  # never called twice for a row
    if ledger is not None:
        return ledger.round(rows, prompt, by, ask, look, tasks, keep)
    dealt = rows.repartition(tasks, "row") if tasks else rows
    got = dealt.withColumn("asks", F.transform("parts", lambda x: F.struct(prompt(x).alias("prompt"), by(x).alias("by")))).withColumn("said", ask(F.col("asks.prompt"), F.col("asks.by")))
    rest = [c for c in rows.columns if c not in ("lines", "parts")]
    return keep(got.select(*rest, look(F.col("lines"), F.col("parts"), F.col("said")).alias("looked")).select(*rest, "looked.*"))


def _to_ask(cues: DataFrame, limits: tuple[int, int, int, int], carried: tuple[str, ...], partitions: int | None, advice: DataFrame | None = None) -> DataFrame:
    """Stretches of cues with the parts to ask. limits: items and characters of a batch, lines before and after."""
    start, end = lambda p: p["start"], lambda p: p["end"]
    part = lambda p: F.struct(start(p).alias("start"), end(p).alias("end"), F.lit(0).alias("attempt"), F.when(end(p) - start(p) == 1, "line").otherwise("batch").alias("how"))
    rows = stretches(cues, *limits, partitions, carried, advice)
    return rows.select(F.monotonically_increasing_id().alias("row"), "track_id", "lines", F.transform("parts", part).alias("parts"), *([] if advice is None else ["advice"]))


def _tasks_of(rows: DataFrame) -> int:
    """Tasks for the parts of kept rows; 0 if there are none."""
    prompts = rows.agg(F.sum(F.size("parts"))).first()[0]
    return _tasks(prompts, CALL, rows.sparkSession.sparkContext.defaultParallelism) if prompts else 0


def _of_part(lines: Column, p: Column, before: int, after: int, f: Callable[[Column, Column, Column], Column]) -> Column:
    s, e = p["start"], p["end"]
    around = F.struct(_between(lines, s - before, s).alias("preceding"), _between(lines, s, e).alias("current"), _between(lines, e, e + after).alias("following"))
    return let(around, lambda x: f(x["preceding"], x["current"], x["following"]))


def _within(parts: Column, x: Column) -> Column:
    return F.exists(parts, lambda p: (p["start"] <= x["index"]) & (x["index"] < p["end"]))


def _answered(line: Column, good: Column) -> Column:
    """A line's answer, else its text."""
    return F.coalesce(F.get(F.filter(good, lambda x: x["cue_index"] == line["index"]), F.lit(0))["text"], line["text"])


def _carried(cues: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in cues.columns if c not in ("track_id", "cue_index", "text"))


def _cues_of(done: DataFrame, like: DataFrame, **texts: Column) -> DataFrame:
    """The lines of done rows (x) as cues with the columns of others, numbers first; texts: in the place of the text."""
    columns = ["cue_index", *[c for c in like.columns if c not in ("track_id", "cue_index")]]
    return done.select("track_id", *[c for name in columns for c in ([t.alias(k) for k, t in texts.items()][:1] if name == "text" else [F.col("x.own")[name].alias(name)])], *[t.alias(k) for k, t in list(texts.items())[1:]])


def restore_cues(cues: DataFrame, fn: Model, params: Params | None = None, checkpoint: Keep | None = None, ledger: Ledger | None = None, partitions: int | None = None) -> DataFrame:
    """cues with texts as the model repairs them; a batch whose answer has a fault keeps its texts. partitions: see translate_to_bilingual."""
    p, keep = params or Params(), checkpoint or written
    items, before, after, chars = restore_limits(p)
    rows, tasks = _to_ask(cues, (items, chars, before, after), _carried(cues), partitions), AS_DEALT
    if partitions is None or ledger is not None:
        rows = keep(rows)
        tasks = _tasks_of(rows) or 1
    prompt = lambda x: _of_part(F.col("lines"), x, before, after, _restore_prompt)

    def look(lines: Column, parts: Column, said: Column) -> Column:
        def good(x: Column, content: Column) -> Column:
            ids = F.transform(_between(lines, x["start"], x["end"]), lambda line: line["index"])
            read = let(_items(content, "restore"), lambda items: F.struct(_fault(items, F.size(ids), lambda said: F.size(F.array_except(said, ids)) > 0).alias("error"), items.alias("items")))
            item = lambda y: F.struct(y["id"].cast("int").alias("cue_index"), y["text"].alias("text"))
            return let(read, lambda r: F.when(r["error"].isNull(), F.transform(r["items"], item)).otherwise(F.array().cast("array<struct<cue_index: int, text: string>>")))

        mine = F.filter(lines, lambda line: line["own"].isNotNull())
        return let(F.flatten(F.zip_with(parts, said, good)), lambda g: F.struct(F.transform(mine, lambda line: F.struct(line["own"].alias("own"), _answered(line, g).alias("text"))).alias("done"), F.slice(lines, 1, 0).alias("lines"), F.slice(parts, 1, 0).alias("parts")))

    got = _asked_rows(rows, prompt, lambda x: F.lit(""), {"": fn}, look, keep, ledger, tasks)
    return _cues_of(got.select("track_id", F.explode("done").alias("x")), cues, text=F.col("x.text"))


def _asked_chunks(chunks: DataFrame, kinds: list[str], target: str, fn: Model, keep: Keep) -> DataFrame:
    """(track_id, chunk_no, a column for each kind): the answers to a chunk's prompts of all kinds, which are made where they are asked."""

    @F.pandas_udf("array<string>")
    def ask(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in rows:
            said = iter(_said(fn, [p for row in prompts for p in row]))
            yield pd.Series([[next(said) for _ in row] for row in prompts], index=prompts.index, dtype=object)

    asks = F.array(*[F.concat(F.lit(f"{_guidance_said(kind, 'map', target)}\n\n"), F.col("text")) for kind in kinds])
    got = chunks.select("track_id", "chunk_no", ask.asNondeterministic()(asks).alias("said"))
    return keep(got.select("track_id", "chunk_no", *[F.get("said", k).alias(kind) for k, kind in enumerate(kinds)]))


def guidance(cues: DataFrame, target: str, kinds: list[str], fn: Model, params: Params | None = None, checkpoint: Keep | None = None, ledger: Ledger | None = None, partitions: int | None = None) -> DataFrame:
    """(track_id, one column for each kind): a prompt for each chunk of a track's transcript, then one that combines the answers.

    kinds: of summary and glossary. A track of which any call of a kind fails or answers nothing has no such guidance: null.
    partitions: into which tracks are dealt, whose tasks ask as well; AS_DEALT: cues lie by track in such ones. None: chunks are written and
    dealt anew, as they are with a ledger.
    """
    p, keep = params or Params(), checkpoint or written
    line = F.struct("cue_index", trimmed(F.col("text")).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])
    dealt = cues.select("track_id", "cue_index", "text").repartition(partitions, "track_id") if partitions else cues
    tracks = dealt.groupBy("track_id").agg(F.array_join(F.filter(texts, lambda t: t != ""), "\n").alias("text"))
    out, name = cues.select("track_id").distinct(), language_name_of(target)
    chunks = chunk_transcripts(tracks, p.chunk_chars)
    if partitions is None or ledger is not None:
        chunks = keep(chunks)
    if ledger is None:
        if partitions is None:
            chunks = chunks.repartition(_tasks(chunks.count(), CALL, chunks.sparkSession.sparkContext.defaultParallelism), F.xxhash64("text"))
        chunks = _asked_chunks(chunks, kinds, name, fn, keep)
    answer = F.nullif(trimmed(F.col("content")), F.lit(""))
    for kind in kinds:
        if ledger is None:
            parts = chunks.withColumn("content", F.col(kind))
        else:
            parts = _asked(guidance_prompts(chunks, kind, "map", name).select("track_id", "chunk_no", "prompt"), {"": fn}, keep, ledger)
        parts = parts.select("track_id", "chunk_no", answer.alias("text"))
        whole = parts.groupBy("track_id").agg(F.bool_and(F.col("text").isNotNull()).alias("whole")).where("whole").select("track_id")
        combined = _asked(guidance_prompts(parts.join(whole, "track_id", "left_semi"), kind, "reduce", name), {"": fn}, keep, ledger)
        out = out.join(combined.select("track_id", answer.alias(kind)), "track_id", "left")
    return keep(out)


def language_name_of(code: str) -> str:
    return LANGUAGES.get(code, code)


def translate_to_bilingual(
    cues: DataFrame,
    target: str,
    fn: Model,
    params: Params | None = None,
    checkpoint: Keep | None = None,
    line_fn: Model | None = None,
    restore_fn: Model | None = None,
    guidance_fn: Model | None = None,
    guidance_kinds: tuple[str, ...] = ("summary", "glossary"),
    ledger: Ledger | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """cues + source_text and translated_text, by rounds of batches, answers and what is left.

    fn: a list of prompts -> a list of answers, called on the executors; a prompt for which it raises, or answers with numbers other than
    the batch's, is a failed batch. checkpoint: keeps a round's answers (default: a table in the shared folder), so that no model call
    is repeated within the job; ledger: also keeps them for the next run of a job that was killed. line_fn: the same for prompts of line_prompts, whose answers are the bare translation; without it
    single lines are asked of fn, as batches of one. A single line that fails is asked again while retries are left, and one that
    still fails or is suspicious once more with the strict prompt; then the source text stands. Rounds end when nothing is left.
    restore_fn: first has the source lines repaired (see restore_cues); what comes out is paired with the lines as they were.
    guidance_fn: first has a summary and a glossary of each track made (see guidance), which go into the batches' prompts.
    partitions: in which tracks are cut into batches and asked (see whole_waves); AS_DEALT: cues lie by track in such ones. None leaves their
    number to Spark, and batches are written, counted and dealt into tasks by their number before they are asked.
    """
    p = params or Params()
    keep = checkpoint or written
    original, carried = cues, _carried(cues)
    if restore_fn is not None:
        kept_text = "text as it was"
        cues, carried = restore_cues(cues.withColumn(kept_text, F.col("text")), restore_fn, p, keep, ledger, partitions), (*carried, kept_text)
        if partitions is not None:
            partitions = whole_waves(cues.sparkSession, cues.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
    advice = None if guidance_fn is None else guidance(cues, target, list(guidance_kinds), guidance_fn, p, keep, ledger, partitions)
    todo, tasks, bare = _to_ask(cues, (p.batch_items, p.char_budget(), p.before, p.after), carried, partitions, advice), AS_DEALT, line_fn is not None
    given = _advice({} if advice is None else {c: F.col("advice")[c] for c in advice.columns if c != "track_id"})
    name = language_name(F.lit(target))

    def prompt(x: Column) -> Column:
        strict = x["how"] == "strict"
        of_batch = _of_part(F.col("lines"), x, p.before, p.after, lambda *around: _translation_prompt(name, strict, given, *around))
        of_line = _line_prompt(name, strict, F.get(_between(F.col("lines"), x["start"], x["end"]), F.lit(0))["text"])
        return F.when(_alone(x), of_line).otherwise(of_batch) if bare else of_batch

    by = lambda x: F.when(_alone(x) & F.lit(bare), "line").otherwise("batch")
    look = lambda lines, parts, said: _looked_at(lines, parts, said, p, bare)
    if partitions is None or ledger is not None:
        todo = keep(todo)
        tasks = _tasks_of(todo)
    done = []
    for _ in range((p.retries + 1) * (p.batch_items.bit_length() + 1) + 1):  # each size with its retries, then the strict prompt
        if done and not tasks:
            break
        read = _asked_rows(todo, prompt, by, {"batch": fn, "line": line_fn or fn}, look, keep, ledger, tasks or AS_DEALT)
        done.append(read.select("track_id", F.explode("done").alias("x")))
        todo = read.where(F.size("parts") > 0).drop("done")
        tasks = _tasks_of(todo)
    if tasks:  # what is left keeps its texts
        left = F.filter("lines", lambda x: x["own"].isNotNull() & _within(F.col("parts"), x))
        done.append(todo.select("track_id", F.explode(F.transform(left, lambda x: F.struct(x["own"].alias("own"), x["text"].alias("text"), x["text"].alias("said")))).alias("x")))
    out = functools.reduce(DataFrame.unionByName, done)
    source = F.col("x.text") if restore_fn is None else F.col("x.own")[kept_text]
    return _cues_of(out, original, source_text=source, translated_text=F.col("x.said"))


def _alone(part: Column) -> Column:
    return part["how"].isin("line", "strict")


def _checked(part: Column, content: Column, lines: Column, bare: bool) -> Column:
    """A part with its answer's error and items (cue_index, text, good, doubtful). bare: answers to single lines are the translation alone."""
    item = lambda k, t: F.struct(k.cast("int").alias("cue_index"), t.alias("text"))

    def read(current: Column) -> Column:
        stray = lambda said: F.size(F.array_except(said, F.transform(current, lambda x: x["index"]))) > 0
        made = lambda error, items: F.struct(error.alias("error"), items.alias("items"))
        out = let(_items(content, "translation"), lambda items: made(_fault(items, F.size(current), stray), F.transform(items, lambda x: item(x["id"], x["text"]))))
        if bare:
            out = F.when(_alone(part), let(trimmed(F.coalesce(content, F.lit(""))), lambda said: made(F.when(said == "", "text"), F.array(item(part["start"], said))))).otherwise(out)
        return out

    def looked_at(current: Column, x: Column) -> Column:
        source = F.get(F.filter(current, lambda line: line["index"] == x["cue_index"]), F.lit(0))["text"]
        doubtful = F.when(_alone(part), is_suspicious(source, x["text"], in_context=False)).otherwise(is_suspicious(source, x["text"]))
        return let(F.struct(source.isNotNull().alias("known"), doubtful.alias("doubtful")), lambda d: F.struct(x["cue_index"].alias("cue_index"), x["text"].alias("text"), (d["known"] & ~d["doubtful"]).alias("good"), d["doubtful"].alias("doubtful")))

    def whole(current: Column) -> Column:
        items = lambda r: F.when(r["error"].isNull(), F.transform(r["items"], lambda x: looked_at(current, x)))
        return let(read(current), lambda r: F.struct(part["start"].alias("start"), part["end"].alias("end"), part["attempt"].alias("attempt"), part["how"].alias("how"), r["error"].alias("error"), items(r).alias("items")))

    return let(_between(lines, part["start"], part["end"]), whole)


def _next_parts(c: Column, retries: int) -> Column:
    """What is left of a checked part, by the rules of fallback_plan: array of start, end, attempt and how, or null."""
    start, end, size = c["start"], c["end"], c["end"] - c["start"]
    middle = (start + F.ceil(size / 2)).cast("int")
    part = lambda s, e, a, how: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), a.cast("int").alias("attempt"), how.alias("how"))
    zero, more, line = F.lit(0), c["attempt"] < retries, F.lit("line")
    named = lambda n, how: F.when(n == 1, line).otherwise(how)
    halves = F.array(part(start, middle, zero, named(middle - start, F.lit("half"))), part(middle, end, zero, named(end - middle, F.lit("half"))))
    failed = F.when(more, F.array(part(start, end, c["attempt"] + 1, named(size, F.lit("retry"))))).when(size > 1, halves).otherwise(F.array(part(start, end, zero, line)))
    odd = F.filter(c["items"], lambda x: x["doubtful"])
    lone = F.transform(odd, lambda x: part(x["cue_index"], x["cue_index"] + 1, zero, line))
    again = c["error"].isNotNull() & more
    once_more = F.when(c["error"].isNotNull() | (F.size(odd) > 0), F.array(part(start, start + 1, F.when(again, c["attempt"] + 1).otherwise(zero), F.when(again, line).otherwise("strict"))))
    of_batch = F.when(c["error"].isNotNull(), failed).otherwise(lone)
    return F.when(c["how"] == "line", once_more).when(~_alone(c), of_batch)


def _looked_at(lines: Column, parts: Column, said: Column, p: Params, bare: bool) -> Column:
    """done (own, text, said: the answer, else the text), and the lines and parts that are left, with the lines around them.

    What is left of a batch has its lines and those around it among the row's own, so nothing is joined. Single lines that are
    asked by themselves (bare) take no lines around.
    """
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")

    def sorted_out(checked: Column) -> Column:
        left = F.flatten(F.transform(checked, lambda c: F.coalesce(_next_parts(c, p.retries), none("start: int, end: int, attempt: int, how: string"))))
        left = F.filter(left, lambda x: F.size(_between(lines, x["start"], x["end"])) > 0)
        good = F.flatten(F.transform(checked, lambda c: F.coalesce(F.filter(c["items"], lambda x: x["good"]), none("cue_index: int, text: string, good: boolean, doubtful: boolean"))))
        return F.struct(left.alias("left"), good.alias("good"))

    def out(x: Column) -> Column:
        left, good = x["left"], x["good"]
        done = F.filter(lines, lambda line: line["own"].isNotNull() & _within(parts, line) & ~_within(left, line))
        by_itself = lambda y: _alone(y) & F.lit(bare)
        near = lambda line: F.exists(left, lambda y: (line["index"] >= y["start"] - F.when(by_itself(y), 0).otherwise(p.before)) & (line["index"] < y["end"] + F.when(by_itself(y), 0).otherwise(p.after)))
        said_of = lambda line: F.struct(line["own"].alias("own"), line["text"].alias("text"), _answered(line, good).alias("said"))
        return F.struct(F.transform(done, said_of).alias("done"), F.filter(lines, near).alias("lines"), left.alias("parts"))

    return let(let(F.zip_with(parts, said, lambda part, content: _checked(part, content, lines, bare)), sorted_out), out)
