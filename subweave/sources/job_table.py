"""The job table and its segments as cells of files under versioned manifests.

A cell holds the jobs of one day (or span of days) of expiry and one bucket of natural keys, and the segments of these jobs. A change reads the
cells of the buckets that it hits, rewrites those cells alone as new files and commits them by a new manifest, which lists the
files of every cell; readers take the newest manifest. Jobs and segments change together, as one manifest names both. Expiry
leaves out the cells of past days without reading a row. What grows with the table is the manifest's list of files only.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.operators import jobs as J
from subweave.schemas import JOB, JOB_KEY, SEGMENT
from subweave.sources.shared import deleted, file_system

DAY_MS = 86_400_000
NATURAL_KEY = [*JOB_KEY, "source_hash"]


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


class JobTable:
    """A table of jobs (one row a natural key) with their segments in a folder that all executors share.

    buckets: cells a span; a change to few keys rewrites about 1 / buckets of the spans it hits for each of them. days: days of expiry in
    a span; what expires in the middle of one is found by reading that span. Both are properties of the table and don't change. Jobs without a time of
    expiry are in cells of a day of their own, -1, which never expires. Natural keys have no nulls (requests get defaults).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, days: int = 1) -> None:
        self.spark, self.path, self.buckets, self.span_ms = spark, path.rstrip("/"), buckets, days * DAY_MS

    # manifests

    def version(self) -> int:
        """The newest version, 0 for a new table."""
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        return max((int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=0) if fs.exists(folder) else 0

    def manifest(self, version: int | None = None) -> dict:
        """cells: {"day/bucket": {"jobs": [files], "segments": [files]}}; applied: of each stream its last batch and the version before it."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "cells": {}, "applied": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _commit(self, old: dict, cells: dict, applied: dict | None = None) -> int:
        """Writes the next manifest; Conflict if somebody else has done so."""
        fs, place = file_system(self.spark, f"{self.path}/manifests/{old['version'] + 1:012d}.json")
        new = {"version": old["version"] + 1, "cells": {k: v for k, v in sorted(cells.items()) if v["jobs"] or v["segments"]}, "applied": old["applied"] | (applied or {})}
        # complete before it can be seen: a file of another name, then a rename that fails where the name is taken
        _, draft = file_system(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(str(place))
        return new["version"]

    # reading

    def _read(self, manifest: dict, kind: str, chosen: Callable[[int, int], bool] = lambda day, bucket: True) -> DataFrame:
        """jobs or segments of the chosen cells, with the cells' day and bucket."""
        return self._table(kind, [f for cell, x in manifest["cells"].items() if chosen(*map(int, cell.split("/"))) for f in x[kind]])

    def _table(self, kind: str, files: Sequence[str] = ()) -> DataFrame:
        schema = (JOB if kind == "jobs" else SEGMENT) + ", day int, bucket int"
        # the optimizer sees that a filter that nothing passes gives no row, so joins with it go
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema).where(F.lit(False))

    def jobs(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), "jobs").drop("day", "bucket")

    def segments(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), "segments").drop("day", "bucket")

    # changes

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*NATURAL_KEY), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame, kind: str, folder: str) -> dict[str, list[str]]:
        """Writes rows with day and bucket (kept as columns of the files) and lists the files of each cell."""
        target = f"{folder}/{kind}"
        rows.withColumns({"d": F.col("day"), "b": F.col("bucket")}).repartition("d", "b").write.partitionBy("d", "b").parquet(target)
        fs, place = file_system(self.spark, target)
        found: dict[str, list[str]] = {}
        listing = fs.listFiles(place, True)
        while listing.hasNext():
            p = listing.next().getPath()
            if p.getName().startswith("part-"):
                bucket, day = p.getParent().getName(), p.getParent().getParent().getName()
                found.setdefault(f"{day[2:]}/{bucket[2:]}", []).append(p.toString())
        return found

    def change(self, keys: DataFrame, edit: Callable[[DataFrame], DataFrame], new_segments: DataFrame | None = None, applied: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Rewrites the cells of the keys' buckets in which edit (jobs -> jobs) changes anything; returns the version.

        keys: rows with the natural key. new_segments: segment rows, whose job_id is the id that keys have beside the natural key of their
        job; they take the place of the job's segments. applied: a stream's name and batch; a batch that has been applied changes
        nothing. Where another writer was first, the change is made again on what that one left.
        """
        hit = {r.bucket for r in self._bucketed(keys).select("bucket").distinct().collect()}  # at most as many as there are buckets
        for attempt in range(tries):
            old = self.manifest()
            if applied and old["applied"].get(applied[0], [-1])[0] >= applied[1]:
                return old["version"]
            try:
                return self._commit(old, self._changed(old, hit, keys, edit, new_segments), {applied[0]: [applied[1], old["version"]]} if applied else None)
            except Conflict:
                if attempt == tries - 1:
                    raise
        raise AssertionError

    def _changed(self, old: dict, hit: set[int], keys: DataFrame, edit: Callable[[DataFrame], DataFrame], new_segments: DataFrame | None) -> dict:
        if not hit:
            return old["cells"]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        edited = f"{self.path}/edited/{uuid.uuid4().hex}"
        try:
            return self._cells(old, hit, keys, edit, new_segments, folder, edited)
        finally:
            deleted(self.spark, edited)

    def _cells(self, old: dict, hit: set[int], keys: DataFrame, edit: Callable[[DataFrame], DataFrame], new_segments: DataFrame | None, folder: str, edited: str) -> dict:
        """edited: a folder for the edited jobs, which are compared, written and looked up, but made once."""
        before = self._read(old, "jobs", lambda _, bucket: bucket in hit)
        held = before.drop("day", "bucket")
        day = F.coalesce(F.floor(F.col("expires_at") / self.span_ms), F.lit(-1)).cast("int")
        self._bucketed(edit(held)).withColumn("day", day).write.parquet(edited)
        after = self._table("jobs", [edited])
        # only cells with a row that is new, gone or changed
        columns = held.columns
        digest = lambda d: d.groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))
        same = digest(before).join(digest(after), ["day", "bucket", "n", "h"]).select("day", "bucket")
        touched = self._written(after.join(F.broadcast(same), ["day", "bucket"], "left_anti"), "jobs", folder)
        kept = {f"{r.day}/{r.bucket}" for r in same.collect()}  # at most one for each cell
        cells = {}
        for cell, x in old["cells"].items():
            stays = int(cell.split("/")[1]) not in hit or cell in kept
            cells[cell] = dict(x) if stays else {"jobs": touched.get(cell, []), "segments": x["segments"] if cell in touched else []}
        for cell, files in touched.items():
            cells.setdefault(cell, {"jobs": files, "segments": []})
        if new_segments is not None:
            for cell, files in self._segments(old, keys, after, new_segments, folder).items():
                cells[cell]["segments"] = files
        return cells

    def _segments(self, old: dict, keys: DataFrame, jobs: DataFrame, rows: DataFrame, folder: str) -> dict[str, list[str]]:
        """The segments of the cells that get some: those of the rows' jobs replaced, under the ids by which the table knows these jobs.

        Jobs meet by their natural keys, segments only by the id of their job. The new ones are written first: their files say which
        cells get some and which jobs' segments go, so they are made once.
        """
        same = functools.reduce(operator.and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in NATURAL_KEY])
        placed = keys.select(*NATURAL_KEY, F.col("id").alias("job_id")).alias("k").join(jobs.alias("p"), same).select("k.job_id", F.col("p.id").alias("held_id"), "p.day", "p.bucket")
        fresh = rows.join(placed, "job_id").withColumns({"id": F.concat_ws("-", "held_id", "segment_index"), "job_id": F.col("held_id")})
        found = self._written(fresh.select(self._table("segments").columns), "segments", folder)
        before = [f for cell in found for f in old["cells"].get(cell, {"segments": []})["segments"]]
        if before:
            replaced = self._table("segments", [f for files in found.values() for f in files]).select("job_id").distinct()
            for cell, files in self._written(self._table("segments", before).join(replaced, "job_id", "left_anti"), "segments", f"{folder}/kept").items():
                found[cell] = found[cell] + files
        return found

    def upsert(self, incoming: DataFrame, now_ms: int, segments: DataFrame | None = None, applied: tuple[str, int] | None = None) -> int:
        """See upsert_jobs. segments: rows as segments() of the sinks makes them, job_id being the incoming rows' id."""
        return self.change(incoming, lambda jobs: J.upsert_jobs(jobs, incoming, now_ms), segments, applied)

    def update_status(self, updates: DataFrame, now_ms: int) -> int:
        """See update_job_status."""
        return self.change(updates, lambda jobs: J.update_job_status(jobs, updates, now_ms))

    def schedule_retry(self, failed: DataFrame, now_ms: int, base_ms: int = 5000) -> int:
        """See schedule_retry."""
        return self.change(failed, lambda jobs: J.schedule_retry(jobs, failed, now_ms, base_ms))

    def expire(self, now_ms: int, tries: int = 5) -> int:
        """Drops jobs that expired before now_ms, and their segments: whole spans from the manifest, only that of now_ms is read."""
        today = now_ms // self.span_ms
        for attempt in range(tries):
            old = self.manifest()
            of_day = lambda cell: int(cell.split("/")[0])
            cells = {c: x for c, x in old["cells"].items() if of_day(c) == -1 or of_day(c) > today}
            if now_ms % self.span_ms == 0:
                cells |= {c: x for c, x in old["cells"].items() if of_day(c) == today}
            elif any(of_day(c) == today for c in old["cells"]):
                folder, this = f"{self.path}/data/{uuid.uuid4().hex}", lambda day, _: day == today  # noqa: B023
                jobs = self._read(old, "jobs", this).where(F.col("expires_at") >= now_ms)
                segments = self._read(old, "segments", this).join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
                kept = {"jobs": self._written(jobs, "jobs", folder), "segments": self._written(segments, "segments", folder)}
                for c in kept["jobs"]:
                    cells[c] = {"jobs": kept["jobs"][c], "segments": kept["segments"].get(c, [])}
            try:
                return old["version"] if cells == old["cells"] else self._commit(old, cells)
            except Conflict:
                if attempt == tries - 1:
                    raise
        raise AssertionError

    def vacuum(self, versions: int = 2) -> int:
        """Deletes manifests but the newest few, and the files that none of these names; returns the number of those files.

        Not while somebody writes: what isn't committed yet is named by no manifest.
        """
        last = self.version()
        keep = range(max(1, last - versions + 1), last + 1)
        named = {f for v in keep for x in self.manifest(v)["cells"].values() for files in x.values() for f in files}
        fs, manifests = file_system(self.spark, f"{self.path}/manifests")
        for f in fs.listStatus(manifests) if fs.exists(manifests) else []:
            if not any(f.getPath().getName() == f"{v:012d}.json" for v in keep):
                fs.delete(f.getPath(), False)
        _, data = file_system(self.spark, f"{self.path}/data")
        gone, listing = [], fs.listFiles(data, True) if fs.exists(data) else None
        while listing is not None and listing.hasNext():
            p = listing.next().getPath()
            if p.getName().startswith("part-") and p.toString() not in named:
                gone.append(p)
        for p in gone:
            fs.delete(p, False)
        return len(gone)
