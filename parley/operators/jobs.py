"""Pipeline jobs as tables: staleness, status of files, listing, cache validity, stage costs, schema versions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STALE_SECONDS, RECENT = 60, 5
# The states of a job, and stages whose cost is in proportion to the audio.
RUNNING, DONE = ["queued", "running"], ["awaiting_labels", "labeled"]
BY_AUDIO = ["asr", "diarize"]
VERSION = re.compile(r"(\d{3})_[a-z0-9_]+")


def observed(jobs: DataFrame, heartbeats: DataFrame, now: Column) -> DataFrame:
    """jobs(file_id, status, updated_at, ...), heartbeats(file_id, at) -> jobs as they stand at `now`: a running one that neither was updated nor gave a sign for 60 s has failed."""
    last = heartbeats.groupBy("file_id").agg(F.max("at").alias("last_sign"))
    quiet = F.unix_micros(now) - F.unix_micros(F.greatest("updated_at", "last_sign"))
    dead = F.col("status").isin(RUNNING) & F.coalesce(quiet >= STALE_SECONDS * 1_000_000, F.lit(True))
    return jobs.join(last, "file_id", "left").withColumn("status", F.when(dead, "failed").otherwise(F.col("status"))).drop("last_sign")


def statuses(files: DataFrame, jobs: DataFrame, transcripts: DataFrame, labels: DataFrame) -> DataFrame:
    """Each file's state: its job's; without one, labeled or awaiting_labels where there is a transcript, else not_processed."""
    has = lambda d, name: d.select("file_id").distinct().withColumn(name, F.lit(True))
    joined = files.join(jobs.select("file_id", "status"), "file_id", "left").join(has(transcripts, "written"), "file_id", "left").join(has(labels, "named"), "file_id", "left")
    other = F.when(F.col("written").isNull(), "not_processed").when(F.col("named"), "labeled").otherwise("awaiting_labels")
    return joined.withColumn("status", F.coalesce("status", other)).drop("written", "named")


def listing(files: DataFrame, jobs: DataFrame, transcripts: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with place, name, state and creation time, the newest first, those without a job last, equal ones by falling id."""
    of = statuses(files, jobs, transcripts, labels).join(jobs.select("file_id", "created_at", "source_filename"), "file_id", "left")
    newest = Window.orderBy(F.coalesce(F.col("created_at").cast("string"), F.lit("")).desc(), F.col("file_id").desc())
    return of.select(F.row_number().over(newest).alias("place"), "file_id", F.coalesce("source_filename", F.col("file_id").cast("string")).alias("display_name"), "status", "created_at")


def valid_caches(artifacts: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(file_id, stage, cache_key), artifacts(file_id, stage, content) -> whether each stage's artifact is there, parses and holds the key."""
    had = artifacts.select("file_id", "stage", F.get_json_object("content", "$.cache_key").alias("had"))
    return keys.join(had, ["file_id", "stage"], "left").groupBy("file_id", "stage", "cache_key").agg(F.bool_or(F.coalesce(F.col("had") == F.col("cache_key"), F.lit(False))).alias("valid"))


def stage_costs(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """jobs(file_id, status, updated_at, duration_s), stages(file_id, stage, started_at, finished_at, returncode) -> (stage, cost): the upper median over the last five finished jobs of the seconds a stage took, for
    some stages for each second of audio. Stages that failed or haven't ended aren't counted."""
    done = jobs.where(F.col("status").isin(DONE) & (F.col("duration_s") > 0)).orderBy(F.desc("updated_at"), F.desc("file_id")).limit(RECENT)
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    cost = F.when(F.col("stage").isin(BY_AUDIO), took / F.col("duration_s")).otherwise(took)
    spent = stages.where("returncode = 0 AND started_at IS NOT NULL AND finished_at IS NOT NULL").join(done.select("file_id", "duration_s"), "file_id")
    values = F.array_sort(F.collect_list(cost))
    return spent.groupBy("stage").agg(values.alias("v")).select("stage", F.round(F.get("v", F.floor(F.size("v") / 2).cast("int")), 6).alias("cost"))


class Migrations:
    """Versioned changes of a store: functions named 001_name, ... applied in order, each once; what is applied is kept in a table of the store."""

    LOG = "version string, name string, applied_at timestamp"

    def __init__(self, spark: SparkSession, root: str, steps: dict[str, Callable[[SparkSession, str], None]]):
        wrong = [n for n in steps if not VERSION.fullmatch(n)]
        versions = [n[:3] for n in steps if n not in wrong]
        twice = sorted({v for v in versions if versions.count(v) > 1})
        if wrong or twice:
            raise ValueError(f"names must look like 001_name, each number once: {wrong or twice}")
        self.spark, self.log, self.root, self.steps = spark, f"{root}/schema_migrations", root, dict(sorted(steps.items()))

    def applied(self) -> set[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return set()
        return {r.version for r in self.spark.read.schema(self.LOG).parquet(self.log).select("version").distinct().toLocalIterator()}

    def pending(self) -> list[str]:
        done = self.applied()
        return [n for n in self.steps if n[:3] not in done]

    def apply(self) -> list[str]:
        """Runs what is pending; a step that fails leaves itself and later ones pending."""
        now = []
        for name in self.pending():
            self.steps[name](self.spark, self.root)
            row = self.spark.range(1).select(F.lit(name[:3]).alias("version"), F.lit(name).alias("name"), F.current_timestamp().alias("applied_at"))
            row.write.mode("append").parquet(self.log)
            now.append(name)
        return now
