"""Index upkeep: change detection, missing vectors, pruning, names, and a store whose recordings are replaced one partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed(current: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """current(workspace, file_id, sha256, settings), indexed (same) -> files to index again, with the reason: forced, new, transcript or settings."""
    was = indexed.select("workspace", "file_id", F.col("sha256").alias("old_sha"), F.col("settings").alias("old_settings"))
    reason = F.when(F.lit(force), "forced").when(F.col("old_sha").isNull(), "new").when(F.col("sha256") != F.col("old_sha"), "transcript").when(F.col("settings") != F.col("old_settings"), "settings")
    return current.join(was, ["workspace", "file_id"], "left").select("workspace", "file_id", reason.alias("reason")).where("reason IS NOT NULL")


def missing(items: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Items that have no vector of the model."""
    return items.join(vectors.where(F.col("model") == model).select("id"), "id", "left_anti")


def pruned(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """Indexed files without those no longer present; refused when nothing at all is present, so a wrong path can't empty the index."""
    if present.isEmpty():
        raise ValueError("no recordings found: nothing is pruned")
    return indexed.join(present.select("workspace", "file_id").distinct(), ["workspace", "file_id"], "left_semi")


def synced_names(speakers: DataFrame, labels: DataFrame) -> DataFrame:
    """speakers(file, label, name) updated from labels(file, label, name): new names win, others stay, new labels are added."""
    new = labels.select("file", "label", F.col("name").alias("new_name"))
    return speakers.join(new, ["file", "label"], "full").select("file", "label", F.coalesce("new_name", "name").alias("name"))


def valid_names(labels: DataFrame, longest: int = 80) -> DataFrame:
    """labels(file, label, name) with names collapsed, and the rule each breaks: empty, long or repeated (whatever the case)."""
    name = F.btrim(F.regexp_replace("name", r"[ \t\n\r]+", " "))
    clean = labels.select("file", "label", name.alias("name"))
    times = clean.groupBy("file", F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("times"))
    joined = clean.withColumn("key", F.lower("name")).join(times, ["file", "key"], "left")
    rule = F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "empty").when(F.length("name") > longest, "long").when(F.col("times") > 1, "repeated")
    return joined.select("file", "label", "name", rule.alias("rule"))


def swapped(labels: DataFrame) -> DataFrame:
    """The two names of each file that has exactly two labels, exchanged; other files as they are."""
    pair = labels.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "label").alias("first"), F.max_by("name", "label").alias("last"), F.min("label").alias("low"))
    other = F.when(F.col("n") == 2, F.when(F.col("label") == F.col("low"), F.col("last")).otherwise(F.col("first"))).otherwise(F.col("name"))
    return labels.join(pair, "file").select("file", "label", other.alias("name"))


def cache_key(config: dict[str, str], files: DataFrame) -> DataFrame:
    """files(file_id, sha256) -> the SHA-256 of the settings and the file's hash as JSON with sorted keys."""
    parts = [F.lit(v).alias(k) for k, v in sorted(config.items())]
    return files.select("file_id", F.sha2(F.to_json(F.struct(F.struct(*parts).alias("config"), F.struct("file_id", "sha256").alias("inputs"))).cast("binary"), 256).alias("cache_key"))


def centroid_refined(segments: DataFrame, long: float = 6.0, brief: tuple[float, float] = (0.5, 5.0), close: float = 0.35, margin: float = 0.10) -> DataFrame:
    """segments(file, segment, speaker, seconds, embedding): short segments go to the other of two speakers when its centroid (the mean of unit vectors of long segments) is closer by
    more than the margin, in files of exactly two speakers whose centroids' cosine is over `close`."""
    from parley.functions.expressions import cosine, dot

    unit = F.transform("embedding", lambda v: v.cast("double") / F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    spread = segments.where(F.col("seconds") >= long).select("file", "speaker", F.posexplode(unit).alias("at", "v"))
    mean = spread.groupBy("file", "speaker", "at").agg(F.avg("v").alias("v")).groupBy("file", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("centroid"))
    two = mean.groupBy("file").agg(F.min_by("centroid", "speaker").alias("c1"), F.max_by("centroid", "speaker").alias("c2"), F.min("speaker").alias("s1"), F.max("speaker").alias("s2"), F.count(F.lit(1)).alias("n")).where("n = 2")
    ready = two.where(cosine(F.col("c1"), F.col("c2")) > close)
    all_two = segments.groupBy("file").agg(F.count_distinct("speaker").alias("speakers")).where("speakers = 2")
    own = segments.join(all_two.join(ready, "file"), "file", "left")
    first = F.col("speaker") == F.col("s1")
    here, there = (F.when(first == yes, cosine(F.col("embedding"), F.col("c1"))).otherwise(cosine(F.col("embedding"), F.col("c2"))) for yes in (True, False))
    flip = F.col("n").isNotNull() & F.col("seconds").between(*brief) & (there - here > margin)
    other = F.when(first, F.col("s2")).otherwise(F.col("s1"))
    return own.select("file", "segment", F.when(F.coalesce(flip, F.lit(False)), other).otherwise(F.col("speaker")).alias("speaker"), F.coalesce(flip, F.lit(False)).alias("reassigned"))


class Store:
    """Parquet tables partitioned by workspace and recording. Writing a recording replaces its partitions only; a table appears with its commit or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace", "file_id").parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("model").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def embed_missing(self, chunks: str, vectors: str, model: str, encode) -> int:
        """Vectors for the chunks that have none yet, encode(column) giving them; the number added. A crash leaves chunks without vectors, which the next run adds."""
        items = self.read(chunks)
        try:
            had = self.read(vectors)
        except Exception as e:  # no vectors have been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            had = self.spark.createDataFrame([], "id long, model string")
        todo = missing(items, had, model).select("id", encode(F.col("text")).alias("embedding"), F.lit(model).alias("model"))
        n = todo.count()
        if n:
            self.append(vectors, todo)
        return n
