"""Scoring by chunks with a manifest: what was scored from the same rows by the same model is never scored again.

A chunk's digest is made of its rows, whatever their order and files; with the model's digest it is the key of the chunk's output. Output lies in a folder for
each commit; the manifest (chunk, key, folder, rows, version) is written after it, so rows of a commit that didn't end are never read. Chunks are committed
some at a time: a stopped run has lost at most one such lot, and the next one goes on with the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import content_digests
from ..storage import written

MANIFEST = "chunk string, key string, folder string, rows long, version long"
#: Chunks of a commit.
LOT = 64


def chunk_digests(rows: DataFrame, chunk: str) -> DataFrame:
    """chunk, digest: of all columns of its rows, by sums and exclusive ors of two hashes, so nothing is sorted or collected. Rows repeated count each time."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    hashed = rows.select(F.col(chunk).cast("string").alias("chunk"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("other"), *columns).alias("b"))
    nulls = F.sha2(F.concat_ws(",", *(F.lit(c) for c in sorted(rows.columns))), 256)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    sums = hashed.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(wide("a")).alias("sa"), F.sum(wide("b")).alias("sb"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    return sums.select("chunk", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "sa", "sb", "xa", "xb")), nulls), 256).alias("digest"))


def model_digest(spark: SparkSession, path: str) -> str:
    """One digest of all files of a saved model, by their names and contents."""
    files = content_digests(spark, path).filter(~F.col("path").rlike(r"/[._][^/]*$")).select(F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), "size", "sha256").alias("f"))
    return files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list("f"))), 256)).first()[0]  # a model's files


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's newest row of each chunk; none before the first commit."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows.groupBy("chunk").agg(F.max_by(F.struct("key", "folder", "rows", "version"), "version").alias("m")).select("chunk", "m.*")


def pending(rows: DataFrame, chunk: str, model: str, path: str) -> DataFrame:
    """chunk, key, status of chunks against the manifest: new, changed (rows or model), unchanged, or gone from the input."""
    wanted = chunk_digests(rows, chunk).select("chunk", F.sha2(F.concat_ws("|", "digest", F.lit(model)), 256).alias("key"))
    known = manifest(rows.sparkSession, path).filter("folder IS NOT NULL").select(F.col("chunk").alias("_chunk"), F.col("key").alias("_key"))
    both = wanted.join(known, F.col("chunk").eqNullSafe(F.col("_chunk")), "full")
    status = F.when(F.col("key").isNull(), "gone").when(F.col("_key").isNull(), "new").when(F.col("key") == F.col("_key"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("chunk", "_chunk").alias("chunk"), "key", status.alias("status"))


def score_changed(rows: DataFrame, chunk: str, predict: Callable[[DataFrame], DataFrame], model: str, path: str, lot: int = LOT, stop: Callable[[], bool] | None = None) -> dict[str, int]:
    """Scores the chunks whose rows or model (its digest) aren't those of the manifest, `lot` chunks a commit, and tells how many chunks were scored, unchanged,
    gone and left. `stop` is asked before each commit. Chunks gone from the input leave the result. predict keeps the chunk's column.

    One run at a time writes a path: two at once would both score, and the later commit of a chunk would count. Rows with a null chunk are a chunk."""
    spark = rows.sparkSession
    found = pending(rows, chunk, model, path)
    todo = written(found.filter("status <> 'unchanged'").withColumn("n", F.monotonically_increasing_id()), "chunks-pending")
    told = {r.status: r["count"] for r in found.groupBy("status").count().collect()}  # a few numbers
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    gone = todo.filter("status = 'gone'")
    if told.get("gone"):
        gone.select("chunk", "key", F.lit(None).cast("string").alias("folder"), F.lit(0).cast("long").alias("rows"), F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{path}/manifest")
    out = {"scored": 0, "unchanged": told.get("unchanged", 0), "gone": told.get("gone", 0), "left": told.get("new", 0) + told.get("changed", 0)}
    lots = -(-out["left"] // lot)
    dealt = todo.filter("status <> 'gone'").select(F.col("chunk").alias("_chunk"), "key", F.pmod(F.xxhash64("chunk"), F.lit(max(lots, 1))).alias("lot"))
    for k in range(lots):
        if stop and stop():
            break
        mine = dealt.filter(F.col("lot") == k).select("_chunk", "key")
        folder = f"data/{version}-{k}-{uuid.uuid4().hex}"
        scored = predict(rows.join(mine.select("_chunk"), F.col(chunk).cast("string").eqNullSafe(F.col("_chunk")), "left_semi"))
        scored.withColumn("_chunk", F.col(chunk).cast("string")).write.parquet(f"{path}/{folder}")
        counts = spark.read.parquet(f"{path}/{folder}").groupBy(F.col("_chunk").alias("_of")).count()
        done = mine.join(counts, F.col("_chunk").eqNullSafe(F.col("_of")), "left")
        commit = written(done.select(F.col("_chunk").alias("chunk"), "key", F.lit(folder).alias("folder"), F.coalesce("count", F.lit(0)).alias("rows"), F.lit(version).cast("long").alias("version")), "chunks-commit")
        commit.write.mode("append").parquet(f"{path}/manifest")
        n = commit.count()
        out["scored"], out["left"] = out["scored"] + n, out["left"] - n
    return out


def result(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame | None:
    """The newest output of all chunks, from the folders that the manifest names; None before the first commit."""
    current = manifest(spark, path).filter("folder IS NOT NULL")
    folders = sorted(r.folder for r in current.select("folder").distinct().collect())  # commits, not chunks
    if not folders:
        return None
    read = spark.read.option("mergeSchema", "true").parquet(*(f"{path}/{f}" for f in folders))
    placed = read.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+)/[^/]+$", 1))
    placed = placed.filter(where) if where is not None else placed
    keep = current.select(F.col("chunk").alias("_c"), F.col("folder").alias("_f"))
    return placed.join(keep, F.col("_chunk").eqNullSafe(F.col("_c")) & (F.col("_folder") == F.col("_f")), "left_semi").drop("_chunk", "_folder")
