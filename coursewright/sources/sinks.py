"""Artifact tables: JSON export, bucketed reload and replacement by document."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.session import stage

BUCKETS = 64


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def write_artifacts(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Partitioned by a hash bucket of the document: a directory per document would not scale."""
    df.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_artifacts(spark: SparkSession, path: str, doc_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the listed documents; joining on the bucket too lets Spark prune partitions at run time."""
    wanted = doc_ids.select("doc_id").distinct().withColumn("bucket", _bucket(buckets))
    return spark.read.parquet(path).join(wanted, ["bucket", "doc_id"], "left_semi").drop("bucket")


def replace_by_document(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> None:
    """All rows of the documents in ``new`` are replaced; only their buckets are rewritten."""
    fresh = stage(new.withColumn("bucket", _bucket(buckets)))
    touched = fresh.select("bucket").distinct()
    docs = fresh.select("doc_id").distinct()
    old = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(docs, "doc_id", "left_anti")
    merged = stage(old.select(*fresh.columns).unionByName(fresh))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_json_export(artifacts: Mapping[str, DataFrame], path: str) -> None:
    """One JSON-lines folder per kind of entity."""
    for kind, df in artifacts.items():
        df.write.mode("overwrite").json(f"{path}/{kind}")


def write_files(contents: DataFrame, path: str) -> None:
    """A file for each row (name, content) below ``path``, on whatever file system that is.

    Names are the caller's, which Spark's writers do not allow.  The tasks that hold the rows write
    them where ``path`` is a folder that all machines mount, so nothing passes the driver; a file
    appears whole, and a task that is repeated writes it again.  On other file systems, which only
    the JVM can open, rows come to the driver one partition at a time.
    """
    context = contents.sparkSession.sparkContext
    of = context._jvm.org.apache.hadoop.fs.Path
    folder = of(path)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    uri = system.makeQualified(folder).toUri()
    if uri.getScheme() == "file":
        contents.select("name", "content").mapInArrow(partial(_write_batches, uri.getPath()), "n long").agg(F.sum("n")).collect()
        return
    for row in contents.toLocalIterator():
        out = system.create(of(folder, row["name"]), True)
        try:
            out.write(bytearray(row["content"]))
        finally:
            out.close()


def _write_batches(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: set[str] = set()
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            if not name.is_valid or not content.is_valid:
                raise ValueError("a file needs a name and a content")
            folder, _, last = f"{base}/{name.as_py()}".rpartition("/")
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            # Spark's scans do not see names that begin with a dot.
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(content.as_buffer())
            os.replace(part, f"{folder}/{last}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def write_graph_tables(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
