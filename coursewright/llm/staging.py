"""Intermediate tables of one operator call, in the shared folder, dropped when no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coursewright.session import shared_folder

#: Narrow rows of a file, where the number of rows is known.
FILE_ROWS = 100_000


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes for ``docs`` to have no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


class Stages:
    """Named Parquet tables below the folder in ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the steps
    before.  What a returned, lazy result reads must be kept; anything else can be dropped as
    soon as the next table is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/call-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` written and read back; if it has at most ``rows`` narrow rows, in files of about FILE_ROWS, not one for each partition."""
        path = f"{self.folder}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
