"""Streams that are stopped and started again."""

from pyspark.sql import functions as F

from coursewright.streaming import streams as M


def batches(spark, folder, *columns):
    rows = M.read_delta(spark, folder).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return {r.batch: [tuple(x) for x in r.rows] for r in rows.collect()}


def test_registry_goes_on_after_a_restart(spark):
    src, folder = M.new_folder(spark, "lines"), M.new_folder(spark, "registry")
    for n, lines in enumerate([["a", " b ", "", "a"], ["b", "c"], ["a", "c"]]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)
        M.registry(spark.readStream.text(src), folder)
        if n == 1:  # what earlier batches wrote is not read again
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/delta/batch=0")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    assert batches(spark, folder, "source", "status") == {1: [("c", "pending")]}


def test_unlock_is_emitted_once_over_restarts(spark):
    src, folder = M.new_folder(spark, "writes"), M.new_folder(spark, "unlock")
    schema = "user_id long, section_id long, lesson_id long, status string"
    lessons = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "lesson_id long, section_id long")
    nexts = spark.createDataFrame([(10, 20), (20, None)], "section_id long, next_section_id long")
    items = spark.createDataFrame([(20, "lesson", 3), (20, "quiz", 5)], "section_id long, kind string, item_id long")
    given = [
        [(7, 10, 1, "mastered"), (8, 10, 1, "mastered"), (8, 10, 2, "in_progress")],
        [(7, 10, 1, "mastered"), (7, 10, 2, "mastered"), (7, 10, 99, "mastered"), (7, 10, 2, "mastered")],
        [(7, 10, 2, "mastered"), (8, 10, 99, "mastered"), (None, 10, 1, "mastered"), (7, 20, 3, None)],
        [(8, 10, 2, "mastered"), (7, 20, 3, "mastered")],
    ]
    for rows in given:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        M.unlock(spark.readStream.schema(schema).parquet(src), lessons, nexts, items, folder)
    wave = lambda user: [(user, 20, "lesson", 3), (user, 20, "quiz", 5)]
    assert batches(spark, folder, "user_id", "section_id", "kind", "item_id") == {1: wave(7), 3: wave(8)}
