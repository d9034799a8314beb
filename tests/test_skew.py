"""Keys that hold most of the rows: right results, and no task with more than its share."""

import random
import statistics as st

from pyspark.sql import functions as F

from plateworks.operators import ingest, statistics


def test_hot_content_is_spread_and_found(spark):
    files = spark.range(4000).select(F.format_string("p%05d", "id").alias("path"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.format_string("h%d", "id")).alias("file_hash"))
    known = spark.createDataFrame([("hot", 7), ("h1", 8), ("nowhere", 9)], "file_hash string, asset bigint")
    rows = ingest.looked_up(files, known, "file_hash", "path")
    assert {r["asset"]: r["n"] for r in rows.groupBy("asset").agg(F.count("*").alias("n")).collect()} == {7: 2000, 8: 1, None: 1999}
    assert rows.select("path").distinct().count() == 4000 and rows.columns == ["file_hash", "path", "asset"]
    spread = files.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(ingest.SALTS))).groupBy("file_hash", "salt").count().agg(F.max("count")).first()[0]
    assert spread < 2 * 2000 / ingest.SALTS


def test_medians_are_exact(spark):
    rnd = random.Random(2)
    for n in (1, 2, 7, 500, 501):
        values = [round(rnd.expovariate(0.3), 3) for _ in range(n)]
        rows = [("AI", "PASSED", '{"duration_s":%s}' % v) for v in values] + [("METADATA_AI", "PASSED", '{"duration_s":2.5}')] * n + [("AI", "PASSED", "{}"), ("AI", "FAILED", '{"duration_s":99}')]
        got = {r["stage"]: (r["n"], r["median_s"], r["max_s"]) for r in statistics.durations(spark.createDataFrame(rows, "stage string, status string, message string")).collect()}
        assert got["METADATA_AI"] == (n, 2.5, 2.5)
        assert got["AI"][0] == n and abs(got["AI"][1] - st.median(values)) <= 0.0501 and abs(got["AI"][2] - max(values)) <= 0.0501
