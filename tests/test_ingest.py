import json

from pyspark.sql import functions as F

from plateworks.operators.exporting import padded
from plateworks.operators.ingest import stamp_actor


def test_only_the_top_level_actor_is_stamped(spark):
    texts = ['{"x":{"actor":"a"},"actor":"b"}', '{"actor":"b","x":[{"actor":"a"}]}', '{"x":{"actor":"a"}}', '{"actor":null,"y":1}', "{}", "plain", '{"y":"}"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = {r["i"]: r["m"] for r in df.select("i", stamp_actor(F.col("body"), "human").alias("m")).collect()}
    want = [{"x": {"actor": "a"}, "actor": "human"}, {"x": [{"actor": "a"}], "actor": "human"}, {"x": {"actor": "a"}, "actor": "human"}, {"actor": "human", "y": 1}, {"actor": "human"}]
    for i, w in enumerate(want):
        assert json.loads(got[i]) == w, got[i]
    assert got[5] == "plain" and json.loads(got[6]) == {"y": "}", "actor": "human"} and got[7] is None


def test_long_batch_numbers_keep_their_digits(spark):
    rows = spark.createDataFrame([(7,), (999,), (1000,), (12345,)], "n bigint").select(padded(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["007", "999", "1000", "12345"]
