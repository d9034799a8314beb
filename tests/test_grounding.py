"""Grounding and duplicate keywords of long documents: right, and without a search per keyword over the whole document."""

import time

from pyspark.sql import functions as F

from plateworks.functions import arrays
from plateworks.operators import metadata


def test_repeated_marks_equal_values_after_the_first(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "", "a", "b", None, None, ""],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in rows.select(arrays.repeated(F.col("v"))).collect()] == [[False, False, True, False, True, True, False, False, True], [], None]
    first = arrays.first_of_each(F.transform("v", lambda v: F.struct(v.alias("x"))), lambda s: F.coalesce(s["x"], F.lit("-")))
    assert [[s.x for s in r[0]] for r in rows.filter("v is not null").select(first).collect()] == [["b", "a", "", None], []]


def test_a_document_of_many_keywords_is_grounded_in_time(spark):
    """30,000 keywords against as many words: once per keyword over the corpus takes minutes."""
    n = 30_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), i.cast("string"), F.lit("x"))).alias("words"))
    none = F.array().cast("array<string>")
    odd = F.array(F.lit("unknown 77z"), F.lit("strange"), F.lit("word5x"))
    rows = rows.withColumns({c: none for c in ("technical_subjects", "keywords", "text_visible", "brands", "logos", "editorial_risk")} | {"title": F.lit("word1x"), "subject": F.lit(""), "commercial_context": F.lit("")}) \
        .withColumn("description", F.array_join("words", " "))
    start = time.time()
    done = metadata.with_grounding(metadata.with_fields(rows, F.col("title"), F.col("description"), F.concat("words", odd)))
    got = done.select(F.size("f_keywords").alias("kept"), F.size("vision_keywords").alias("vision"), "concept_keywords", F.transform("claims", lambda c: F.concat_ws(":", c["term"], c["reason"])).alias("claims"), "dropped").first()
    assert (got.kept, got.vision, got.concept_keywords, got.claims, got.dropped) == (n + 2, n, ["strange"], ["unknown 77z:NUMBER"], ["DUPLICATE:word5x"])
    assert time.time() - start < 40


def test_events_of_all_commands_run_the_rules_once(spark):
    from plateworks.plans import load

    rows = load()[0]["met_event_rows"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    scans = sum("Relation [doc_id" in line and "text" in line for line in plan.split("\n"))
    assert scans <= 2, scans  # the edit's documents; before, the gate's, the approval's and the rejection's as well
