import pytest
from pyspark.sql import functions as F

from plateworks.operators import gate, readiness

VISION = ("asset_id long, title string, description string, subject string, commercial_context string, technical_subjects array<string>, keywords array<string>, "
          "people_present boolean, people_count int, brands array<string>, logos array<string>, text_visible array<string>, categories array<string>")


def vision(spark, **given):
    base = dict(asset_id=1, title="", description="", subject="", commercial_context="", technical_subjects=[], keywords=[], people_present=False, people_count=0,
                brands=[], logos=[], text_visible=[], categories=[])
    return spark.createDataFrame([{**base, **given}], VISION)


@pytest.mark.parametrize("text, rule", [
    ("Siemens S7", "BRAND"), ("ООО Ромашка", "LEGAL_FORM"), ("Acme Inc.", "LEGAL_FORM"), ("Logo ®", "LEGAL_SYMBOL"), ("patented design", "LEGAL_WORD"), ("www.site.ru", "CONTACT"), ("mail a@b.co", "CONTACT"),
    ("+7 (495) 123-45-67", "CONTACT"), ("Вектор Технологий", "PROPER_NAME"), ("STMicroelectronics", "MIXED_CASE_NAME"), ("CE", "CONFORMITY_MARK"), ("220 V", "DIGITS"), ("KM-A", "CODE"),
    ("не включать", "WARNING_WORD"), ("ENTER", "DEFAULT"), ("High Voltage", "WARNING_WORD")])
def test_visible_text_rules(spark, text, rule):
    items = vision(spark, brands=["Siemens"], text_visible=[text]).select(gate.text_items().alias("i")).first()["i"]
    assert items[0]["rule"] == rule


@pytest.mark.parametrize("given, level", [
    (dict(), "none"), (dict(people_present=True, subject="a boy at school"), "recognizable"), (dict(people_present=True, title="portrait of a man"), "recognizable"),
    (dict(people_present=True, title="worker, face not visible", subject="worker"), "partial"), (dict(people_count=1, subject="electrician"), "recognizable"),
    (dict(people_present=True, title="robotic arm"), "unclear"), (dict(people_count=2, keywords=["children's playground"], title="park"), "unclear")])
def test_people_levels(spark, given, level):
    assert gate.with_people(vision(spark, **given)).first()["people_level"] == level


def test_documents_are_found_outside_visible_text(spark):
    rows = vision(spark, subject="driver's license on a desk", text_visible=["passport"])
    stripped = gate.strip_private_text(rows).first()
    assert stripped["document_terms"] == ["driver's license"] and stripped["text_visible"] == [] and stripped["text_visible_removed"] == 1


def test_second_category_needs_a_share(spark):
    rows = vision(spark, subject="industrial machine wiring", title="factory cable in a house").withColumn("f_keywords", F.array(F.lit("tree")))
    scores = rows.select(readiness.category_scores().alias("s")).first()["s"]
    assert [(s["group"], s["score"]) for s in scores] == [("industry", 15), ("buildings", 3), ("nature", 1)]
