import time
import unicodedata

from pyspark.sql import functions as F

from plateworks.functions import text as tx
from plateworks.operators import exporting, metadata


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in tx.stabilize(df, "v").orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_text(spark):
    values = ["  plain  text ", "“Quoted” – dash…", "soft­hyphen​", "tab\tnew\nline", "ﬁne ½", "é", "５ kW"]
    got = column(spark, values, tx.normalize_text)
    assert got == ["plain text", '"Quoted" - dash...', "softhyphen", "tab new line", "fine 1⁄2", "é", "5 kW"]
    assert column(spark, got, tx.normalize_text) == got  # a second pass changes nothing


def test_fold_and_title(spark):
    assert column(spark, ["Straße", "ΣΑΣ", "ПРИВЕТ"], tx.fold) == ["strasse", "σασ", "привет"]
    assert column(spark, ["A view...", "Done. "], tx.normalize_title) == ["A view", "Done"]


def test_terms_respect_unicode_word_boundaries(spark):
    assert column(spark, ["ООО Вектор", "ОО дом", "xОО"], lambda c: tx.has_any(c, ["ОО"])) == [False, True, False]
    assert column(spark, ["a hand tool", "handle", "hand"], lambda c: tx.found_terms(c, ["hand", "hand tool"])) == [["hand", "hand tool"], [], ["hand"]]
    assert column(spark, ["c++ code", "xc++", "c+"], lambda c: tx.contains_term(c, F.lit("c++"))) == [True, False, False]
    assert column(spark, ["robot arm and arm"], lambda c: tx.without_phrases(c, ["robot arm"])) == ["  and arm"]


def test_keywords_drop_reasons_in_order(spark):
    df = spark.createDataFrame([(["Cable, cable;  -Pipe- ", "Siemens relay", "photo", " "], ["Siemens"], [])], "raw array<string>, brands array<string>, logos array<string>")
    judged = df.select(metadata.clean_keywords(F.col("raw")).alias("j")).first()["j"]
    assert [(k["keyword"], k["reason"]) for k in judged] == [
        ("cable", None), ("cable", "DUPLICATE"), ("pipe", None), ("siemens relay", "BRAND"), ("photo", "STOPWORD"), ("", "EMPTY")]


def test_wide_comma_does_not_split_keywords(spark):
    df = spark.createDataFrame([(["red，blue"],)], "raw array<string>")
    parts = tx.stabilize(df, keywords=("raw",)).select(tx.keyword_parts(F.col("raw")).alias("p")).first()["p"]
    assert [p["keyword"] for p in parts] == ["red,blue"]


def test_claims(spark):
    df = spark.createDataFrame([("The motor has 45 kW. Made by Acme's team in Berlin", ["motor", "team"])], "t string, corpus array<string>")
    claims = df.select(tx.text_claims(F.col("t"), "description", F.col("corpus"), F.lit(True)).alias("c")).first()["c"]
    assert [(c["term"], c["reason"]) for c in claims] == [("45", "NUMBER"), ("Acme", "PROPER_NOUN"), ("Berlin", "PROPER_NOUN")]
    assert column(spark, ["Old Steel Bridge and River", "Old Steel Bridge over River", "Old steel bridge", "Old"], tx.is_title_case) == [True, False, False, False]  # 3 of 3, 3 of 4, 0 of 2, none


def test_file_names(spark):
    values = ["Старый щит IMG 2024 final", "The photo of an image", "Elevator control panel with cables inside the shaft", "Großer Zähler"]
    assert column(spark, values, lambda c: exporting.export_filename(c, F.lit(12))) == [
        "staryy_shchit_12.jpg", "untitled_12.jpg", "elevator_control_panel_12.jpg", "groer_zahler_12.jpg"]
    problems = column(spark, ["ok_12.jpg", "img_7_12.jpg", "name.jpg"], lambda c: exporting.filename_problems(c, F.lit(12)))
    assert problems == [[], ["FORBIDDEN_TOKENS"], ["SUFFIX_MISSING"]]


def test_characters_that_nfkc_changes_are_never_held_for_stable(spark):
    values = ["a" + chr(c) + "b" for c in [*range(0x20, 0xd800), *range(0xe000, 0x10000), 0x1d400, 0x1f600]]
    held = {r.v for r in spark.createDataFrame([(v,) for v in values], "v string").where(~tx._unstable(F.col("v"))).collect()}
    assert [v for v in held if unicodedata.normalize("NFKC", v) != v] == [] and {"aéb", "a b", "aяb", "a—b"} <= held


def test_phrases_go_one_after_the_other(spark):
    texts = ["robot arm and robot armed", "the robot arm robot arm", "", None, "a.b axb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.without_phrases(F.col("t"), ["robot arm", "a.b"])).collect()]
    assert got == ["  and robot armed", "the    ", "", None, "  axb"]


def test_tidy_of_every_kind_of_blank(spark):
    values = ["a\x00b\x7f\x85 c", "a　  b", " a ", "é \n\n\té", "a“ b”​ c", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(tx.tidy(F.col("v"))).collect()]
    assert got == ["a b c", "a b", "a", "é é", 'a" b" c', "", None]


def test_contains_term_looks_beyond_the_first_place(spark):
    pairs = [("handle a hand", "hand"), ("handle handy", "hand"), ("a-b", "-"), ("(x) (y)", "(y)"), ("é hand é", "hand"), ("hand", ""), ("ahand hand1 hand", "hand")]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, m string").orderBy("i").select(tx.contains_term(F.col("t"), F.col("m"))).collect()]
    assert got == [True, False, False, True, True, False, True]


def test_a_long_run_of_signs_in_a_keyword_is_gone_through_once(spark):
    """Before, each sign began a search of its own to the end of the run."""
    raw = "a" + "#" * 400_000 + "b--"
    start = time.monotonic()
    got = spark.createDataFrame([([raw],)], "raw array<string>").select(tx.keyword_parts(F.col("raw"))[0]["keyword"]).first()[0]
    assert got == raw[:-2] and time.monotonic() - start < 30
