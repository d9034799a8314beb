"""Text rules of the gate and the claims: the same verdicts as the patterns they stand for, and linear in the length of a line."""

import random
import re
import time

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.operators import gate


def made(n, parts, seed, most=8):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, most))) for _ in range(n)] + [None]


def test_a_long_line_of_signs_is_ruled_in_time(spark):
    """From every hyphen the search for an address went on to the end of the line, from every sign that for a mail address."""
    n = 200_000
    lines = F.array(F.lit("ends. " + "-" * n), F.lit("x" * n + "@"), F.lit("see a-b.com now"), F.lit("- x@y.z -"))
    rows = spark.range(1).select(lines.alias("text_visible"), F.array().cast("array<string>").alias("brands"), F.array().cast("array<string>").alias("logos"))
    start = time.time()
    assert [i["rule"] for i in rows.select(gate.text_items().alias("i")).first().i] == ["DEFAULT", "DEFAULT", "CONTACT", "CONTACT"]
    assert time.time() - start < 20


def test_tests_of_presence_agree_with_their_patterns(spark):
    w = gate._W
    legal = (rf"(?:^|[^{w}.])(?:(?:" + "|".join(re.escape(f) for f in gate._PLAIN_FORMS) + r")\.*|" + "|".join(re.escape(f) for f in gate._DOTTED) + rf")(?:$|[^{w}.])")
    cases = [((gate.MAYBE_URL, gate.HAS_URL), gate.URL, ["𐐀", "a", "-", ".", "com", "IO", "рф", "рФ", " ", "\n", "www", "http", "s", "://", "HTTPS", "é", "_", "h", "w"]),
             ((gate.HAS_EMAIL,), fixed.EMAIL_PATTERN, ["a", "@", ".", " ", "\n", "é", "-"]),
             ((gate.LEGAL_FORM,), legal, ["𐐀", "inc", "ltd", ".", " ", "s.a", "b.v", "ооо", "x", "é", "_", "-", "\n", "ag", "1"])]
    for k, (fast, slow, parts) in enumerate(cases):
        rows = spark.createDataFrame([(x,) for x in made(6000, parts, k)], "t string")
        differing = rows.filter(~F.least(*[F.rlike("t", F.lit(p)) for p in (fast * 2)[:2]]).eqNullSafe(F.rlike("t", F.lit(slow)))).limit(5).collect()
        hits = rows.filter(F.rlike("t", F.lit(slow))).count()
        assert not differing and hits > 30, (fast, differing, hits)


def test_tidy_and_keywords_agree_with_a_plain_reading(spark):
    texts = made(4000, ["a", "b.", "  ", " ", "\t", "\n", "\x7f", "\u00a0", "\u2003", "«", "–", "\u200b", "é", "Ж", "!", "-", "9"], 7)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.tidy(F.col("t")).alias("tidy"), tx.keyword_parts(F.array("t"))[0].alias("part")).sort("i").collect()
    table = {ord(a): b for a, b in zip(tx._FROM, tx._TO)} | {ord(c): None for c in tx._FROM[len(tx._TO):]}
    for t, row in zip(texts, got):
        if t is None:
            assert row.tidy is None
            continue
        want = re.sub(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t.translate(table)).strip(" ")
        assert (row.tidy, row.part.original, row.part.keyword) == (want, want, re.sub(r"^[\W_]+|[\W_]+$", "", want.lower())), t


def test_claims_agree_with_a_word_by_word_reading(spark):
    texts = made(2500, ["Alpha", "beta", "NASA's", "IBM", "x9", "9", "A", "'", "-", " ", " ", " ", ". ", "! ", "Known", "knowns", "é", "O'Neil-", "US's"], 3, 14)
    corpus = ["known", "alpha", "ibm"]

    def tokens(word):
        return [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in re.findall("[a-z0-9]+", word.lower())]

    def claims(text, nouns):
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            for i, raw in enumerate(re.findall(r"[A-Za-z0-9][A-Za-z0-9'\-]*", sentence)):
                word = re.sub("'s$", "", raw).strip("'-")
                reason = "NUMBER" if re.search("[0-9]", word) else "PROPER_NOUN" if nouns and (i > 0 and re.match("[A-Z]", word) or re.fullmatch("[A-Z]{2,}", word)) else None
                if reason and not (tokens(word) and set(tokens(word)) <= set(corpus)):
                    out.append((word, "title", reason))
        return out

    def titled(text):
        words = [w for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9'\-]*", text)[1:] if len(w) >= 4]
        return bool(words) and sum(w[0].isupper() for w in words) >= 0.8 * len(words)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    known = F.array(*map(F.lit, corpus))
    found = rows.select("i", tx.is_title_case(F.col("t")).alias("titled"), *[tx.text_claims(F.col("t"), "title", known, F.lit(n)).alias(f"n{int(n)}") for n in (True, False)],
                        F.array_sort(tx.distinct_tokens(F.col("t"))).alias("tokens")).sort("i").collect()
    for t, row in zip(texts, found):
        if t is None:
            assert row.n1 is None and row.titled is None and row.tokens is None
            continue
        assert [tuple(c) for c in row.n1] == claims(t, True) and [tuple(c) for c in row.n0] == claims(t, False), t
        assert row.titled == titled(t) and row.tokens == sorted(set(tokens(t))), t
