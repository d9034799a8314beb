"""Small tables with the awkward rows every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

BODY = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak near the quiet river bank at dusk"


def rows(seed: int = 1):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(25)]
    passage = " ".join(rnd.choices(words, k=70))
    texts += [f"{passage}\n{BODY}", f"{BODY}\n\nintro {passage} tail", BODY, BODY, f"{BODY}.", "", None, " \t\n\x0b\f\r", "a", "a b", "é ß ñ 日本語 " * 9, "x" * 3000, "ab " * 900, "\n".join([BODY, passage] * 4)]
    out = [(i * 7 % 41, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    out += [(3, BODY, None, None, None), (3, BODY, None, None, None), (None, BODY, None, None, None), (None, None, None, None, None)]
    rnd.shuffle(out)
    return out


def table(spark, data=None, **extra):
    """The rows as a table; ``extra``: further columns by name, all filled with the same value."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def ids(data):
    return [(d, t) for d, t, *_ in data]
