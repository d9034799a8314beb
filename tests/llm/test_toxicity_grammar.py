import zlib

import pytest

from plateworks.llm import toxicity_grammar as T
from tests.llm.fixtures import rows, table

LEXICON = T.Lexicon({b"idiot": 5.0}, {b"scum": 4.0, b"scumb": 6.0})
MACHINE = T.grammar()


@pytest.mark.parametrize("text, kind, reading, weight", [
    (b"an Idiot came by", T.INSULT, "plain", 5), (b"you are an idiot", T.INSULT, "addressed", 5), (b"what an idiot you are", T.INSULT, "addressed", 5),
    (b"he is not an idiot", T.INSULT, "negated", 5), (b"she said that he is an idiot", T.INSULT, "reported", 5), (b"scumbags everywhere", T.INSULT, "plain", 6), (b"scummy place", T.INSULT, "plain", 4),
    (b"i will kill you", T.THREAT, "addressed", 1), (b"not so far away idiot", T.INSULT, "plain", 5)])
def test_readings_of_a_clause(text, kind, reading, weight):
    found, _ = T.readings(b"first clause, " + text + b". you said no other", LEXICON, MACHINE)
    want = T.np.zeros((2, 4))
    want[kind, T.READINGS.index(reading)] = weight
    assert (found == want).all()


def test_clauses_bound_the_context_and_words_are_whole():
    found, _ = T.readings("you, idiot. not; idiot\nidiotic xidiot ßidiot".encode(), LEXICON, MACHINE)
    assert found[T.INSULT].tolist() == [10, 0, 0, 0]
    assert T.readings(None, LEXICON, MACHINE)[0].sum() == 0 and T.readings(b"", T.Lexicon({}, {}), MACHINE)[0].sum() == 0


def test_composition_runs_all_machines_at_once():
    a, b, c = T.addressed(), T.negated(), T.reported()
    for word in ([2, 3, 0, 5, 0], [4, 0, 3, 5, 5, 5, 0], [0]):
        states, state = [a.start, b.start, c.start], MACHINE.start
        for x in word:
            written = tuple(m.out[s][x] for m, s in zip((a, b, c), states))
            (p, q), r = MACHINE.out[state][x]
            assert (p, q, r) == written
            states, state = [m.step[s][x] for m, s in zip((a, b, c), states)], MACHINE.step[state][x]


def test_every_row_is_scored_as_the_model_says(spark):
    data = rows()
    model = T.Model(LEXICON, T.np.array([-2.0, *[0.5] * 9]))
    got = sorted(map(repr, map(tuple, T.scored(table(spark, data, score="x", lexicon=1), model).collect())))
    want = []
    for d, t, *_ in data:
        score = model.score(None if t is None else t.encode(), MACHINE)
        want.append((d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2, score, int(score >= 0.3)))
    assert got == sorted(map(repr, want))
    assert T.scored(table(spark, []), model).count() == 0


def test_without_labels_scores_are_zero(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(table(spark), labels)
    assert model.beta is None and {r.score for r in T.scored(table(spark), model).collect()} == {0.0}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.scored(docs, T.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 80 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
