import re
from collections import Counter

from plateworks.llm import rule_ledger
from tests.llm.fixtures import rows, table


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if seen[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements_equal_brute_force(spark):
    data = [*rows(), (900, "a b c a b c # | <x>\nq\n q\nq\n", "en", "s", 0), (901, "one word   two", "en", "s", 0)]
    got = sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                            for r in rule_ledger.verdicts(table(spark, data)).collect())))
    want = []
    for d, t, *_ in data:
        m = brute(t)
        want.append((d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(map(repr, want))


def test_clashing_columns_and_empty_table(spark):
    assert rule_ledger.filtered(table(spark, [])).count() == 0
    df = table(spark, n_words="x", failed_bits="y")
    book = rule_ledger.ledger(df)
    assert dict(book.dtypes)["failed_bits"] == "bigint" and book.count() == df.count()
    assert rule_ledger.filtered(df).columns == df.columns


def test_policies_and_ablations_are_bit_arithmetic(spark):
    book = rule_ledger.ledger(table(spark))
    bits = [r.failed_bits for r in book.collect()]
    for r in rule_ledger.ablations(book).collect():
        policy = {"base": rule_ledger.BASE, "strict": rule_ledger.STRICT}[r.policy]
        bit = 1 << rule_ledger.RULES.index(r.rule)
        hits = [b & policy.mask for b in bits]
        assert (r.n_docs, r.n_failed, r.n_only) == (len(bits), sum(bool(h & bit) for h in hits), sum(h == bit for h in hits))
        assert (r.n_kept, r.n_kept_without) == (sum(h == 0 for h in hits), sum(h & ~bit == 0 for h in hits))
    assert "Python" not in book._jdf.queryExecution().toString()
