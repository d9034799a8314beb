import random

from plateworks.llm import latent_decontam as L
from tests.llm.fixtures import rows, table


def case(seed):
    rnd = random.Random(seed)
    words = ["term%d" % i for i in range(3000)]
    common = ["the", "of", "and", "is", "to"]
    def prose(n):
        return [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(14, 60)))) for i in range(12)]
    docs, held = [], set()
    for d in range(150):
        body = prose(rnd.randint(5, 400))
        if d % 3 == 0:
            i = rnd.randrange(12)
            passage = items[i][1].split()
            if d % 6 == 0:  # a paraphrase: words replaced, dropped and added
                passage = [rnd.choice(words) if rnd.random() < 0.15 else w for w in passage if rnd.random() > 0.1]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = passage
            held.add((d, i))
        docs.append((d, (",\n" if d % 2 else " ").join(body).title(), "en", "s", 0))
    return docs, items, held


def test_copies_and_paraphrases_are_found_and_others_left(spark):
    docs, items, held = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(table(spark, docs, item_id=5, cosine="x"), bench).collect()}
    assert got <= held
    assert {p for p in held if p[0] % 6} <= got
    assert len(got) >= 0.95 * len(held)
    kept = L.filtered(table(spark, docs), bench)
    assert kept.columns == table(spark, docs).columns and kept.count() == len(docs) - len({d for d, _ in got})


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, _ = case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in L.leaks(table(spark, docs), bench).collect()}
    monkeypatch.setattr(L, "ITEMS", 5)
    assert {(r.doc_id, r.item_id) for r in L.leaks(table(spark, docs), bench).collect()} == one


def test_long_texts_go_in_pieces(spark):
    docs, items, _ = case(5)
    df = table(spark, docs)
    weights, n = L._document_frequencies(df)
    block = L._block([(i, t.encode()) for i, t in items], df, weights, n)
    assert block.basis.shape[1] == L.LATENT and abs(L.np.linalg.norm(block.latent, axis=1) - 1).max() < 1e-3
    idf2 = L.np.log((1 + n) / (1 + weights)) ** 2
    words = [b"filler%d" % (i % 997) for i in range(2000)]
    words[1495:1495] = L.words_of(items[0][1].encode())
    whole = L.matches(words, block, idf2)
    piece, L.PIECE = L.PIECE, 500
    try:
        cut = L.matches(words, block, idf2)
    finally:
        L.PIECE = piece
    assert set(whole) == set(cut) == {0} and cut[0][1] == 1.0


def test_scores_and_products_equal_brute_force(spark):
    docs, items, _ = case(7)
    df = table(spark, docs)
    weights, n = L._document_frequencies(df)
    block = L._block([(i, t.encode()) for i, t in items], df, weights, n)
    idf = L.np.log((1 + n) / (1 + weights)) + 0.05
    for _, text, *_ in docs[:40]:
        words = L.words_of(text.encode())
        got = {(i, a, b): c for i, a, b, c in L._passages(words, block, (idf ** 2).astype("f4"))}
        want = {}
        for length in L.LENGTHS:
            for a in range(0, max(1, len(words) - length + L.STEP), L.STEP):
                passage = L.terms_of(words[a:a + length])
                for i, (_, item) in enumerate(items):
                    x = L.np.zeros(L.TERMS)
                    L.np.add.at(x, L.terms_of(L.words_of(item.encode())), 1)
                    x *= idf
                    c = (x[passage] * idf[passage]).sum() / L.np.linalg.norm(x) / L.np.sqrt((idf[passage] ** 2).sum())
                    if c >= L.COSINE or c >= L.FLOOR and L._latent_cosine(passage, block, i) >= L.LATENT_COSINE:
                        want[i, a, min(a + length, len(words))] = c
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)

    texts = [L.words_of(t.encode()) for _, t, *_ in docs[:30]] + [[], [b"x"]]
    column = block.latent_column
    weight = idf[L.np.flatnonzero(column >= 0)]
    z = L.np.random.default_rng(1).standard_normal((len(weight), 3))
    half, want = L.LENGTHS[-1] // 2, L.np.zeros_like(z)
    for words in texts:
        rows = column[L.terms_of(words)]
        for a in range(0, max(1, len(words) - half), half):
            x = L.np.zeros(len(weight))
            mine = rows[a:a + 2 * half]
            L.np.add.at(x, mine[mine >= 0], weight[mine[mine >= 0]])
            want += L.np.outer(x, x @ z)
    assert L.np.allclose(L._projected_back(texts, weight, column, z), want)


def test_long_items_are_found(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["term%d" % i for i in range(3000)]
    prose = lambda n: rnd.choices(words, k=n)
    items = [(i, " ".join(prose(n))) for i, n in enumerate((600, 600, 900, 400, 40))]
    docs = []
    for d in range(40):
        body = prose(rnd.randint(50, 400))
        if d < 20:
            at = rnd.randrange(len(body))
            copy = items[d % 5][1].split()
            body[at:at] = copy if d < 10 else [rnd.choice(words) if rnd.random() < 0.1 else w for w in copy if rnd.random() > 0.05]
        docs.append((d, " ".join(body), "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (L.ITEMS, 15):
        monkeypatch.setattr(L, "ITEMS", most)
        found = sorted((r.doc_id, r.item_id) for r in L.leaks(table(spark, docs), bench).collect())
        assert found == [(d, d % 5) for d in range(20)]


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, rows()[0][1] or "x y z u v w"), (4, "one two three four five six seven")], "item_id long, text string")
    assert L.leaks(table(spark), bench).columns[0] == "doc_id"
    L.leaks(table(spark), bench).collect()
    assert L.leaks(table(spark, []), bench).count() == 0
    assert L.leaks(table(spark), bench.where("item_id < 0")).count() == 0
    assert L.filtered(table(spark), bench).where("doc_id is null").count() == 2


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice([b"x", b"y", b"z", b"w"]) for _ in range(rnd.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert L.common_subsequence(a, b) == t[-1][-1]


def test_basis_is_fitted_on_all_documents(spark, monkeypatch):
    """One product over a table is that of every one of its texts, however the rows lie."""
    docs, items, _ = case(9)
    df = table(spark, docs)
    weights, n = L._document_frequencies(df)
    parts = [L.words_of(t.encode()) for _, t in items]
    terms = L.np.unique(L.np.concatenate([L.terms_of(w) for w in parts]))
    column = L.np.full(L.TERMS, -1, L.np.int32)
    column[terms] = L.np.arange(len(terms))
    weight = L.np.log((1 + n) / (1 + weights))[terms] + 0.05
    monkeypatch.setattr(L, "FIT_PARTS", 1)  # sums of tasks are summed again
    got = L._basis(df.repartition(7), parts, weight, column)
    q = L.np.linalg.qr(L.np.random.default_rng(42).standard_normal((len(terms), L.LATENT)))[0].astype("f4")
    for _ in range(L.POWER):
        of_docs = L._projected_back([L.words_of(t.encode()) for _, t, *_ in docs], weight, column, q)
        of_items = L._projected_back(parts, weight, column, q)
        q = L.np.linalg.qr(of_docs + of_items * max(1.0, L.np.linalg.norm(of_docs) / L.np.linalg.norm(of_items)))[0].astype("f4")
    assert L.np.allclose(L.np.linalg.svd(got.T @ q)[1], 1, atol=1e-3)
    # a corpus beyond any sample's size weighs with every copy: three times the rows, three times the product
    z = L.np.eye(len(terms), 3, dtype="f8")
    texts = [L.words_of(t.encode()) for _, t, *_ in docs]
    assert L.np.allclose(L._projected_back(texts * 3, weight, column, z), 3 * L._projected_back(texts, weight, column, z))
    assert not hasattr(L, "SAMPLE")
