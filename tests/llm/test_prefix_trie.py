import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plateworks.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, build=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if build else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        n = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = 0 if children[node] else 1
        for child in children[node]:
            a, b = below(child)
            leaves, n = leaves + a, n + b
        ends = sorted(c for c in members[node] if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, n, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, n

    if members:
        below(())
    return sorted(out, key=repr)


def same(got, rows, build=True):
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, build)


def data(seed, convs=120, roles=("user", "assistant", None), words=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rnd.choice(roles), " ".join("ab"[rnd.randrange(2)] for _ in range(rnd.randrange(words)))))
    rnd.shuffle(rows)
    return rows


AWKWARD = [(3, None, None, None), (3, 0, "user", "a\tb\n c"), (3, 0, "user", "a\tb\n c"), (None, 0, "user", "lost"), (None, None, None, None), (-7, 1, "user", "neg"), (-7, 0, "x", ""), (-27, 5, "user", "neg"),
           (40, 0, "us", "er"), (41, 0, "u", "ser"), (2 ** 40, 0, "user", "w " * 30_000), (13, 0, "user", "only")]


@pytest.mark.parametrize("seed, size, parts", [(1, 1 << 17, 3), (2, 7, 5), (3, 40, 2), (4, 1, 4)])
def test_against_brute_force(spark, seed, size, parts):
    rows = data(seed) + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS words", "2 AS key", "3 AS shard").repartition(4)
    same(T.trie(T.rebuilt(df), parts, size), rows)


def test_conversations_as_they_are(spark):
    rows = data(7, 60)
    same(T.trie(T.sequences(spark.createDataFrame(rows, SCHEMA)), 3, 9), rows, build=False)


def test_a_large_group_of_copies_is_cut_between_shards(spark):
    rows = [(c, t, "user", "same") for c in range(0, 4000, 20) for t in range(3)] + [(c, t, "user", "same") for c in range(100_000, 101_000, 20) for t in range(5)] + data(5, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    shards = T.stage(T.encoded(T.stage(T.rebuilt(df), "s"), 4, 16), "t")
    assert max(len(r.ends) for r in shards.select("ends").collect()) <= 16 * 8
    same(T.nodes(shards), rows)


def test_one_long_conversation_and_its_beginnings(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((20, 700), (40, 700), (60, 699), (80, 350), (100, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.depth): r for r in T.trie(T.sequences(df), 3, 50).collect()}
    assert len(got) == 701 and got[20, 0].n_convs == 5 and got[20, 0].n_leaves == 1 and got[20, 699].n_convs == 3 and got[20, 699].n_children == 1
    assert got[20, 0].saved_tokens == 4 + 3 * 349 + 2 * 349 + 1


def test_empty_table(spark):
    assert T.trie(T.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    assert T.trie(T.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_findclose(seed):
    rnd = random.Random(seed)
    bits, depth = [1], 1
    while len(bits) < rnd.choice([1, 3, 100, 3000]):
        up = depth < 2 or rnd.random() < rnd.choice([0.3, 0.5, 0.8])
        bits.append(int(up))
        depth += 1 if up else -1
    bits += [0] * depth
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.flatnonzero(bits)
    assert T.Parentheses(np.array(bits, np.uint8)).findclose(opens).tolist() == [want[i] for i in opens.tolist()]
