"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import jaccard
from sparkloom.llm.jaccard import components, jaccard_components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, n=4):
    w = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def brute(rows, percent=85):
    sets = [(i, sets_of(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed, groups=6, size=60, passages=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(60) for _ in range(passages)]
    rows, at = [], 0
    for g in range(groups):
        base = text(rng.choice([20, 90, 160]))
        for _ in range(size if g == 0 else rng.randint(2, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((at, " ".join(w)))
            at += 1
    for _ in range(120):
        w = text(rng.randint(1, 40))
        for p in rng.sample(shared, rng.randint(1, passages)):
            w = w + p
        rows.append((at, " ".join(w)))
        at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,long_column", [(1, 4), (2, 32), (3, 2)])
def test_equals_brute_force(spark, seed, long_column):
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), long_column=long_column).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_small_blocks_equal_brute_force(spark, monkeypatch):
    rows = corpus(4, groups=3, size=25)
    made = []

    def small(nodes, sets, percent, apart=jaccard._multiply_apart):
        made.append(nodes.count())
        return apart(nodes, sets, percent, most=500)

    monkeypatch.setattr(jaccard, "_multiply_apart", small)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), long_column=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and made


def test_joined_hands_out_a_forest():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(24), rng.randint(16, 22)))) for _ in range(60)]
    label, role = np.arange(60), np.array([0, 1, 2] * 20)
    links = list(jaccard._joined(sets, np.array([len(s) for s in sets]), label, role, 70))
    want = {(i, j) for i in range(60) for j in range(60) if role[i] != 1 and role[j] != 0 and i != j and 100 * len(set(sets[i]) & set(sets[j])) >= 70 * len(set(sets[i]) | set(sets[j]))}
    assert set(links) <= want and len(links) < 60
    for pairs in (want, links):
        up = list(range(60))
        for i, j in pairs:
            up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
        assert pairs is want and (whole := up) or up == whole


def test_nulls_short_texts_and_repeats(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "A\tb"), (8, "a b c"), (6, "a b"), (9, "x y z w"), (None, "x y z w")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert len(got) == len(rows)
    assert by[(7, 1)] == 6 and by[(6, 1)] == 6 and by[(8, 1)] == 8
    assert by[(3, 0)] == 3 and by[(4, 0)] == 4 and by[(9, 1)] is None


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, s long")
    assert jaccard_components(df).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[200] == 100 and got[300] == 100
