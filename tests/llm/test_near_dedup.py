import itertools
import random
import re

import numpy as np
import pytest

from fixtures import DOC, empty, odd, words
from lectern.llm import near_dedup as N
from lectern.llm import _text as T


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(seed=3):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        base = words(rng, rng.randint(40, 120), 5000)
        for copies in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
            docs.append(" ".join(w))
    docs += [docs[0]] * 30 + [docs[1].upper() + " !!"] * 2
    rng.shuffle(docs)
    return docs


def test_groups_equal_brute_force(spark):
    docs = corpus()
    sets = [shingles(d) for d in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if jaccard(sets[i], sets[j]) >= N.THRESHOLD]
    for i, j in pairs:
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    df = spark.createDataFrame([(i, d, "en", "s", len(d)) for i, d in enumerate(docs)], DOC)
    got = {r["doc_id"]: r["keep_id"] for r in N.near_groups(df).collect()}
    assert got == {i: find(i) for i in range(len(docs)) if find(i) != i}  # of these documents no pair is missed
    left = {r["doc_id"] for r in N.drop_near_duplicates(df).collect()}
    assert left == set(range(len(docs))) - set(got)


@pytest.mark.parametrize("block", [N.BLOCK, 7])
def test_groups_do_not_depend_on_the_size_of_blocks(spark, block):
    docs = corpus(11)
    df = spark.createDataFrame([(i, d, "en", "s", len(d)) for i, d in enumerate(docs)], DOC)
    wanted = {i: min(j for j, e in enumerate(docs) if jaccard(shingles(d), shingles(e)) >= N.THRESHOLD) for i, d in enumerate(docs)}
    got = {r["doc_id"]: r["keep_id"] for r in N.near_groups(df, block=block).collect()}
    assert all(got.get(i, i) <= k for i, k in wanted.items())


@pytest.mark.parametrize("block", [N.BLOCK, 7])
def test_group_around_a_late_hub_is_whole(spark, block):
    """200 copies at about 0.67 of an original of the last doc_id, and at about 0.47 of each other."""
    rng = random.Random(8)
    hub = words(rng, 300, 100_000)
    docs = []
    for n in range(200):
        w = list(hub)
        for i in rng.sample(range(300), 21):
            w[i] = f"c{n}x{i}"
        docs.append(" ".join(w))
    docs.append(" ".join(hub))
    sets = [shingles(d) for d in docs]
    assert all(jaccard(s, sets[-1]) >= N.THRESHOLD for s in sets)
    assert sum(jaccard(a, b) >= N.THRESHOLD for a, b in zip(sets[:-1], sets[1:-1], strict=False)) < 50
    df = spark.createDataFrame([(i, d, "en", "s", len(d)) for i, d in enumerate(docs)], DOC)
    got = {(r["doc_id"], r["keep_id"]) for r in N.near_groups(df, block=block).collect()}
    assert got == {(i, 0) for i in range(1, 201)}


def test_superminhash_estimates_and_equals_slow_version():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.concatenate([sets[0][:200], sets[1][:100]]))
    elements = np.concatenate(sets)
    doc = np.repeat(np.arange(3), [len(s) for s in sets])
    sig = N.superminhash(elements, doc, 3, 128)

    def slow(items, m):
        regs = [2**64 - 1] * m
        for x in items:
            state, p = T.mix64(np.array([x], np.uint64) + T.GOLDEN)[0], list(range(m))
            for j in range(m):
                with np.errstate(over="ignore"):
                    state = T.mix64(np.array([state + T.GOLDEN], np.uint64))[0]
                k = j + int((int(state) & 0xFFFFFFFF) * (m - j) >> 32)
                r = int(T.mix64(np.array([state ^ T.U64(0xA5A5A5A5A5A5A5A5)], np.uint64))[0]) >> 8
                p[j], p[k] = p[k], p[j]
                regs[p[j]] = min(regs[p[j]], j << 56 | r)
        return regs

    assert slow(sets[0][:40], 16) == [int(x) for x in N.superminhash(sets[0][:40], np.zeros(40, int), 1, 16)[0]]
    assert abs((sig[0] == sig[2]).mean() - len(np.intersect1d(sets[0], sets[2])) / len(np.union1d(sets[0], sets[2]))) < 0.13
    again = N.superminhash(np.concatenate([sets[0], sets[0]]), np.zeros(2 * len(sets[0]), int), 1, 128)
    assert (again == sig[:1]).all()


def test_odd_rows(spark):
    got = {r["doc_id"]: r["keep_id"] for r in N.near_groups(odd(spark, clash=True)).collect()}
    assert got == {}
    assert N.drop_near_duplicates(odd(spark)).count() == odd(spark).count()
    assert N.near_groups(empty(spark)).count() == 0 and N.drop_near_duplicates(empty(spark)).count() == 0
