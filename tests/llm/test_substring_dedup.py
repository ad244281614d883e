import random
from collections import defaultdict

import numpy as np
import pytest

from fixtures import empty, odd
from lectern.llm import substring_dedup as S


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{j}w{i}" for i in range(rng.randint(3, 25))] for j in range(8)]
    docs = {}
    for d in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            r = rng.random()
            if r < 0.4:
                w += rng.choice(passages)
            elif r < 0.5:
                w += ["x"] * rng.randint(1, 15)
            elif r < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                w += p[a : a + rng.randint(3, 12)]
            else:
                w += [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(1, 8))]
        docs[d] = " ".join(w)
    return docs | {60: docs[3], 61: docs[3], 62: "", 63: None}


def maximal_repeats(docs, length):
    """All rows by definition: every window's partner, extended token by token; then those of two documents that lie in no other."""
    words = {d: t.split() for d, t in docs.items() if t and len(t.split()) >= length}
    rep, groups = {}, defaultdict(list)
    for d in sorted(words):
        rep.setdefault(tuple(words[d]), d)
        groups[rep[tuple(words[d])]].append(d)
    rows = {(d, 0, len(words[d]), r, 0) for r, g in groups.items() for d in g if d != r}
    rows |= {(r, 0, len(words[r]), g[1], 0) for r, g in groups.items() if len(g) > 1}
    places = defaultdict(list)
    for d in sorted(groups):
        for i in range(len(words[d]) - length + 1):
            places[tuple(words[d][i : i + length])].append((d, i))
    found = defaultdict(set)
    for at in places.values():
        for j, (d, i) in enumerate(at):
            others = [p for p in at if p[0] != d]
            if not others and len(at) == 1:
                continue
            s, k = others[0] if others else at[j - 1] if j else at[1]
            a, b, lo, hi = words[d], words[s], i, i
            while lo and lo - i + k and a[lo - 1] == b[lo - 1 - i + k]:
                lo -= 1
            while hi < len(a) and hi - i + k < len(b) and a[hi] == b[hi - i + k]:
                hi += 1
            found[d, s].add((lo, -hi, abs(i - k), i - k))
    for (d, s), matches in found.items():
        reached = 0
        for lo, hi, _, shift in sorted(matches):
            if -hi > reached:
                rows.add((d, lo, -hi, s, lo - shift))
                reached = -hi
    return rows


def found(spark, docs, *args):
    rows = S.repeated_passages(spark.createDataFrame(list(docs), "doc_id long, text string"), *args).collect()
    assert all(r["n_tokens"] == r["end"] - r["begin"] for r in rows)
    got = [(r["doc_id"], r["begin"], r["end"], r["source_id"], r["source_begin"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("length", "hot"), [(6, 100_000), (7, 3), (9, 100_000)])
def test_maximal_repeats_equal_brute_force(spark, length, hot):
    docs = corpus(length) | {70: "x " * 40, 71: " ".join(f"s{i}" for i in [*range(9), 99, *range(9), 98, *range(9)]), 72: "a b c d " * 9 + "end", 73: "c d a b " * 12}
    assert found(spark, [*docs.items(), (71, docs[71]), (5, docs[5])], length, hot) == maximal_repeats(docs, length)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_a_repeat_stays_whole_where_parts_of_it_stand_earlier(spark, hot):
    long_ = [f"m{i}" for i in range(300)]
    docs = {1: " ".join(long_[10:60]) + " one", 2: " ".join(long_[100:180]) + " two", 3: "three " + " ".join(long_), 4: " ".join(long_) + " four", 5: "five " + " ".join(long_[5:295])}
    got = found(spark, docs.items(), 20, hot)
    assert got == maximal_repeats(docs, 20)
    assert (4, 0, 300, 3, 1) in got and (3, 1, 301, 4, 0) in got and {d for d, *_ in got} == set(docs)


def test_near_copies_with_many_edits(spark):
    rng = random.Random(3)
    base = [f"b{rng.randint(0, 5000)}" for _ in range(400)]
    docs = {d: " ".join(w if rng.random() > 0.03 else f"e{rng.randint(0, 9)}" for w in base) for d in range(40)}
    assert found(spark, docs.items(), 20) == maximal_repeats(docs, 20)


def test_long_texts_and_many_holders_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(S, "PER_TASK", 7)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    docs = {d: " ".join([f"u{d}x{i}" for i in range(30)] + passage[rng.randint(0, 9) :]) for d in range(60)}
    docs[60] = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(200_000)) + " " + " ".join(passage)
    docs[61] = "y z " * 20_000
    assert found(spark, docs.items(), 50) == maximal_repeats({**docs, 61: None}, 50) | {(61, 0, 39_998, 61, 2), (61, 2, 40_000, 61, 0)}


def test_odd_rows(spark):
    rows = S.repeated_passages(odd(spark, clash=True)).collect()
    assert rows == []
    assert S.repeated_passages(empty(spark)).count() == 0


def test_touching_stretches_join_as_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        begin = rng.integers(0, 40, n)
        pair = [rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(-1, 1, n)]
        x = np.stack([*pair, begin, begin + rng.integers(1, 9, n), rng.integers(0, 2, n), rng.integers(0, 2, n)], axis=1)
        out = []
        for row in sorted(x.tolist(), key=lambda r: r[:5]):
            if not out or out[-1][:3] != row[:3] or row[3] > out[-1][4]:
                out.append(row)
                continue
            one = out[-1]
            if row[3] == one[3]:
                one[5] = min(one[5], row[5])
            if row[4] == one[4]:
                one[6] = min(one[6], row[6])
            elif row[4] > one[4]:
                one[4], one[6] = row[4], row[6]
        assert sorted(S.touching(x).tolist()) == sorted(out)
