"""Quality rules, line dedup and licence scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import DOC, empty, odd
from lectern.llm import license_scan as L
from lectern.llm import line_dedup as D
from lectern.llm import quality_rules as Q


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    f = D.CuckooFilter(6000)
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    before = f.blob()
    tiny = D.CuckooFilter(4)
    assert not tiny.insert(keys[:100]) and not tiny.table.any() and f.blob() == before


def state(store):
    return sorted((r["k1"], r["k2"], r["docs"], r["occurrences"]) for r in store.counts().collect())


def held(store):
    """Whether each key of the store passes its shard's filter, and how many others do."""
    keys = {r["k1"] for r in store.refs().collect()}
    filters = {r["shard"]: D.CuckooFilter.of(r["filter"]) for r in store.filters().collect()}
    assert sum(r["keys"] for r in store.filters().collect()) == len(keys)
    return all(filters[k % store.shards].contains(np.array([k]))[0] for k in keys)


class Slow:
    """A store as lists, by definition."""

    def __init__(self):
        self.rows = []  # (batch, doc_id, line_no, key)
        self.batch = 0

    def insert(self, docs):
        have = {d for _, d, _, _ in self.rows}
        new = sorted((self.batch, i, n, line.strip(" \t\r")) for i, text in docs if i not in have for n, line in enumerate((text or "").split("\n")) if line.strip(" \t\r"))
        seen, again = {k for *_, k in self.rows}, set()
        for _, i, n, key in new:
            if key in seen:
                again.add((i, n))
            seen.add(key)
        self.rows += new
        self.batch += 1
        return again

    def delete(self, ids):
        self.rows = [r for r in self.rows if r[1] not in ids]
        self.batch += 1

    def clean(self, docs):
        own = {}
        for row in sorted(self.rows):
            own.setdefault(row[3], row[1:3])
        return {i: "\n".join(line for n, line in enumerate(text.split("\n")) if own.get(line.strip(" \t\r"), (i, n)) == (i, n)) for i, text in docs}


def test_store_is_incremental_reversible_and_can_be_opened_again(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_LINES", 9)
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c ", " a", f"own {i}", "", f"x{rng.randint(0, 40)}"]) for _ in range(8))) for i in range(60)]
    table = lambda ids: spark.createDataFrame([docs[i] for i in ids], "doc_id long, text string")
    store, slow = D.LineStore(spark), Slow()

    def insert(ids):
        nonlocal store
        store = D.LineStore(spark, store.path)  # as a later application would
        got = {(r["doc_id"], r["line_no"]) for r in store.insert(table(ids)).collect()}
        assert got == slow.insert([docs[i] for i in ids]) and held(store)

    def delete(ids):
        store.delete(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        slow.delete(set(ids))
        assert held(store) and {r["doc_id"] for r in store.refs().collect()} == {r[1] for r in slow.rows}

    def clean():
        there = sorted({r[1] for r in slow.rows})
        got = {r["doc_id"]: r["text"] for r in store.clean(table(there)).collect()}
        assert got == slow.clean([docs[i] for i in there])

    insert(range(40, 50))
    insert(range(10))  # of lower ids, but later
    clean()
    before = state(store)
    insert([*range(5, 30), 41])  # some for the second time
    delete(range(10, 30))
    assert state(store) == before
    insert(range(15, 60))
    delete([40, 41, 42, 99])
    insert([42])
    clean()
    shards = store.shards
    assert shards > 8
    before = state(store)
    store.compact()
    assert state(store) == before and held(store) and len(store.tables["refs"]) == 1
    insert(range(60))
    clean()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup_equals_brute_force(spark, batches):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["a", "b ", "\tc", "", f"own {i}", f"x{rng.randint(0, 99)}"]) for _ in range(6))) for i in range(80)]
    slow = Slow()
    gone = slow.insert(docs)
    out = D.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches).collect()
    assert len(out) == len(docs)
    for r in out:
        lines = docs[r["doc_id"]][1].split("\n")
        left = [x for n, x in enumerate(lines) if (r["doc_id"], n) not in gone]
        assert (r["text"], r["n_lines"], r["n_removed"], r["n_left"]) == ("\n".join(left), len(lines), len(lines) - len(left), sum(x.strip(" \t\r") != "" for x in left))


def test_line_dedup_odd_rows(spark):
    docs = odd(spark, clash=True)
    out = {(r["doc_id"], r["text"]): r for r in D.dedup_lines(docs).collect()}
    assert len(out) == docs.distinct().count() or len(out) == docs.select("doc_id", "text").distinct().count()
    assert (1, None) in out and (2, "") in out and (None, "No id at all.") in out
    assert D.line_dedup_filter(docs).columns == docs.columns
    assert D.dedup_lines(empty(spark)).count() == 0 and D.line_dedup_filter(empty(spark)).count() == 0


def word(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def boilerplate(spark):
    rows = [(i, f"Menu {i}\nText of its own, {word(i)} and {word(i * 31)}\n" + "Subscribe NOW to our list, today!" * (i % 2), "en", "site", 1) for i in range(40)]
    rows += [(100 + i, "menu 5\nsubscribe now to our list today", "en", "site", 1) for i in range(3)] + [(200, "Menu 1", "en", "other", 1), (201, "Menu 2", "en", None, 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_quality_rules(spark, broadcast_rows):
    out = {r["doc_id"]: r for r in Q.judge(boilerplate(spark), broadcast_rows).collect()}
    assert out[0]["text"] == f"Text of its own, {word(0)} and {word(0)}\n" and out[0]["n_removed"] == 1 and out[0]["kept"]
    assert out[1]["n_removed"] == 2 and not out[100]["kept"] and out[200]["kept"] and out[201]["kept"]


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_long_frequent_lines_go(spark, broadcast_rows):
    notice = "We use cookies, and so do our partners. " * 8
    rows = [(i, f"{notice}\n" + f"Own text {word(i)} " * 60, "en", "site", 1) for i in range(20)] + [(20, notice, "en", "site", 1), (21, notice, "en", "other", 1)]
    out = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, DOC), broadcast_rows).collect()}
    assert all(out[i]["text"] == f"Own text {word(i)} " * 60 and out[i]["n_removed"] == 1 and out[i]["kept"] for i in range(20))
    assert not out[20]["kept"] and out[21]["text"] == notice and out[21]["kept"]


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_quality_rules_odd_rows(spark, broadcast_rows):
    docs = odd(spark, clash=True)
    out = Q.judge(docs, broadcast_rows)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")] + ["n_lines", "n_removed", "kept"]
    assert out.where("kept").count() == 9 and out.where("n_removed > 0").count() == 0
    assert Q.judge(empty(spark), broadcast_rows).count() == 0
    assert Q.quality_filter(docs).columns == docs.columns


def test_oracles(agrees):
    agrees(D.op4_line_dedup, D.ORACLE_SQL)
    agrees(Q.op9_quality_rules, Q.ORACLE_SQL)


MIT = "\n\n".join(["MIT License", "Copyright (c) 2020 A. Person", *[L.SENTENCES[k][0] + "." for k in ("mit.grant", "mit.condition", "mit.warranty", "mit.liability")]])


def test_licences(spark):
    texts = [
        MIT.upper().replace("(THE SOFTWARE)", "(the\n“Software”)"),
        "Some words\nReleased under the MIT License.\nAll rights reserved",
        "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.",
        "This isn't released under the MIT licence, nor are all rights reserved here.",
        L.SENTENCES["mit.liability"][0] + ". " + L.SENTENCES["mit.grant"][0] + ": " + "w " * 100,
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)
    got = {}
    for r in L.scan_licences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["licence"], r["kind"]))
    assert got == {0: [("MIT", "text")], 1: [("MIT", "notice"), ("all-rights-reserved", "notice")], 2: [("Apache-2.0", "header")], 4: [("MIT", "partial")]}


def test_licence_sentences_equal_brute_force(spark):
    import re

    known = {}
    words = lambda s: tuple(re.findall(r"[a-z0-9]+", s.lower()))
    for name, variants in L.SENTENCES.items():
        for v in variants:
            known[words(v)] = name
    rng = random.Random(2)
    pool = [v for k, vs in L.SENTENCES.items() if len(vs[0]) < 90 for v in vs] + ["plain words", "more of them", "v2.0 and x"]
    texts = ["".join(rng.choice(pool) + rng.choice([". ", ".\n", "\n", "; ", "\n \n", " "]) for _ in range(8)) for _ in range(60)]
    rules = L.Rules()
    import pyarrow as pa

    got = {(r, a, b, n) for r, a, b, n in rules.sentences(pa.array(texts, pa.large_string()))}
    want = set()
    for i, t in enumerate(texts):
        for pattern in (r"(?<=[.!?;:])(?=\s|$)|\n", r"(?<=[.!?;:])(?=\s|$)|\n\s*\n"):
            at = 0
            for part in re.split(pattern, t):
                w = words(part)
                if w in known:
                    want.add((i, at, at + len(w) - 1, known[w]))
                at += len(w)
    assert got == want and len(want) > 50


def test_every_known_sentence_is_found(spark):
    import pyarrow as pa

    known = [(k, v) for k, vs in L.SENTENCES.items() for v in vs]
    for before, after in (("", ""), ("// ", "\n"), ("Words before. ", ". Words after"), ("int a;\n\n/* ", " */\nint b;")):
        texts = pa.array([before + v + after for _, v in known], pa.large_string())
        found = {(r, n) for r, _, _, n in L.Rules().sentences(texts, joined=True)}
        assert [v for i, (k, v) in enumerate(known) if (i, k) not in found] == []
    notices = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later"}
    rows = [f"// SPDX-License-Identifier: {n}\nint a;" for n in notices]
    rows += ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */", "SPDX-License-Identifier:", "MIT"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOC)
    got = sorted((r["doc_id"], r["licence"]) for r in L.scan_licences(df).collect())
    assert got == [*enumerate(notices.values()), (4, "MPL-2.0")]


def slow_match(found, rules, gap, long_gap):
    """By trying all choices of sentences in the order of the text."""
    import itertools

    used, out = set(), []
    for licence, kind, names in sorted(rules, key=lambda r: -len(r[2])):
        most = long_gap if kind == "long" else gap
        for start in range(len(found)):
            for more in itertools.combinations(range(start + 1, len(found)), len(names) - 1):
                all_ = (start, *more)
                steps = [found[b][0] - found[a][1] - 1 for a, b in zip(all_, more, strict=False)]
                if tuple(found[i][2] for i in all_) == names and not used & set(all_) and all(0 <= g <= most for g in steps):
                    used |= set(all_)
                    out.append((licence, "text" if kind == "long" else kind, list(names), found[start][0], found[all_[-1]][1]))
                    break
    return sorted(out, key=lambda m: (m[3], m[4], m[0]))


def test_rules_equal_brute_force(monkeypatch):
    monkeypatch.setattr(L, "GAP", 5)
    monkeypatch.setattr(L, "LONG_GAP", 12)
    rng = random.Random(6)
    seen = 0
    for _ in range(400):
        rules = [(f"l{i}", rng.choice(["text", "long"]), tuple(rng.choice("abcd") for _ in range(rng.randint(1, 4)))) for i in range(rng.randint(1, 5))]
        at, found = 0, set()
        for _ in range(rng.randint(0, 9)):
            at += rng.randint(0, 6)
            found.add((at, at + rng.randint(0, 4), rng.choice("abcd")))
        found = sorted(found)
        got = L.Rules({n: [n] for n in "abcd"}, rules).match(found)
        assert got == slow_match(found, rules, 5, 12)
        seen += len(got)
    assert seen > 300


def test_long_licences_by_their_telling_sentences(spark):
    fill = lambda n: " ".join(["other words"] * n) + ".\n\n"
    say = lambda *names: fill(300).join(L.SENTENCES[n][-1] + ".\n\n" for n in names)
    texts = {
        "Apache-2.0": say("apache.title", "apache.definition", "apache.contribution", "terms.end"),
        "GPL-3.0": say("gnu.verbatim", "gpl3.text", "terms.end"),
        "GPL-2.0": say("gnu.verbatim", "gpl2.text", "gpl2.intended", "terms.end"),
        "LGPL-2.1": say("gnu.verbatim", "gpl2.text", "lgpl21.text", "terms.end"),
        "AGPL-3.0": say("gnu.verbatim", "agpl3.text", "terms.end"),
        "Zlib": "\n".join(L.SENTENCES[n][0] + "." for n in ("zlib.as-is", "zlib.liability", "zlib.grant")),
        "LGPL-2.1-or-later": "; ".join(L.SENTENCES[n][0] for n in ("lgpl.free", "lgpl.terms", "lgpl21.later")) + ". " + "; ".join(L.SENTENCES[n][0] for n in ("lgpl.hope", "gpl.implied")) + ". " + L.SENTENCES["lgpl.see"][0] + ".",
        "OFL-1.1": "Licensed under the SIL Open Font License, Version 1.1.",
    }
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts.values())], DOC)
    got = sorted((r["doc_id"], r["licence"]) for r in L.scan_licences(df).collect())
    assert got == list(enumerate(texts))
    assert {n for _, _, names in L.RULES for n in names} <= set(L.SENTENCES)


def test_licences_odd_rows(spark):
    assert L.scan_licences(odd(spark, clash=True)).count() == 0 and L.scan_licences(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "All rights reserved.", "en", "s", 1)] * 2, DOC)
    assert [r["doc_id"] for r in L.scan_licences(rows).collect()] == [None, None]
    assert rows.where(F.col("doc_id").isNull()).count() == 2
