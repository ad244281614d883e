"""URL filters, toxicity, language identification, pipeline."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from fixtures import DOC, empty, odd
from lectern.llm import _text as T
from lectern.llm import bpe, decontaminate, language_id, near_dedup, quality_rules, toxicity, url_filter


def slow_match(url, entries):
    """The longest entry by comparing all of them."""
    got = url_filter.parts(url)
    if got is None:
        return None
    best = None
    for entry, rule in entries:
        e = url_filter.parts("x://" + entry) if entry else None
        if e is None or rule not in ("allow", "block"):
            continue
        if got[0][: len(e[0])] == e[0] and got[1][: len(e[1])] == e[1]:
            rank = (len(e[0]), len(e[1]), rule == "block")
            if best is None or rank > best[0]:
                best = (rank, (rule, ".".join(e[0][::-1]) + "".join("/" + s for s in e[1])))
    return best and best[1]


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_urls_equal_brute_force(spark, trie_bytes):
    rng = random.Random(8)
    hosts = [".".join(h) for n in (1, 2, 3) for h in itertools.product(("a", "b", "COM"), repeat=n)]
    path = lambda: "".join("/" + rng.choice("xyZ") for _ in range(rng.randint(0, 3)))
    entries = [(rng.choice(hosts) + path(), rng.choice(("allow", "block"))) for _ in range(25)] + [(None, "block"), ("", "allow"), ("a.b", None), ("a.b", "other"), ("..", "block")]
    urls = [f"{rng.choice(('http', 'HTTPS'))}://{rng.choice(('', 'u:p@'))}{rng.choice(hosts)}{rng.choice(('', ':8080', '.'))}{path()}{rng.choice(('', '/', '?q=/x', '#f'))}" for _ in range(200)]
    urls += [None, "", "a.b/x", "http://", "http:///x", "mailto:x@a.b", urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "old", "e", False) for i, u in enumerate(urls)], "page_id long, url string, rule string, entry string, kept boolean")
    out = url_filter.apply_policy(pages, spark.createDataFrame(entries, "entry string, rule string"), trie_bytes=trie_bytes)
    rows = {r["page_id"]: r for r in out.collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        want = slow_match(u, entries) or (None, None)
        assert (rows[i]["rule"], rows[i]["entry"], rows[i]["kept"]) == (*want, want[0] != "block"), u
    none = spark.createDataFrame([], "entry string, rule string")
    assert url_filter.apply_policy(pages, none, trie_bytes=trie_bytes).where("kept").count() == len(urls)
    assert url_filter.apply_policy(pages.where("false"), none, trie_bytes=trie_bytes).count() == 0


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_very_long_urls_and_ties(spark, trie_bytes):
    long_ = "http://" + "a." * 60 + "x.com/" + "/".join(["s"] * 50_000)
    pages = spark.createDataFrame([(1, long_), (2, long_ + "/t"), (3, "http://x.com/s/s"), (4, "http://x.com/s")], "page_id long, url string")
    entries = spark.createDataFrame([("x.com/s/s", "allow"), ("x.com/s/s", "block"), ("x.com", "allow"), ("a.x.com", "block"), ("a.a.x.com/s/s/s", "allow"), ("a.a.x.com/s", "block")], "entry string, rule string")
    got = {r["page_id"]: (r["rule"], r["entry"]) for r in url_filter.apply_policy(pages, entries, trie_bytes=trie_bytes).collect()}
    assert got == {1: ("allow", "a.a.x.com/s/s/s"), 2: ("allow", "a.a.x.com/s/s/s"), 3: ("block", "x.com/s/s"), 4: ("allow", "x.com")}


def test_url_oracle(agrees):
    assert agrees(url_filter.op1_url_filter, url_filter.ORACLE_SQL) > 0


def held_out():
    import duckdb

    rows = duckdb.sql("SELECT text, toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) WHERE lang = 'en' ORDER BY md5(CAST(doc_id AS VARCHAR))").to_arrow_table()
    return T.strings(rows.column("text")), rows.column("toxic").to_numpy() == 1


def test_toxicity_on_held_out_rows():
    texts, toxic = held_out()
    k = len(texts) * 2 // 3
    model = toxicity.fit(texts.slice(0, k), toxic[:k])
    score, truth = model.scores(texts.slice(k)), toxic[k:]
    assert (score[truth] >= toxicity.THRESHOLD).mean() > 0.85 and (score[~truth] >= toxicity.THRESHOLD).mean() < 0.02
    spelt = pa.array([t.replace("idiot", "idiiot").replace("stupid", "stuppid").replace("trash", "trashh") for t in texts.slice(k).to_pylist()], pa.large_string())
    assert (model.scores(spelt)[truth] >= toxicity.THRESHOLD).mean() > 0.8


def test_bags_equal_slow_version():
    texts = T.strings(pa.array(["ab abc ab", "", "Abc é?"], pa.large_string()))
    b = toxicity.bags(texts)
    assert b.tokens.tolist() == [3, 0, 2] and len(b.grams) == 3
    # a word of n bytes between two marks has n + 3 - k n-grams of each length k, and itself
    sizes = sorted(1 + sum(max(0, n + 3 - k) for k in toxicity.LENGTHS) for n in (2, 3, 2))
    assert sorted(b.grams.tolist()) == sizes


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_hash(data):
    """The polynomial of some bytes."""
    return sum(int(T._BYTE_VALUE[b]) * pow(int(T._BASE), i, 1 << 64) for i, b in enumerate(data)) & M64


def slow_buckets(word):
    """Buckets of a word itself and of its n-grams between the marks."""
    data = word.encode()
    hashes = [mix(slow_hash(data) + len(data) * int(T.GOLDEN) & M64)]
    line = b"\x01" + data + b"\x02"
    for n in toxicity.LENGTHS:
        hashes += [mix(slow_hash(line[i : i + n]) + n * int(T.GOLDEN) & M64) for i in range(len(line) - n + 1)]
    return [h >> 64 - toxicity.BUCKET_BITS for h in hashes]


def slow_words(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def slow_shares(text):
    """{bucket: share of the document}: the mean over words of the mean over n-grams."""
    out = {}
    all_ = slow_words(text)
    for w in all_:
        grams = slow_buckets(w)
        for g in grams:
            out[g] = out.get(g, 0) + 1 / len(grams) / len(all_)
    return out


def slow_fit(texts, toxic):
    """The training by definition, one document after the other, with dense vectors."""
    shares = [slow_shares(t) for t in texts]
    some = [i for i, s in enumerate(shares) if s]
    n = np.array([sum(not toxic[i] for i in some), sum(bool(toxic[i]) for i in some)], float)
    with_ = {}
    for i in some:
        for g in shares[i]:
            with_.setdefault(g, [0, 0])[int(toxic[i])] += 1
    used = []
    for g in sorted(with_):
        both, expected = sum(with_[g]), sum(with_[g]) * n[1] / n.sum()
        chi2 = (with_[g][1] - expected) ** 2 / max(expected * (n[0] / n.sum()) * (1 - both / n.sum()), 1e-9)
        if both >= toxicity.LEAST_DOCS and chi2 > toxicity.LEAST_CHI2:
            used.append(g)
    odds = np.array([np.log((with_[g][1] + 3 * n[1] / n.sum()) / (n[1] + 3)) - np.log((with_[g][0] + 3 * n[0] / n.sum()) / (n[0] + 3)) for g in used])
    dense = np.array([[s.get(g, 0) for g in used] for s in shares])
    rng = np.random.default_rng(11)
    vectors, softmax = rng.normal(0, 0.1, (len(used), toxicity.DIMENSIONS)), rng.normal(0, 0.1, (toxicity.DIMENSIONS, 2))
    begin = dense @ odds
    means = [np.mean([begin[i] for i in some if toxic[i] == c]) for c in (0, 1)]
    scale = toxicity.SPREAD / (means[1] - means[0])
    vectors[:, 0] = odds * scale
    softmax[0] = -0.5, 0.5
    bias = np.array([1.0, -1.0]) * sum(means) / 4 * scale
    held = [np.full(p.shape, 1e-12) for p in (vectors, softmax, bias)]
    order = np.array(some)
    for _ in range(toxicity.EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), toxicity.BATCH):
            batch = order[at : at + toxicity.BATCH]
            steps = [np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(bias)]
            for i in batch:
                mean = dense[i] @ vectors
                z = np.exp(mean @ softmax + bias)
                d = (z / z.sum() - [not toxic[i], toxic[i]]) * 0.5 / n[int(toxic[i])] * n.sum() / len(batch)
                steps[0] += np.outer(dense[i], softmax @ d)
                steps[1] += np.outer(mean, d)
                steps[2] += d
            touched = (dense[batch] > 0).any(axis=0)
            steps[0] += toxicity.DECAY * vectors
            for j, (p, h, g) in enumerate(zip((vectors, softmax, bias), held, steps, strict=True)):
                where = touched if j == 0 else np.ones(len(p), bool)
                h[where] += g[where] ** 2
                p[where] -= toxicity.RATE * g[where] / np.sqrt(h[where])
    return {g: float(v @ (softmax[:, 1] - softmax[:, 0])) for g, v in zip(used, vectors, strict=True)}, float(bias[1] - bias[0])


def test_toxicity_equals_brute_force(spark):
    """Training and scores of the whole query against plain loops."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(90):
        toxic = i % 3 == 0
        pool = ["you", "awful", "idiot", "Été", "hate", "x"] if toxic else ["you", "a", "nice", "garden", "Été", "walk", "x"]
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 12))), "en", "s", 0))
        if i < 80:
            labels.append((i, int(toxic)))
    docs += [(90, None, "en", "s", 0), (91, "…?", "en", "s", 0), (92, "idiot awfull", "en", "s", 0)]
    rows = toxicity.score_toxicity(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    weight, bias = slow_fit([docs[i][1] for i, _ in labels], [t for _, t in labels])
    assert len(weight) > 20 and len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]][1]
        if not slow_words(text):
            assert r["score"] is None and not r["toxic"]
            continue
        want = 1 / (1 + np.exp(-(sum(weight.get(g, 0) * s for g, s in slow_shares(text).items()) + bias)))
        assert abs(r["score"] - want) < 2e-3 and r["toxic"] == (r["score"] >= toxicity.THRESHOLD)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (7, None), (7, 3), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd(spark, clash=True), labels).collect()
    assert len(rows) == 9 and all(not r["toxic"] for r in rows if r["score"] is None)
    both = spark.createDataFrame([(5, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd(spark), both).collect()}
    assert rows[1] is None and rows[2] is None and rows[3] is None and rows[4] is None and rows[5] is not None
    none = labels.where("false")
    assert toxicity.score_toxicity(odd(spark), none).where("score is null").count() == 9
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


def slow_letter(c):
    """A letter's vector, bit by bit."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    seed = mix(ord(c) * int(T.GOLDEN) + 8128 & mask)
    words_ = [mix(seed + i * int(T._BASE) & mask) for i in range(1, language_id.D // 64 + 1)]
    return np.array([1 if w >> b & 1 else -1 for w in words_ for b in range(64)])


def slow_bundle(text):
    row = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    row, total = " ".join(row) + " " * bool(row), np.zeros(language_id.D)
    for a, b, c in zip(row, row[1:], row[2:], strict=False):
        total += np.roll(slow_letter(a), 2) * np.roll(slow_letter(b), 1) * slow_letter(c)
    return total


def test_bundles_equal_slow_version():
    texts = ["Abca  abc", "", "xy", "é1 é", "Ünï—漢字 и кот", "😀?"]
    got = language_id.bundles(T.strings(pa.array(texts, pa.large_string())))
    for i, text in enumerate(texts):
        assert (got[i] == slow_bundle(text)).all(), text


def test_languages_equal_brute_force(spark):
    """The whole query: samples, prototypes, cosines, margins and ties."""
    rng = random.Random(3)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs = [(i, say(a, rng.randint(1, 30)), lang) for i, (lang, a) in enumerate([("xx", "abcde"), ("yy", "defgh"), ("zz", "жзик"), ("zz", "жзикab")] * 8)]
    docs += [(90, "kkk kkk", "b1"), (91, "kkk kkk", "a1"), (92, None, "xx"), (93, "", "yy"), (94, "ab cab", None), (None, "dede", "xx")]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in docs], DOC)
    unit = lambda v: v / max(np.sqrt((v * v).sum()), 1e-12)
    sums = {}
    for i, t, lang in docs:
        if i is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + unit(slow_bundle(t))
    got = language_id.identify_languages(df).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in docs:
        v = slow_bundle(t)
        if not v.any():
            assert by[i]["language"] is None and by[i]["cosine"] is None and by[i]["margin"] is None
            continue
        cos = sorted(((-round(float(unit(v) @ unit(p)), 6), lang) for lang, p in sums.items()))
        assert by[i]["language"] == cos[0][1], (i, cos)
        assert abs(by[i]["cosine"] + cos[0][0]) < 1e-4 and abs(by[i]["margin"] - (cos[1][0] - cos[0][0])) < 1e-4
    assert by[90]["language"] == by[91]["language"] == "a1" and by[90]["margin"] == 0


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, profiles = language_id.prototypes(docs.where("doc_id % 2 = 0"), 40)
    assert names == ["de", "en", "es", "fr"]
    rest = docs.where("doc_id % 2 = 1 and n_chars > 100")
    right = language_id.identify(rest, names, profiles).join(docs, "doc_id").where("language = lang").count()
    assert right >= 0.97 * rest.count()


def test_language_odd_rows(spark):
    rows = language_id.identify_languages(odd(spark, clash=True)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r["language"] for r in rows}
    assert by[1] is None and by[2] is None and by[7] == "de" and by[5] == "en"
    assert language_id.identify_languages(empty(spark)).count() == 0
    unknown = spark.createDataFrame([(1, "some text", None, "s", 1)], DOC)
    assert language_id.identify_languages(unknown).first()["language"] is None


def slow_quality(docs):
    """(doc, text) of the documents kept, by host counts of normalised lines."""
    import re
    from collections import Counter, defaultdict

    normal = lambda line: re.sub("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")
    n, total = defaultdict(Counter), Counter()
    for _, text, host in docs:
        total[host] += 1
        n[host].update({normal(line) for line in text.split("\n")} - {""})
    out = {}
    for i, text, host in docs:
        lines = text.split("\n")
        left = [x for x in lines if not (n[host][normal(x)] > quality_rules.MIN_DOCS and n[host][normal(x)] > total[host] * quality_rules.MAX_SHARE) or not normal(x)]
        bare = lambda s: len(re.sub("\\s", "", s, flags=re.ASCII))
        if len(left) == len(lines) or bare("\n".join(left)) >= quality_rules.MIN_LEFT * bare(text):
            out[i] = "\n".join(left)
    return out


def slow_lines(docs):
    """The documents without lines met before; those that this leaves without a line go."""
    seen, out = set(), {}
    for i in sorted(docs):
        left, had = [], False
        for line in docs[i].split("\n"):
            key = line.strip(" \t\r")
            if key and key in seen:
                had = True
                continue
            seen.add(key)
            left.append(line)
        if not had or any(x.strip(" \t\r") for x in left):
            out[i] = "\n".join(left)
    return out


def slow_near(docs):
    """All but the first document of each group, by the Jaccard similarity of all pairs."""
    sets = {}
    for i, t in docs.items():
        w = slow_words(t)
        if w:
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        if len(sets[i] & sets[j]) >= near_dedup.THRESHOLD * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) != i}


def slow_benchmark(docs, items):
    """The documents that hold an item within its edits: one alignment an item with all texts in a row."""
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    texts = {i: fold(t) for i, t in docs.items()}
    line, owner = [], []
    for i, t in texts.items():
        line += [*map(ord, t), *[-1] * 400]  # more than an item's length apart
        owner += [i] * (len(t) + 400)
    line, owner, steps = np.array(line), np.array(owner), np.arange(len(line) + 1, dtype=np.int32)
    found = set()
    for item in map(fold, items):
        budget = max(0, min(int(decontaminate.EDITS * len(item)), (len(item) - decontaminate.Q) // decontaminate.Q))
        row = np.zeros(len(line) + 1, np.int32)
        for k, c in enumerate(item, 1):
            new = np.minimum(row + 1, k)
            new[1:] = np.minimum(new[1:], row[:-1] + (line != ord(c)))
            row = np.minimum.accumulate(new - steps) + steps
        found |= set(owner[np.maximum(np.flatnonzero(row <= budget) - 1, 0)].tolist())
    return found


def test_pipeline_equals_brute_force(spark):
    """run() against plain versions of all its stages, none of which calls an operator."""
    import tiktoken

    import corpus_pipeline as P

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = slow_lines(slow_quality([(r["doc_id"], r["text"], r["source"]) for r in rows]))
    gone = slow_near(kept)
    left = {i: t for i, t in kept.items() if i not in gone}
    held = slow_benchmark(left, items)
    want = {i: t for i, t in left.items() if i not in held}
    assert gone and held and len(want) < len(left) < len(kept)
    out = {r["doc_id"]: r for r in P.run(spark, SMALL).collect()}
    assert {i: r["text"] for i, r in out.items()} == want
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=dict(bpe.read_vocabulary()), special_tokens={})
    assert all(r["ids"] == plain.encode_ordinary(want[i]) and r["n_chars"] == len(want[i]) for i, r in out.items())
    assert [name for name, _ in P.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "BPE"]


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline as P

    for docs in (odd(spark), odd(spark, clash=True), empty(spark)):
        columns = docs.columns
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == columns, name
            assert (out.count() > 0) == (docs.count() > 0)
        assert P.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
