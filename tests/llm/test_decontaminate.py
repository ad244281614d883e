import random

from pyspark.sql import functions as F

from fixtures import DOC, empty, odd, words
from lectern.llm import decontaminate as D


def edit_distance_inside(item, text):
    """Least edits between the whole item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def folded(text):
    """Lower case, other characters than letters and digits as one space; by Python's own rules."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def test_found_equals_brute_force(spark):
    rng = random.Random(7)
    items = [" ".join(words(rng, rng.randint(8, 30), 90)) for _ in range(6)]
    docs = []
    for d in range(50):
        pre, post = " ".join(words(rng, rng.randint(0, 30), 90)), " ".join(words(rng, rng.randint(0, 30), 90))
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(item))
            rng.choice([lambda: item.__setitem__(at, "z"), lambda: item.insert(at, "y"), lambda: item.pop(at)])()
        body = "".join(item)
        if d % 7 == 0:
            body = body[: len(body) // 2]
        docs.append(f"{pre}, {body.upper() if d % 2 else body}! {post}")
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], DOC)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_benchmark(df, bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            e = edit_distance_inside(folded(item), folded(t))
            if e <= D.edit_budget(len(folded(item))):
                want[i, k] = e
    assert got == want and len(want) > 10
    small = D.find_benchmark(df, bench, item_bytes=200)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in small.collect()} == want
    left = {r["doc_id"] for r in D.drop_contaminated(df, bench, item_bytes=200).collect()}
    assert left == set(range(50)) - {i for i, _ in want}


CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def test_other_scripts_equal_brute_force(spark):
    """Texts of letters that share bytes; edits, punctuation of other scripts, and texts merely alike in their bytes."""
    rng = random.Random(5)
    alphabets = [CYRILLIC, "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了人我在有他这中大来上国", "éèàüößñ" + "abc", "".join(chr(0x1D400 + i) for i in range(26))]
    items = ["—".join("".join(rng.choice(a) for _ in range(rng.randint(3, 9))) for _ in range(9)) for a in alphabets for _ in range(2)]
    docs = []
    for d in range(80):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 8)):
            item[rng.randrange(len(item))] = rng.choice("ŋ漢z ")
        docs.append("Начало… «" + "".join(item).replace("—", rng.choice(["—", " , ", "・"])) + "» конец")
    docs += ["".join(chr(ord(c) ^ 0x40) if c in CYRILLIC else c for c in items[0]), "".join(chr(ord(c) + 0x100) if c.isalnum() else c for c in items[1])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(docs)], DOC)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = D.find_benchmark(df, bench).collect()
    want = {}
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            e = edit_distance_inside(folded(item), folded(t))
            if e <= D.edit_budget(len(folded(item))):
                want[i, k] = e
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want and len(want) > 30
    for r in rows:  # the place told holds the item within its edits
        part, item = folded(docs[r["doc_id"]])[r["found_at"] : r["found_end"]], folded(items[r["item_id"]])
        assert r["item_chars"] == len(item) and whole_distance(item, part) == r["edits"]


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_the_first_of_equal_places_is_told_and_long_texts_are_searched_whole(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    filler = " ".join(words(random.Random(1), 60_000))
    df = spark.createDataFrame([(1, f"{item} and {item}", None, None, 0), (2, f"{filler} {item}", None, None, 0), (3, f"{item[:-1]} x {item}", None, None, 0)], DOC)
    rows = {r["doc_id"]: r for r in D.find_benchmark(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert (rows[1]["found_at"], rows[1]["found_end"], rows[1]["edits"]) == (0, len(item), 0)
    assert rows[2]["found_at"] == len(filler) + 1 and rows[2]["edits"] == 0
    assert (rows[3]["found_at"], rows[3]["edits"]) == (len(item) + 2, 0)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "no id at all, really"), (4, "same text here"), (4, "same text here")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in D.find_benchmark(odd(spark, clash=True), bench).collect())
    assert found == [(6, 4)] * 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_benchmark(odd(spark), none).count() == 0 and D.find_benchmark(empty(spark), bench).count() == 0
    kept = D.drop_contaminated(odd(spark, clash=True), bench)
    assert kept.columns == odd(spark, clash=True).columns and kept.where(F.col("doc_id") == 6).count() == 0 and kept.count() == 7
    assert D.drop_contaminated(odd(spark), none).count() == 9
