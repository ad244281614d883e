import random

import pyarrow as pa
import pytest

from fixtures import empty, odd, odd_rows
from lectern.llm import bpe

ALPHABET = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "\t", "\u3000", "\xa0", "é", "1", "2", "!", "...", "漢", "\x1c", "\r\n", "'re", "\u200b", "😀"]


@pytest.fixture
def small_chunks(monkeypatch):
    for name, value in (("LEAST", 3), ("MOST", 9), ("BITS", 2), ("WINDOW", 3)):
        monkeypatch.setattr(bpe, name, value)


def test_equals_the_tokenizer_on_whole_texts(small_chunks):
    rng = random.Random(1)
    enc = bpe.Encoder(bpe.read_vocabulary(), 200)
    for _ in range(60):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(30)]
        ids = enc.encode_all(pa.array(texts, pa.large_string()))
        assert [list(x) for x in ids] == [enc.tokenizer.encode_ordinary(t) for t in texts]
    assert enc.reused > 0


def test_shared_passages_are_encoded_once():
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(3000))
    enc = bpe.Encoder(bpe.read_vocabulary())
    texts = [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(50)) + " " + passage for _ in range(5)]
    enc.encode_all(pa.array(texts, pa.large_string()))
    assert enc.reused > enc.encoded


def test_every_kind_of_row_goes_round(spark):
    docs = odd(spark, clash=True)
    out = bpe.encode_documents(docs)
    assert [c for c in out.columns if c not in docs.columns] == ["n_tokens", "exact"]
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["exact"] == (r["text"] is not None) and (r["ids"] is None) == (r["text"] is None)
        assert r["text"] is None or r["n_tokens"] == len(r["ids"])
    back = bpe.decode_documents(out.select("doc_id", "ids"))
    assert sorted(map(repr, (r["text"] for r in back.collect()))) == sorted(map(repr, (r[1] for r in odd_rows())))
    assert bpe.encode_documents(empty(spark)).count() == 0 and bpe.decode_documents(bpe.encode_documents(empty(spark))).count() == 0


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(bpe.read_vocabulary()).decode_all(pa.array([10**7]).to_numpy(), pa.array([0, 1]).to_numpy())
