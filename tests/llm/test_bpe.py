import hashlib
import random

from tokenizers import Tokenizer

from ledgerspark.llm import bpe as B
from ledgerspark.llm.common import table


def library():
    return Tokenizer.from_file(B.vocabulary_path())


def test_random_texts_as_the_library(spark):
    rnd, model, lib = random.Random(2), B.load(B.vocabulary_path()), library()
    pieces = list("ab e'sTHE  \n\t0129½²é日本語😀\x1c\x85'll_-.,!?ñŁaaaeee==--") + ["<|endoftext|>", " the", "'ve", "    ", "<|endof"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(300)] + ["a" * n for n in range(1, 200)] + [" " * n for n in range(1, 200)] + ["z" * 5000]
    for text, (ids, n, data) in zip(texts, model.encode_texts(texts)):
        expected = lib.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, expected)) and n == len(expected)
        assert data.decode("utf-8", "replace") == lib.decode(expected, skip_special_tokens=False) == model.decode(expected)


def test_query_as_the_library(spark, small):
    docs, lib = table(spark, small, "documents"), library()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = B.token_digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_round_trip(spark, documents):
    docs = documents([None, "", "a", "a", "word " * 50_000, "\u0000 <|endoftext|> é"])
    out = B.decode(B.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "a", "a", "word " * 50_000, "\u0000 <|endoftext|> é"]
    assert set(docs.columns) < set(B.encode(docs).columns)
    assert [r.n_tokens for r in B.token_digests(docs).orderBy("doc_id").collect()][:2] == [0, 0]
    assert B.token_digests(docs.limit(0)).count() == 0
