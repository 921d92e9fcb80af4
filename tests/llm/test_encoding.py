import random

import pytest
from tokenizers import Tokenizer

from pagestrata.llm import encoding as E


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(E.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_random_texts_match_the_public_tokenizer(public):
    rng = random.Random(2)
    letters = [*"ab 's tre ve'll  \n\t\r'’12²½漢字éÀ ́!?.,-_", " ", "​", "'s", "'re", "'ll", "\x1c", "\x85", "\0", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(5000)] + ["", "a" * 3000 + "zq" * 700, " " * 500, "\n\n x"]
    ids, offsets, starts = E.Encoder(E.vocabulary_path()).encode(texts)
    for k, expected in enumerate(public.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == expected.ids, repr(texts[k])
    assert len(starts) == len(ids)


def test_documents_and_round_trip(spark, public):
    rows = [(1, "Hello wörld 日本", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello wörld 日本", "x"), (None, "a", "x"), (5, "word " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = E.encode_texts(docs, with_starts=True)
    got = encoded.collect()
    assert len(got) == len(rows)
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    one = next(r for r in got if r.doc_id == 1)
    assert one.ids == public.encode("Hello wörld 日本", add_special_tokens=False).ids and one.starts[0] == 0 and len(one.starts) == len(one.ids)
    texts = {r.doc_id: r.text for r in E.decode_ids(encoded.select("doc_id", "ids")).collect()}
    assert texts[1] == rows[0][1] and texts[5] == rows[5][1] and texts[3] == ""
    assert E.encode_texts(docs.limit(0)).count() == 0
    counts = {r.id: (r.tokens, r.documents) for r in E.token_statistics(E.encode_texts(docs.where("doc_id = 5"))).collect()}
    assert sum(t for t, _ in counts.values()) == len(next(r for r in got if r.doc_id == 5).ids)
