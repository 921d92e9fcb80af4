import os
import random

import numpy as np
import pytest

from pagestrata.llm import harm as H
from pagestrata.llm import harm_seed as S
from pagestrata.llm import harm_training as T


def test_spelling_is_normalized():
    assert H.sentences("s c r e w you, n-a-k-e-d! $3xo s*x") == [["screw", "you", "naked"], ["sexo", "s*x"]]
    assert H.sentences("wе dо nоt wаnt **bold** @some-one stupiddd\nnext") == [["we", "do", "not", "want", "bold", "@", "stupid"], ["next"]]
    assert H.windows(None) == [] and H.windows(" \n") == []


def test_long_sentences_give_overlapping_windows():
    found = H.windows(" ".join(f"w{chr(97 + k % 26)}o{chr(97 + k // 26)}" for k in range(100)))
    assert all(len(w) <= H.WINDOW for w in found) and found[0][H.STRIDE] == found[1][0]
    assert {x for w in found for x in w} == {f"w{chr(97 + k % 26)}o{chr(97 + k // 26)}" for k in range(100)}


def test_gradients_match_differences():
    w, rng = T.start(1), np.random.default_rng(0)
    batch = [[H.word_ids(x) for x in words] for words in (["a", "bcd", "e"], ["x", "a", "zz"])]
    labels, weight = np.array([1, 3]), np.array([1.0, 2.0])
    _, g = T.gradients(w, batch, labels, weight)
    for name in ("wf", "ub", "uf", "wa", "va", "wo", "bb"):
        at, e = tuple(rng.integers(0, s) for s in w[name].shape), 1e-5
        w[name][at] += e
        up, _ = T.gradients(w, batch, labels, weight)
        w[name][at] -= 2 * e
        down, _ = T.gradients(w, batch, labels, weight)
        w[name][at] += e
        assert g[name][at] == pytest.approx((up - down) / (4 * e), rel=1e-3, abs=1e-7)


def test_training_learns_and_scoring_agrees():
    rows = [(("good", "day", "to", "you"), 0), (("you", "are", "bad"), 1), (("they", "are", "all", "worse"), 2), (("come", "here", "now"), 3)] * 40
    w = T.train(rows, epochs=6, say=lambda *a, **k: None)
    p = H.Scorer(w).score([r for r, _ in rows[:4]])
    assert p.argmax(axis=1).tolist() == [0, 1, 2, 3] and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_shipped_weights_know_the_seeds():
    rng, scorer, right, total = random.Random(77), H.Scorer(H.load_weights()), 0, 0
    for label, templates in ((1, S.ABUSIVE), (2, S.HATEFUL), (3, S.SEXUAL), (0, S.HARMLESS)):
        for template in templates:
            text = T.fill(template, rng)
            p = scorer.score(H.windows(T.disguise(text, rng) if label else text))
            y = p[p[:, 1:].max(axis=1).argmax()]
            total += 1
            right += (y[1:].argmax() + 1 == label and y[1:].max() > 0.5) if label else y[1:].max() < H.THRESHOLD
    assert right / total > 0.93


SAMPLE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(f"{SAMPLE}/doc_labels.parquet"), reason="needs the labelled documents")
def test_held_out_documents():
    """Documents of other tables than those of the labelled sample; labels are opinions, so not all are to be found."""
    found = T.found_in(T.labelled(SAMPLE), H.Scorer(H.load_weights()))
    for category, (labelled, right, harmless) in found.items():
        assert right > 0.8 * labelled and harmless <= 5, (category, found)


def test_rounds_of_training_take_agreed_windows():
    harmful = ("you", "are", "a", "zorp", "indeed", "friend")
    plain = [("the", "lamp", "keeps", "some", chr(97 + k), "copies") for k in range(20)]
    documents = [("s", " ".join(harmful) + ". " + " ".join(plain[k]) + ".", (1, 0, 0)) for k in range(8)]
    documents += [("s", " ".join(p) + ".", (0, 0, 0)) for p in plain] + [("s", " ".join(plain[3]) + ".", (0, 1, 0))]
    agreed, left = T.agreed_windows(documents)
    assert agreed == [(harmful, 1)] * 8 and left == documents[-1:]


def test_seeds_share_no_fragment_with_documents(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"text": [None, "", "I will find you, and then you pay for this."]}), tmp_path / "documents.parquet")
    assert ("and", "then", "you", "pay") in T.shared_fragments(str(tmp_path))
    if os.path.exists(f"{SAMPLE}/documents.parquet"):
        assert T.shared_fragments(SAMPLE) == []


def test_documents(spark):
    rows = [(1, "a", "# Title\n\nThe lamp keeps a copy. You are a complete moron and you should be ashamed of this reply."), (2, "a", None), (3, None, ""), (4, "b", "x " * 100_000),
            (5, "b", "Our filter replaces words such as \"idiot\" by stars."), (None, "b", "Go drown in a swamp you moron"), (1, "a", "Go drown in a swamp you moron")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, source string, text string, abusive string")
    assert {tuple(r) for r in H.harmful_documents(docs).collect()} == {(1, "abusive")}
    rates = {r.source: (r.documents, r.abusive_documents) for r in H.rates_by_source(docs).collect()}
    assert rates == {"a": (3, 2), None: (1, 0), "b": (2, 0)}
    assert H.score_documents(docs.limit(0)).count() == 0


def test_a_passage_over_two_lines_is_seen_whole(spark):
    first, second = "we all agree that people of that", "religion are vermin and must be expelled"
    docs = spark.createDataFrame([(1, "a", f"{first}\n{second}"), (2, "a", f"{first} {second}")], "doc_id long, source string, text string")
    assert {tuple(r) for r in H.harmful_documents(docs).collect()} == {(1, "hateful"), (2, "hateful")}
    words = [f"w{chr(97 + k % 26)}o{chr(97 + k // 26)}" for k in range(90)]
    found = H.scored_windows("\n".join(" ".join(words[k : k + 6]) for k in range(0, 90, 6)))
    assert all(any(tuple(words[k : k + H.STRIDE]) == w[j : j + H.STRIDE] for w in found for j in range(len(w))) for k in range(77))


def test_all_trigrams_of_a_long_word_count():
    letters = "thispageiswrittenforthosewhoreadmanualsandyouareamoron"
    assert len(H.word_ids(letters)[1]) == len(letters)
    assert H.sentences(" ".join(letters)) == [[letters]]
    assert H.word_ids(letters)[1] != H.word_ids(letters[:-5] + "queen")[1]
