import random

import pytest

from pagestrata.llm import splitting as S

DRAFTS = "draft_id long, section_path array<string>, markdown string, config_id int, word_count long, pieces string"
CONFIGS = "config_id int, target_words long, overlap_words long, is_default boolean"


def check(text, limit, overlap):
    spans, _ = S.boundaries(text)
    words = [text[a:b] for a, b in spans]
    pieces = S.split_text(text, limit, overlap)
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    at, before = 0, 0
    for k, (first, count, shared, _, body) in enumerate(pieces):
        assert 0 < count <= limit
        assert [w for w in body.replace("​", "x").split() or [body]] is not None
        assert S.WORD.findall(body) == words[first : first + count]
        assert first + shared == at
        assert shared == (min(overlap, before) if k else 0)
        at, before = first + count, count
    assert at == len(words)
    return pieces


@pytest.mark.parametrize("seed", range(60))
def test_random_texts_keep_every_word_and_limit(seed):
    rng = random.Random(seed)
    parts = ["word", "sentence.", "# Head", "\n", "\n\n", "- item", "```", " ", "　", "x" * 50, "ends!", "1. one"]
    text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 900)))
    limit = rng.choice([1, 2, 7, 40, 120])
    if S.WORD.search(text):
        check(text, limit, rng.choice([0, 1, 5, 39, 500]))


def test_least_number_of_balanced_pieces():
    pieces = check(" ".join(["w"] * 1000), 300, 0)
    assert len(pieces) == 4 and max(p[1] for p in pieces) - min(p[1] for p in pieces) <= 1


def test_cuts_move_to_the_strongest_boundary():
    text = "\n\n".join(["a " * 20 + "end."] * 2 + ["# Next\n" + "b " * 30 + "end."])
    assert S.split_text(text, 50, 0)[0][3] == "heading"


def test_text_without_any_boundary_and_long_text():
    check("x " * 5000, 80, 20)
    check("日本語" * 10, 1, 0)


def test_drafts(spark):
    long = " ".join(["word"] * 30)
    drafts = spark.createDataFrame([
        (1, ["a", "b"], long, 1, 3, "own"), (2, None, long, None, None, None), (3, [], None, 1, None, None), (4, [], "", 1, None, None),
        (5, [], long, 99, None, None), (6, [], "short", 1, 9999, None), (7, [], "a​b " * 10, 1, None, None), (7, [], "a​b " * 10, 1, None, None),
    ], DRAFTS)
    configs = spark.createDataFrame([(1, 10, None, False), (2, 20, 5, True), (3, None, 1, False)], CONFIGS)
    rows = S.split_drafts(drafts, configs).orderBy("draft_id", "piece_no").collect()
    assert {r.draft_id for r in rows} == {1, 2}
    assert [(r.words, r.overlap, r.section_path) for r in rows if r.draft_id == 1] == [(10, 0, ["a", "b"])] * 3
    assert sum(r.words - r.overlap for r in rows if r.draft_id == 2) == 30
    assert S.split_drafts(drafts.limit(0), configs).count() == 0
