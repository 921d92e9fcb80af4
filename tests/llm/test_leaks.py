import random

from pagestrata.llm import leaks as L


def brute(docs, items, least=12):
    out = set()
    grams = {}
    for item, prompt in items:
        w = L.words_of(prompt)
        for i in range(len(w) - least + 1):
            grams.setdefault(tuple(w[i : i + least]), set()).add(item)
    for doc, text in docs:
        w = L.words_of(text)
        for i in range(len(w) - least + 1):
            out |= {(doc, item) for item in grams.get(tuple(w[i : i + least]), ())}
    return out


def test_random_documents_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for k in range(40)] + [(90, None), (91, ""), (None, "a " * 30)]
    docs = []
    for k in range(150):
        words = [rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            w = L.words_of(rng.choice(items[:40])[1])
            i = rng.randint(0, len(w))
            words[10:10] = w[i : i + rng.randint(5, 30)]
        docs.append((k, rng.choice([" ", "\n", " - ", ", "]).join(words).replace("w1", "W­1").replace("w2 ", "w​2 "), "own"))
    docs += [(900, None, None), (901, "", None), docs[3], (None, docs[3][1], None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, prompt string")
    expected = brute([d[:2] for d in docs if d[0] is not None], [i for i in items if None not in i])
    for shard in (1, 10**9):
        rows = L.leaked_passages(table, tests, shard_chars=shard).collect()
        assert len(rows) == len(set(rows)) and all(r.words >= 12 for r in rows)
        assert {(r.doc_id, r.item_id) for r in rows} == expected and len(expected) > 10
    blocks = L.leaked_passages(table, tests, block_chars=500).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in blocks} == expected
    kept = {r.doc_id for r in L.without_leaks(table, tests).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in expected}


def test_places_and_lengths(spark):
    prompt = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "before " + prompt.upper() + " after"), (2, " ".join(prompt.split()[:11])), (3, " ".join(prompt.split()[5:17]))], "doc_id long, text string")
    rows = L.leaked_passages(docs, spark.createDataFrame([(7, prompt)], "item_id long, prompt string")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 7, 1, 0, 20), (3, 7, 0, 5, 12)]
    assert L.leaked_documents(docs.limit(0), spark.createDataFrame([], "item_id long, prompt string")).count() == 0
