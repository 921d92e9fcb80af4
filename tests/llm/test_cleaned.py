from hashlib import sha256

import __spark_entry__ as E


def test_cleaned_tables_are_queries(spark, tmp_path):
    legal, folder = "This handbook belongs to the Lamp Guild.", str(tmp_path)
    texts = [f"# Title\n\nThe store {chr(97 + k)}x keeps what {chr(97 + k)}y wrote." for k in range(20)]
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    spark.createDataFrame([(k, "s", f"p{k}", f"{t}\n{legal}") for k, t in enumerate(texts)], "body_id long, source_name string, page_key string, markdown string").write.parquet(f"{folder}/page_bodies.parquet")
    spark.createDataFrame([(1, f"x {item} y"), (2, "a lamp")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, prompt string").write.parquet(f"{folder}/eval_items.parquet")
    wanted = {(k, sha256(t.encode()).hexdigest()) for k, t in enumerate(texts)}
    for name in ("p1_bodies", "p5_bodies"):
        assert {tuple(r) for r in E.queries()[name](spark, folder).collect()} == wanted
    assert [tuple(r) for r in E.queries()["p8_kept"](spark, folder).collect()] == [(2, sha256(b"a lamp").hexdigest())]
