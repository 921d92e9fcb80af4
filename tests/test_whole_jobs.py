from hashlib import sha256

from pagestrata.plans import page_queries as P

KEYS = "source_name string, snapshot_label string, page_key string"


def test_html_documents_convert_every_whole_text(spark, tmp_path):
    text = "a < b & c > d " + "lamp " * 2000 + "end"
    spark.createDataFrame([(1, "en", text), (2, None, "x &amp; y"), (3, "de", None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.markdown for r in P.html_documents(spark, str(tmp_path)).collect()} == {k: sha256(t.encode()).hexdigest() for k, t in {1: text + "\n", 2: "x &amp; y\n", 3: "\n"}.items()}


def test_index_links_take_addresses_from_pages(spark, tmp_path):
    spark.createDataFrame([("s", "1", "docs/a.md", "[x](/b) https://h.example/c")], f"{KEYS}, markdown string").write.parquet(f"{tmp_path}/page_bodies.parquet")
    spark.createDataFrame([("s", "1", "docs/a.md", "https://h.example/docs/a.md"), ("s", "2", "docs/a.md", "https://other.example/a")], f"{KEYS}, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in P.index_links_by_address(spark, str(tmp_path)).select("url", "index_url").collect()}
    assert found == {(f"https://h.example/{x}", "https://h.example/docs/a.md") for x in "bc"}
