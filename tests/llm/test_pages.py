import random

import numpy as np

from pagestrata.llm import boilerplate as B
from pagestrata.llm import page_quality as Q

PAGES = "body_id long, source_name string, page_key string, markdown string, keys string, kind string"
BODY = "# Title\n\nThe result is written to the store and can be used by any worker. You can restart it at any time.\n\n- an item of the body\n- another item\n\nOur own cookie banner is described here, and the privacy notice too."


def page(k, top="", bottom=""):
    name = "".join(chr(97 + int(d)) for d in str(k)) + "ax"
    body = f"# Title\n\nThe {name} store keeps results that {name} wrote. You can restart {name} at any time.\n\n- an item of {name} here\n- another {name} item here\n\nOur own {name} cookie banner is described here, and the privacy notice too."
    return f"{top}\n\n{body}\n\n{bottom}"


def found(spark, pages):
    rows = B.boilerplate_lines(spark.createDataFrame(pages, PAGES)).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def lines_of(text, wanted):
    return {i for i, line in enumerate(text.split("\n")) if line.strip() and line.strip() in wanted}


def test_recurring_and_shaped_chrome(spark):
    menu = "- [Zones](/z)\n- [Lamps](/l)\n- [Kites](/k)"
    legal = "This handbook belongs to the Lamp Guild and may not be copied."
    odd = ["Skip to content", "Home » Lamps » Title", "**On this page**", "- [Title](#title)", "- Another part", "Was this helpful? Yes / No", "Edit this page · https://x.example/y", "© 2021 Lamp Guild",
           "We use cookies for statistics.", "You can change this at any time.", "Got it | Reject", "### Keep reading", "[Other page](/o)", "[More](/m)", "前へ 問題 — 次へ 設定", "[Previous](/a)", "[The page before](/b)"]
    top = f"{menu}\n\nSkip to content\n\nHome » Lamps » Title\n\nWe use cookies for statistics.\nYou can change this at any time.\nGot it | Reject"
    bottom = f"**On this page**\n- [Title](#title)\n- Another part\n\nWas this helpful? Yes / No\nEdit this page · https://x.example/y\n\n### Keep reading\n[Other page](/o)\n[More](/m)\n\n前へ 問題 — 次へ 設定\n\n[Previous](/a)\n[The page before](/b)\n\n> {legal}\n\n© 2021 Lamp Guild"
    texts = [page(k, top, bottom) for k in range(20)]
    wanted = {*menu.split("\n"), *odd, f"> {legal}"}
    expected = {(k, n) for k, text in enumerate(texts) for n in lines_of(text, wanted)}
    rows = [(k, "site", f"p{k}", text, "own", "own") for k, text in enumerate(texts)]
    assert found(spark, rows + [rows[0], (100, None, "p", BODY, None, None), (101, "site", None, None, None, None), (102, "site", "q", "", None, None), (103, "site", "r", " \n\t\n", None, None), (None, "site", "s", BODY, None, None)]) == expected


def test_body_is_kept(spark):
    body = "# Cookies\n\nWe explain how the cookie banner works. Home is where it starts.\n\n```\n© 2021 in code\nSkip to content\n```\n\n## See also\n\nRead the section on terms, privacy and press.\n\n| Home | Docs |\n|---|---|\n| a | b |"
    assert found(spark, [(1, "s", "p", body, None, None)]) == set()
    assert found(spark, []) == set()


def test_one_sentence_on_few_pages_is_body(spark):
    rows = [(k, "s", f"p{k}", page(k, bottom="Run `x sync` after each upgrade of Lamp to rebuild it." if k < 2 else ""), None, None) for k in range(20)]
    assert found(spark, rows) == set()


def test_main_bodies(spark):
    texts = [f"Skip to content\n\n{page(k)}" for k in range(20)]
    rows = [(k, "s", f"p{k}", text, "x", "y") for k, text in enumerate(texts)]
    out = B.main_bodies(spark.createDataFrame([*rows, (50, "s", "q", None, None, None)], PAGES)).orderBy("body_id").collect()
    assert [r.markdown for r in out] == [*[text.split("\n", 1)[1] for text in texts], None] and out[0]["keys"] == "x"


def test_nothing_goes_that_does_not_recur(spark):
    odd = ["Skip to content", "Home » Lamps » Title", "**On this page**", "Was this helpful? Yes / No", "Edit this page · https://x.example/y", "© 2021 Lamp Guild", "We use cookies for statistics.", "Home · Docs · Blog"]
    rows = [(k, "site", f"p{k}", page(k, *(["\n\n".join(odd)] if k < 3 else [])), None, None) for k in range(20)]
    assert found(spark, rows) == set()
    # one element of each kind on 4 pages of 20 is enough, whatever its words are
    tops = ["Skip to content\n\nHome » Lamps", "Open menu\n\nDocs » Kites » A", "Zum Inhalt\n\nStart » Zonen", "Mở menu\n\nDocs » Hosts"]
    rows = [(k, "site", f"p{k}", page(k, *tops[k : k + 1]), None, None) for k in range(20)]
    assert found(spark, rows) == {(k, n) for k in range(4) for n in (0, 2)}


KINDS = {
    1: ("list", "# Commands\n\nThese are the commands.\n\n" + "\n".join(f"{k}) tool{k} sync" for k in range(20))),
    2: ("list", "## 1.2.3\n\n" + "\n".join(f"* fix `a_{k}` (#{k})" for k in range(12)) + "\n\n## 1.2.2\n\n* add `b` (#1)"),
    3: ("table", "# T\n\n| a | b |\n|---|---|\n" + "\n".join(f"| `x{k}` | {k} |" for k in range(15))),
    4: ("table", "\n".join(f"lamp{k}\t{k}\tkey_{k}\t{k}.5" for k in range(15))),
    5: ("list", "\n".join(f"lamp · key_{k} · kite{k}" for k in range(15))),
    6: ("junk", "# X\n\n" + "\n".join("KwyWndZGwv5hUFTeO61OtJUsgsxFU1rQK3f4W2rVVVXDkjEG71C7e2VrrUUx" for _ in range(8))),
    7: ("junk", "lamp host lamp host lamp lamp host lamp host host lamp lamp host lamp host lamp\n" * 6),
    8: ("junk", "".join("Результат хранится в каталоге до утра, потом узел пуст.\n" for _ in range(4)).encode().decode("latin-1")),
    9: ("junk", "!function(a,b){return a.c(1)}({});!function(a,b){return a.d(2)}({});var x=function(){return y};" * 4),
    10: ("prose", BODY), 11: ("prose", None), 12: ("prose", ""), 13: ("prose", " \n "),
    14: ("prose", "# A\n\nIf the lamp is dim, run the check and wait. It takes about an hour to finish. Then look again at the list.\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |"),
}


def test_kinds_and_statistics(spark):
    rows = [(k, None, f"p{k}", text, "own", "own") for k, (_, text) in KINDS.items()]
    out = {r.body_id: r for r in Q.page_statistics(spark.createDataFrame([*rows, rows[0]], PAGES)).collect()}
    assert {k: r.kind for k, r in out.items()} == {k: kind for k, (kind, _) in KINDS.items()}
    assert out[7].duplicate_line_share > 0.7 and out[10].common_share > 0.2 and out[11].word_count == 0
    assert {tuple(r) for r in Q.pages_without_prose(spark.createDataFrame(rows, PAGES)).collect()} == {(k, kind) for k, (kind, _) in KINDS.items() if kind != "prose"}
    assert Q.page_statistics(spark.createDataFrame([], PAGES)).count() == 0


def long_line(name):
    return (
        f"The {name} service reads its settings when it starts, and keeps them until somebody asks for another file. If a value is missing, a warning appears in the journal, "
        f"but nothing stops. You can change most limits while {name} runs, though larger buffers are taken only after the next restart. Operators often raise memory first, "
        f"since slow disks hide behind generous caches. Measure before you tune: a {name} graph of one busy week tells more than any rule that was copied from elsewhere."
    )


def test_long_lines_that_differ_are_no_repetition(spark):
    texts = {1: [long_line("kite"), long_line("zone"), long_line("host")], 2: [long_line("kite")] * 4, 3: ["| a | b |", "|---|---|", "| c | d |"] + [""] + ["| e | f |", "| - | - |", "| g | h |"]}
    assert all(len(line) > 450 for line in texts[1])
    rows = [(k, None, f"p{k}", "\n\n".join(lines) if k < 3 else "\n".join(lines), None, None) for k, lines in texts.items()]
    out = {r.body_id: r for r in Q.page_statistics(spark.createDataFrame(rows, PAGES)).collect()}
    assert (out[1].kind, out[1].duplicate_line_share, out[1].duplicate_paragraph_share) == ("prose", 0, 0)
    assert (out[2].kind, out[2].duplicate_line_share, out[2].duplicate_paragraph_share) == ("junk", 0.75, 0.75)
    assert out[3].duplicate_paragraph_share == 0


REPEATS = {
    1: ("junk", "# A\n\n" + "lamp host lamp host lamp host\n" * 200),
    2: ("junk", "# A\n\n" + "問題の設定を見る" * 60 + "。"),
    3: ("junk", "\n".join(f"the lamp\n\nof host\n\nkite {k}" for k in range(30))),
    4: ("prose", BODY + "\n\nSee [one](/a), [two](/b \"x\") and `code` of the store, which is open at any time.\n\n```\n[code](/c)\n```"),
    5: ("prose", "\n".join(f"lamp {k}" for k in range(30))),
    6: ("prose", "データは毎日保存されます。設定を変えるときは、管理画面を開いてから項目を選んでください。結果は翌朝に届きます。"),
    7: ("list", "# T\n\n" + "- lamp host lamp host\n" * 30),
}


def test_repetition_of_the_page(spark):
    rows = [(k, None, f"p{k}", text, None, None) for k, (_, text) in REPEATS.items()]
    out = {r.body_id: r for r in Q.page_statistics(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: r.kind for k, r in out.items()} == {k: kind for k, (kind, _) in REPEATS.items()}
    assert out[1].cover_2_gram == out[1].cover_16_gram == 1 and out[1].repeated_share > 0.99
    assert out[4].link_count == 3 and out[6].repeated_share < 0.1


def plain_covers(tokens, lengths):
    """One page's covers, n-gram by n-gram."""
    out, again, n, total = {}, 0.0, 2, sum(lengths[t] for t in tokens)
    while n <= len(tokens):
        grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
        weight = {g: grams.count(g) * sum(lengths[t] for t in g) for g in dict.fromkeys(grams) if grams.count(g) > 1}
        if not weight:
            break
        top = max(weight, key=weight.get)
        places = {i + j for i, g in enumerate(grams) if g == top for j in range(n)}
        out[n] = sum(lengths[tokens[i]] for i in places) / total
        again = max(again, out[n] - sum(lengths[t] for t in top) / total)
        n *= 2
    return out, again


def test_covers_against_a_plain_count():
    rng = random.Random(4)
    pages = [[0, 1, 2, 0, 1, 3], [0, 0, 0, 0], [], [0], *[[rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(60))] for _ in range(60)]]
    lengths = [1, 1, 5, 3, *[rng.randrange(1, 9) for _ in range(40)]]
    of, tokens = np.array([k for k, page in enumerate(pages) for _ in page]), np.array([t for page in pages for t in page])
    out, again = Q.covers(of, tokens, np.array(lengths)[tokens])
    assert plain_covers(pages[0], lengths) == ({2: 4 / 12}, 2 / 12)
    for k, page in enumerate(pages):
        wanted, later = plain_covers(page, lengths)
        assert np.allclose([out.get(n, [0] * 99)[k] if k < len(again) else 0 for n in (2, 4, 8, 16, 32)], [wanted.get(n, 0) for n in (2, 4, 8, 16, 32)])
        assert k >= len(again) or abs(again[k] - later) < 1e-9
    none = np.zeros(0, dtype=np.int64)
    assert Q.covers(none, none, none)[0] == {}


def test_long_lines_tables_and_headings_recur(spark):
    cookies = "We use cookies " + " ".join(f"and {w} stores" for w in long_line("lamp").split())
    chrome = [long_line("legal"), "## Product areas", "- Zones", "- Lamp kit", "- Kites", "| Zones | Lamp kit | Kites |", "| Zones | Lamps | Kites | Guild |", "|---|---|---|---|", "| a1 | b2 | c3 | d4 |", cookies, " · ".join(["Home", "Docs", "Guides", "Pricing", "Support"] * 15)]
    top = f"{chrome[-1]}\n\n## Product areas\n\n- Zones\n- Lamp kit\n- Kites\n\n| Zones | Lamp kit | Kites |"
    bottom = "\n".join(chrome[6:9]) + f"\n\n{chrome[0]}\n\n{cookies}"
    assert min(map(len, (chrome[0], cookies, chrome[-1]))) > 400
    texts = [page(k, top, f"## Product {'areas' if k % 2 else 'zones'}\n\n{long_line(f'own{chr(97 + k)}')}\n\n| Option | Type | Default |\n|---|---|---|\n| lamp{chr(97 + k)} | text | none |\n\n{bottom}") for k in range(20)]
    expected = {(k, n) for k, text in enumerate(texts) for n in lines_of(text, chrome)}
    expected -= {(k, text.split("\n").index("## Product areas", 8)) for k, text in enumerate(texts) if k % 2}
    assert found(spark, [(k, "site", f"p{k}", text, None, None) for k, text in enumerate(texts)]) == expected


def test_pages_without_a_key_are_pages(spark):
    legal = "This handbook belongs to the Lamp Guild and may not be copied."
    texts = [page(k, bottom=legal) for k in range(20)]
    rows = [(k, "site", None, text, None, None) for k, text in enumerate(texts)]
    assert found(spark, [*rows, rows[0]]) == {(k, n) for k, text in enumerate(texts) for n in lines_of(text, {legal})}
    assert found(spark, [rows[0]] * 20) == set()
