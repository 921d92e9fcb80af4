import json
from datetime import datetime, timedelta

import pytest

from pagestrata.operators import schema_drift as D

FILES = "file_id long, install_id long, file_kind string, source_name string, written_at timestamp, arrived_at timestamp, body string, series string"
T0 = datetime(2024, 1, 1)


def files(*bodies, install=1, kind="manifest", source="s", first=1, days=1):
    return [
        (first + i, install, kind, source, T0 + timedelta(days=days * i), T0 + timedelta(days=days * i), b if b is None or isinstance(b, str) else json.dumps(b), "own column")
        for i, b in enumerate(bodies)
    ]


def changes(spark, rows, **kw):
    out = D.schema_changes(spark.createDataFrame(rows, FILES), **kw).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_kinds_of_change(spark):
    a = {"v": 1, "name": "x", "owner": "team", "fetch": {"n": 1, "m": 2}, "git": None, "tags": ["a"]}
    b = {"v": "1", "name": "x", "lead": "team", "fetch": {"n": 1.5, "k": 2}, "git": {"ref": "m"}, "tags": {"a": 1}}
    assert changes(spark, files(a, b)) == {
        (2, "retyped", "v", ""), (2, "renamed", "owner", "lead"), (2, "retyped", "fetch.n", ""), (2, "renamed", "fetch.m", "fetch.k"), (2, "retyped", "tags", ""),
    }


def test_only_the_outermost_path_counts(spark):
    a, b = {"a": 1, "fetch": {"n": 1}}, {"a": 1, "paths": {"x": {"y": 2}}}
    assert changes(spark, files(a, b)) == {(2, "removed", "fetch", ""), (2, "added", "paths", "")}


def test_sources_of_a_config_are_not_looked_into(spark):
    a, b = {"sources": {"x": 1}, "o": {"sources": {"x": 1}}}, {"sources": {"y": 1}, "o": {"sources": {"z": 3}}}
    assert changes(spark, files(a, b, kind="config", source=None)) == {(2, "removed", "o.sources.x", ""), (2, "added", "o.sources.z", "")}


def test_null_is_present_and_no_rename(spark):
    assert changes(spark, files({"a": None}, {"b": None})) == {(2, "removed", "a", ""), (2, "added", "b", "")}
    assert changes(spark, files({"a": None}, {"a": 3})) == set()


def test_unreadable_bodies_are_passed_over_across_buckets(spark):
    rows = files({"a": 1}, None, "", "{", '{"a": NaN}', {"a": 1, "b": 2}, "[]", {"a": 1, "b": 2}, days=9)
    assert changes(spark, rows) == {(6, "added", "b", ""), (7, "removed", "a", ""), (7, "removed", "b", ""), (8, "added", "a", ""), (8, "added", "b", "")}


def test_repeated_rows_ties_and_nulls(spark):
    rows = files({"a": 1}, {"a": "x"})
    again = rows + [rows[1]] + [(9, None, "manifest", None, None, None, '{"q": 1}', None), (10, None, "manifest", None, T0, T0, '{"q": "1"}', None), (None, 1, "manifest", "s", T0, T0, '{"z": 1}', None)]
    assert changes(spark, again) == {(2, "retyped", "a", ""), (10, "retyped", "q", "")}
    assert changes(spark, []) == set()


def test_one_series_of_many_files_against_a_plain_loop(spark):
    bodies = [{"a": k if k % 3 else str(k), f"f{k % 4}": {"n": k % 5}} for k in range(60)]
    rows = files(*bodies, days=0)  # all written at one time, so that the id decides
    expected = set()
    for k in range(1, 60):
        old, new = ({e["path"]: e["raw_type"] for e in D.path_values(json.dumps(b))} for b in bodies[k - 1 : k + 1])
        expected |= {(k + 1, "retyped", p, "") for p in old.keys() & new.keys() if old[p] != new[p]}
        gone, came = (next(p for p in a if p not in b) for a, b in ((old, new), (new, old)))
        expected |= {(k + 1, "removed", gone, ""), (k + 1, "added", came, "")}
    assert changes(spark, rows[::-1]) == expected


def test_statistics_and_table(spark):
    read = D.read_files(spark.createDataFrame(files({"n": 1}, {"n": 2}, {"n": "3"}, {"n": "x"}, {"n": None}), FILES))
    stats = {(r.path, r.raw_type): r.files for r in D.path_type_statistics(read).collect()}
    assert stats == {("n", "integer"): 2, ("n", "string"): 2, ("n", "null"): 1}
    assert D.column_types(D.path_type_statistics(read)).first().column_type == "string"
    more = D.read_files(spark.createDataFrame(files({"n": 1}, {"n": 2}, {"n": 4}, {"n": "3"}, {"n": "x"}, {"n": None}, {"n": True}), FILES))
    rows = {r.file_id: (r.as_integer, r.cast_failed) for r in D.consistent_table(more).collect()}
    assert rows == {1: (1, False), 2: (2, False), 3: (4, False), 4: (3, False), 5: (None, True), 6: (None, False), 7: (None, True)}
    wide = {r.file_id: (r.n, r.failed_casts) for r in D.wide_table(more, "manifest", {"n": "integer"}).collect()}
    assert wide[1] == (1, []) and wide[5] == (None, ["n"])


def test_path_values_of_odd_bodies():
    assert D.path_values("x" * 10) is None and D.path_values("[1]") == [] and D.path_values('{"a":1,"a":2}')[0]["value"] == "2"
    assert D.path_values("[" * 100_000) is None and D.path_values("[" * 100_000 + "]" * 100_000) == []
    entry = lambda text: {k: v for k, v in D.path_values('{"n": ' + text + "}")[0].items() if k in ("raw_type", "value")}
    assert entry("9" * 5000) == {"raw_type": "integer", "value": "9" * 5000}
    assert entry("1e999") == {"raw_type": "decimal", "value": "1E+999"}
    deep = "[" * 50_000 + '{"b": [1, 2.5, "x,]", null, {}, []], "a": true}' + "]" * 50_000
    assert entry(deep)["raw_type"] == "list" and entry(deep)["value"] == "[" * 50_000 + '{"a": true, "b": [1, 2.5, "x,]", null, {}, []]}' + "]" * 50_000
    objects = D.path_values('{"a":' * 3000 + "1" + "}" * 3000)
    assert len(objects) == 3000 and objects[-1]["path"] == ".".join("a" * 3000)


def test_the_parser_of_deep_bodies_agrees():
    good = ['{"a": [1, -2.5e3, "x\\"y", true, false, null], "b": {"c": {}}, "d": []}', "3", '"s"', " [ ] ", "[[1],[2,[3]]]", "{}"]
    bad = ["", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "]", "[}", "{1:2}", "[1]]", '{"a":1,}', "tru", "01", "[NaN]", '"a', "[,1]", ":", '{"a":1 "b":2}']
    assert [D._nested(t) for t in good] == [json.loads(t) for t in good]
    for text in bad:
        with pytest.raises(ValueError):
            D._nested(text)


def test_an_integer_of_many_digits_is_no_change_of_type(spark):
    assert changes(spark, [(1, 1, "m", "s", T0, T0, '{"n": 1}', None), (2, 1, "m", "s", T0 + timedelta(1), T0, '{"n": ' + "7" * 5000 + "}", None)]) == set()
