"""One consistent table out of JSON files whose shape drifts, and a report of each change of shape.

Every body is read once into a path-value map with raw types. Path-type statistics by kind of file are
plain aggregates of that map; typed columns are projected from it with the failed casts reported; and the
changes are found by comparing each file's map with that of the file before it.
"""

from __future__ import annotations

import json
import math
import re
import sys
from decimal import Decimal
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.operators.ranks import with_row_number
from pagestrata.session import cut

#: The raw types, and the Spark type that a column of each is cast to.
COLUMN_TYPES = {
    "string": "string",
    "integer": "bigint",
    "decimal": "double",
    "boolean": "boolean",
    "list": "string",
    "object": "string",
}
ENTRIES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("path", "parent", "raw_type", "value")]))
SERIES = ["install_id", "file_kind", "source_name"]


#: The tokens of JSON. A string's escapes are left to the JSON parser.
_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)|([\[\]{},:]))', re.ASCII)
_LITERALS = {"true": True, "false": False, "null": None}


def _refuse(token: str) -> None:
    raise ValueError(f"{token} isn't JSON")


def _decimal(text: str) -> float | Decimal:
    """A number with a point or an exponent; one beyond a double's range is kept exactly."""
    value = float(text)
    return value if math.isfinite(value) else Decimal(text)


def _nested(body: str) -> object:
    """The value of a body nested deeper than the parser's own stack goes, by a stack of its own."""
    held: list = []  # the open containers, each with the key that waits for its value
    root, expect, at = None, "value", 0
    while True:
        token = _TOKEN.match(body, at)
        if token is None:
            if body[at:].strip(" \t\n\r") or held or expect != "end":
                raise ValueError("not JSON")
            return root
        at = token.end()
        text, number, literal, sign = token.groups()
        if sign == ":" and expect == "colon":
            expect = "value"
            continue
        if sign == "," and expect == "more":
            expect = "key" if isinstance(held[-1][0], dict) else "value"
            continue
        if sign in ("]", "}") and held and isinstance(held[-1][0], dict if sign == "}" else list) and (expect == "more" or not held[-1][0] and expect in ("first key", "first value")):
            held.pop()
            expect = "more" if held else "end"
            continue
        if expect in ("key", "first key"):
            if text is None:
                raise ValueError("not JSON")
            held[-1][1], expect = json.loads(text), "colon"
            continue
        if expect not in ("value", "first value") or sign and sign not in "[{":
            raise ValueError("not JSON")
        if sign:
            value = {} if sign == "{" else []
        elif number is not None:
            value = int(number) if number.lstrip("-").isdigit() else _decimal(number)
        else:
            value = json.loads(text) if text is not None else _LITERALS[literal]
        if not held:
            root = value
        elif isinstance(held[-1][0], dict):
            held[-1][0][held[-1][1]] = value
        else:
            held[-1][0].append(value)
        if sign:
            held.append([value, None])
            expect = "first key" if sign == "{" else "first value"
        else:
            expect = "more" if held else "end"


def _text(value: object) -> str:
    """A value as JSON with sorted keys, however deep it is."""
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False)
    except (RecursionError, TypeError):
        pass
    out, todo = [], [value]
    while todo:
        value = todo.pop()
        if isinstance(value, _Sign):
            out.append(value)
        elif isinstance(value, dict | list) and value:
            pairs = [[_Sign(json.dumps(k, ensure_ascii=False) + ": "), value[k]] for k in sorted(value)] if isinstance(value, dict) else [[v] for v in value]
            parts = [part for pair in pairs for part in (_Sign(", "), *pair)][1:]
            opening, closing = "{}" if isinstance(value, dict) else "[]"
            todo += reversed([_Sign(opening), *parts, _Sign(closing)])
        else:
            out.append(str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False))
    return "".join(out)


class _Sign(str):
    """A piece of JSON text, as against a string value."""


def _parsed(body: str) -> object:
    sys.set_int_max_str_digits(0)  # an integer is one, however long it is
    try:
        return json.loads(body, parse_constant=_refuse, parse_float=_decimal)
    except RecursionError:
        return _nested(body)


def _raw_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float | Decimal):
        return "decimal"
    if isinstance(value, str):
        return "string"
    return "list" if isinstance(value, list) else "object"


def path_values(body: str | None, opaque: tuple[str, ...] = (), digests: bool = False) -> list[dict] | None:
    """The entries of one body, containers included; None if it isn't valid JSON.

    Lists, and the objects whose path is in ``opaque``, are values of their own and aren't looked into. A
    repeated key has its last value. Valid JSON other than an object has no fields. Numbers of any length and
    bodies of any depth are read. With ``digests`` the value of a list or an object is a 128-bit hash of its text.
    """
    if body is None:
        return None
    try:
        root = _parsed(body)
    except ValueError:
        return None
    if not isinstance(root, dict):
        return []
    entries, todo = [], [("", root)]
    while todo:
        parent, held = todo.pop()
        for key, value in held.items():
            path = f"{parent}.{key}" if parent else key
            kind = _raw_type(value)
            text = value if kind == "string" else None if kind == "null" else _text(value)
            if digests and kind in ("list", "object"):
                text = xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))
            entries.append({"path": path, "parent": parent, "raw_type": kind, "value": text})
            if kind == "object" and path not in opaque:
                todo.append((path, value))
    return list({e["path"]: e for e in entries}.values())


def _entries(digests: bool):
    @F.pandas_udf(ENTRIES)
    def entries(body: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([path_values(b, ("sources",) if k == "config" else (), digests) for b, k in zip(body, kind)], dtype=object)

    return entries("body", "file_kind")


def read_files(files: DataFrame, digests: bool = False) -> DataFrame:
    """One row per file: file_id, the series columns, written_at and ``entries`` (null if unreadable).

    A file delivered more than once counts once: the row that arrived last holds, ties by the greater
    body. Rows with a null file_id are left out, as no change could be laid to them. Surrogates and other
    unusual characters are kept as they are. The rows are written once, so no body is parsed again by what reads them.
    """
    one = (
        files.where("file_id IS NOT NULL")
        .groupBy("file_id")
        .agg(F.max(F.struct("arrived_at", "written_at", *SERIES, "body")).alias("f"))
        .select("file_id", *[F.col(f"f.{c}").alias(c) for c in [*SERIES, "written_at", "body"]])
    )
    return cut(one.withColumn("entries", _entries(digests)).drop("body"))


def path_type_statistics(read: DataFrame) -> DataFrame:
    """(file_kind, path, raw_type, files, first_written, last_written): which types a path had, where and when."""
    return (
        read.where("entries IS NOT NULL")
        .select("file_kind", "file_id", "written_at", F.explode("entries").alias("e"))
        .groupBy("file_kind", F.col("e.path").alias("path"), F.col("e.raw_type").alias("raw_type"))
        .agg(F.count(F.lit(1)).alias("files"), F.min("written_at").alias("first_written"), F.max("written_at").alias("last_written"))
    )


def file_type_statistics(read: DataFrame) -> DataFrame:
    """(file_id, raw_type, paths): how many paths of each type a readable file has."""
    types = read.where("entries IS NOT NULL").select("file_id", F.explode(F.transform("entries", lambda e: e["raw_type"])).alias("raw_type"))
    return types.groupBy("file_id", "raw_type").agg(F.count(F.lit(1)).alias("paths"))


def column_types(statistics: DataFrame) -> DataFrame:
    """(file_kind, path, column_type): the type that most files use for a path, null values aside.

    Ties go to the type that comes later in the alphabet; a path that is always null is a string.
    """
    weight = F.struct(F.col("raw_type") != "null", "files", "raw_type")
    top = statistics.groupBy("file_kind", "path").agg(F.max_by("raw_type", weight).alias("column_type"))
    return top.withColumn("column_type", F.when(F.col("column_type") == "null", "string").otherwise(F.col("column_type")))


def consistent_table(read: DataFrame) -> DataFrame:
    """All files as one long table with one type per path.

    Columns: file_id, file_kind, path, column_type, raw_type, the value as text and, by column_type, as
    as_integer, as_decimal or as_boolean; cast_failed tells a non-null value that its column's type
    can't hold. An unreadable file has no row here.
    """
    entry = read.where("entries IS NOT NULL").select("file_id", "file_kind", F.explode("entries").alias("e"))
    rows = entry.select("file_id", "file_kind", F.col("e.path").alias("path"), F.col("e.raw_type").alias("raw_type"), F.col("e.value").alias("value"))
    types = column_types(path_type_statistics(read))
    joined = rows.alias("r").join(types.alias("t"), F.col("r.path").eqNullSafe(F.col("t.path")) & F.col("r.file_kind").eqNullSafe(F.col("t.file_kind")))
    kind, value, raw = F.col("t.column_type"), F.col("r.value"), F.col("r.raw_type")

    def typed(name: str) -> Column:
        # A number isn't a boolean, whatever the cast would make of it.
        usable = (kind == name) & ((raw == name) | (raw == "string") | ((name == "decimal") & (raw == "integer")))
        return F.when(usable, value.try_cast(COLUMN_TYPES[name]))

    out = joined.select(
        F.col("r.file_id").alias("file_id"), F.col("r.file_kind").alias("file_kind"), F.col("r.path").alias("path"),
        kind.alias("column_type"), raw.alias("raw_type"), value.alias("value"),
        typed("integer").alias("as_integer"), typed("decimal").alias("as_decimal"), typed("boolean").alias("as_boolean"),
    )
    failed = (
        F.when(F.col("value").isNull() | (F.col("column_type") == "string"), False)
        .when(F.col("column_type").isin("list", "object"), F.col("raw_type") != F.col("column_type"))
        .otherwise(F.coalesce(F.col("as_integer").cast("string"), F.col("as_decimal").cast("string"), F.col("as_boolean").cast("string")).isNull())
    )
    return out.withColumn("cast_failed", failed)


def wide_table(read: DataFrame, file_kind: str, paths: dict[str, str]) -> DataFrame:
    """The files of one kind with a typed column for each of ``paths`` (path to raw type) and the names of failed casts."""
    held = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["path"], e["value"])))
    base = read.where((F.col("file_kind") == file_kind) & F.col("entries").isNotNull()).select("file_id", *SERIES, "written_at", held.alias("held"))
    columns = [F.try_element_at("held", F.lit(p)).try_cast(COLUMN_TYPES[t]).alias(p) for p, t in paths.items()]
    failed = F.array_compact(F.array(*[
        F.when(F.try_element_at("held", F.lit(p)).isNotNull() & F.try_element_at("held", F.lit(p)).try_cast(COLUMN_TYPES[t]).isNull(), F.lit(p))
        for p, t in paths.items()
    ])) if paths else F.array().cast("array<string>")
    return base.select("file_id", *SERIES, "written_at", *columns, failed.alias("failed_casts"))


def with_previous(read: DataFrame) -> DataFrame:
    """Each readable file with the entries of the readable file before it in its series (``before``).

    The order is written_at, then file_id; a null written_at comes first. A series may hold a third of all
    files, so it isn't sorted in one task: files are numbered over ranges of the order, and each is joined with
    the one that has the number before its own.
    """
    files = read.where("entries IS NOT NULL").select("file_id", "written_at", *SERIES)
    placed = cut(with_row_number(files, SERIES, ["written_at", "file_id"], "place").select("file_id", *SERIES, "place"))
    earlier = placed.select(F.col("file_id").alias("from"), *[F.col(c).alias(f"__{c}") for c in SERIES], (F.col("place") + 1).alias("__place"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), SERIES, F.col("place") == F.col("__place"))
    linked = placed.join(earlier, same).select("file_id", "from")
    entries = read.select("file_id", "entries")
    return linked.join(entries, "file_id").join(entries.select(F.col("file_id").alias("from"), F.col("entries").alias("before")), "from").drop("from")


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, change, field, new_field): each field a file added, removed, renamed or retyped.

    Files of equal (install_id, file_kind, source_name), nulls equal, form a series; unreadable bodies are
    passed over; the first file of a series has no changes. Inner fields count only where both files hold
    the enclosing object. A field that is gone and whose non-null value is there under one or more new
    paths is renamed, once for each of these. A type change to or from null is none.
    """
    pairs = with_previous(read_files(files, digests=True))
    by_path = lambda entries: F.map_from_entries(F.transform(entries, lambda e: F.struct(e["path"], e["raw_type"])))
    typed = pairs.withColumn("now_types", by_path(F.col("entries"))).withColumn("old_types", by_path(F.col("before")))

    def only_in(entries: str, others: str) -> Column:
        return F.filter(
            entries,
            lambda e: ~F.map_contains_key(others, e["path"])
            & ((e["parent"] == "") | F.try_element_at(F.col(others), e["parent"]).eqNullSafe("object")),
        )

    sides = typed.withColumn("added", only_in("entries", "old_types")).withColumn("removed", only_in("before", "now_types"))
    same = lambda r, a: r["value"].isNotNull() & (r["value"] == a["value"]) & (r["raw_type"] == a["raw_type"])
    row = lambda change, field, new: F.struct(F.lit(change).alias("change"), field.alias("field"), new.alias("new_field"))
    none = F.lit("")
    renamed = F.flatten(F.transform("removed", lambda r: F.transform(F.filter("added", lambda a: same(r, a)), lambda a: row("renamed", r["path"], a["path"]))))
    gone = F.transform(F.filter("removed", lambda r: ~F.exists("added", lambda a: same(r, a))), lambda r: row("removed", r["path"], none))
    new = F.transform(F.filter("added", lambda a: ~F.exists("removed", lambda r: same(r, a))), lambda a: row("added", a["path"], none))
    retyped = F.transform(
        F.filter(
            "entries",
            lambda e: (e["raw_type"] != "null")
            & F.coalesce((F.try_element_at(F.col("old_types"), e["path"]) != "null") & (F.try_element_at(F.col("old_types"), e["path"]) != e["raw_type"]), F.lit(False)),
        ),
        lambda e: row("retyped", e["path"], none),
    )
    return (
        sides.select("file_id", F.explode(F.concat(renamed, gone, new, retyped)).alias("c"))
        .select("file_id", "c.change", "c.field", "c.new_field")
        .distinct()
    )
