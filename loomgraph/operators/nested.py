"""Deeply nested records to related flat tables: one merged schema, then one explode per level."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows per batch handed back to Spark, so that one huge record doesn't fill the memory.
BATCH = 20_000
#: Levels that are exploded at most; what lies deeper is walked.
MOST_LEVELS = 24
#: More distinct fields than this don't come to the driver; the explode then looks into every field.
PRUNE_FIELDS = 10_000
#: A key that no record has; see :func:`_read`.
_MARK = "⁣loomgraph⁣end"
ENTRIES = "array<struct<key:string,kind:string,text:string>>"
DONE, TEXT = "done", "text"


# --- texts that the built-in reader can't read ------------------------------------------------


class _Number(str):
    """A number as it stands in the text."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null')


def _read_deep(text: str):
    """A JSON text of any depth; the reader keeps its own stack. ValueError if it isn't complete JSON."""
    stack: list = []
    at, out, wants = 0, None, "value"
    while True:
        at = _SPACE.match(text, at).end()
        if wants == "after" and not stack:
            if at == len(text):
                return out
            raise ValueError("text after the end")
        c = text[at : at + 1]
        if wants in ("value", "first") and c and c in "{[":
            stack.append(({} if c == "{" else [], None))
            at, wants = at + 1, "key-first" if c == "{" else "first"
            continue
        if (wants == "key-first" and c == "}") or (wants == "first" and c == "]") or (wants == "after" and c == ("}" if isinstance(stack[-1][0], dict) else "]")):
            value, at = stack.pop()[0], at + 1
        elif wants == "after" and c == ",":
            at, wants = at + 1, "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        else:
            m = _SCALAR.match(text, at)
            if not m or (wants.startswith("key") and c != '"'):
                raise ValueError("not JSON")
            value, at = json.loads(m[0], parse_int=_Number, parse_float=_Number), m.end()
            if wants.startswith("key"):
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("not JSON")
                stack[-1] = (stack[-1][0], value)
                at, wants = at + 1, "value"
                continue
        if stack:
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
        else:
            out = value
        wants = "after"


def _loads(text: str):
    """The value of a JSON text, numbers as they stand; ValueError if it isn't complete JSON."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
    except RecursionError:
        return _read_deep(text)


def _held(value, arrays: frozenset[str], name: str | None):
    """The value that ``value`` stands for: text of an object or array is read, array fields are arrays."""
    if isinstance(value, str) and not isinstance(value, _Number) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        try:
            inner = _loads(value)
            value = inner if isinstance(inner, dict | list) else value
        except ValueError:
            pass
    return [value] if isinstance(value, dict) and name in arrays else value


def _utf8(text: str | None) -> str | None:
    """Half of a surrogate pair can't be written; it becomes a question mark, as in the built-in reader."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _entry(key: str, value) -> dict:
    kind = (
        "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number)
        else "text" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"
    )
    text = None if kind in ("null", "object", "array") else json.dumps(value) if kind == "boolean" else _utf8(str(value))
    return {"key": _utf8(key), "kind": kind, "text": text}


def objects_in(text: str | None, arrays: frozenset[str], place: str = "", table: str = "", around: str = "", name: str | None = None, note: Callable[[str], object] | None = None) -> Iterator[tuple]:
    """``(element, table_path, object_path, parent_path, ordinal, entries)`` of each object in a text.

    The walk keeps its own stack, so no depth is too deep; a text that isn't complete JSON gives
    nothing. ``place``, ``table``, ``around`` and ``name`` say where in its record the text stands;
    ``note`` is told the table of each text in the record that the built-in reader may not read.
    """
    if text is None:
        return
    try:
        root = _held(_loads(text), arrays, name)
    except ValueError:
        return
    if not isinstance(root, dict | list):
        return
    # place, generalised place, value, place of the object around it, ordinal (None: no element)
    stack = [(place, table, root, around, int(place[place.rindex("[") + 1 : -1]) if place.endswith("]") and isinstance(root, dict) else None)]
    while stack:
        place, table, value, around, i = stack.pop()
        if isinstance(value, dict):
            held = {k: _held(v, arrays, k) for k, v in value.items()}
            if note and any(isinstance(v, str) and isinstance(held[k], dict | list) and _for_the_walk(v) for k, v in value.items()):
                note(table)
            yield i is not None, _utf8(table), _utf8(place), _utf8(around), i, [_entry(k, v) for k, v in held.items()]
            inner = place if i is not None else around
            stack += [(f"{place}.{k}" if place else k, f"{table}.{k}" if table else k, v, inner, None) for k, v in held.items() if isinstance(v, dict | list)]
        else:
            for n, raw in enumerate(value):
                v = _held(raw, arrays, None)
                if note and isinstance(raw, str) and isinstance(v, dict | list) and _for_the_walk(raw):
                    note(f"{table}[]")
                if isinstance(v, dict | list):
                    stack.append((f"{place}[{n}]", f"{table}[]", v, around, n if isinstance(v, dict) else None))


def _walk(rows: DataFrame, owners: list[str], names: frozenset[str]) -> DataFrame:
    """The objects in the texts of ``rows(owners..., place, table, around, name, text)``, in bounded Arrow batches."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in owners)
    schema = f"{kept}, element boolean, table_path string, object_path string, parent_path string, ordinal bigint, entries {ENTRIES}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *owner, place, table, around, name, text = row
                for found in objects_in(text, names, place, table, around, name):
                    out.append((*owner, *found))
                    if len(out) >= BATCH:
                        yield flush()
                        out = []
        if out:
            yield flush()

    return rows.select(*owners, "place", "table", "around", "name", "text").mapInArrow(run, schema)


# --- the explodes -----------------------------------------------------------------------------


def _read(text: Column) -> Column:
    """``text`` as a variant, null if the built-in reader can't read it as one complete JSON value.

    The reader stops at the end of a value and accepts what follows. So the text is read as a field
    of an object that has one field more behind it: if anything ends too early or goes on too long,
    that field is missing, or there are others.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{_MARK}":0}}')))
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    return F.transform(F.array(fields), lambda m: F.when((F.size(m) == 2) & m[_MARK].isNotNull(), m["v"]))[0]


def _is_container(v: Column | str) -> Column:
    kind = F.schema_of_variant(v)
    return kind.startswith("ARRAY<") | kind.startswith("OBJECT<")


_JSON_LIKE = r"^[ \t\r\n]*[\[{]"


HELD = "array<struct<table:string,place:string,around:string,ordinal:bigint,name:string,v:variant,text:string>>"


def _let(items: Column, *steps) -> Column:
    """Steps over the items of an array, each of which sees what the one before has made."""
    for step in steps:
        items = F.transform(items, step)
    return items


def _kids(c: Column, names: list[str], look: set[str] | None) -> Column:
    """The containers in the container ``c``, as HELD: objects and arrays (``v``), and texts left to the walk (``text``).

    With ``look`` only fields at those places are looked into.
    """
    pair = lambda key, i, v: F.struct(key.alias("key"), i.alias("i"), v.alias("v"))
    elements = F.transform(F.try_variant_get(c["v"], "$", "array<variant>"), lambda x, i: pair(F.lit(None).cast("string"), i, x))
    fields = F.transform(F.map_entries(F.try_variant_get(c["v"], "$", "map<string,variant>")), lambda e: pair(e["key"], F.lit(None).cast("int"), e["value"]))
    dot = lambda at, key: F.when(at == "", key).otherwise(F.concat(at, F.lit("."), key))
    items = F.coalesce(elements, fields)
    if look is not None:
        items = F.filter(items, lambda x: x["key"].isNull() | dot(c["table"], x["key"]).isin(*sorted(look)))
    kind = lambda s: F.when(s.startswith("ARRAY<"), "array").when(s.startswith("OBJECT<"), "object")
    typed = lambda x: F.struct(x["key"].alias("key"), x["i"].alias("i"), x["v"].alias("v"), F.schema_of_variant(x["v"]).alias("s"))
    said = lambda x: F.struct(x["key"].alias("key"), x["i"].alias("i"), x["v"].alias("v"), kind(x["s"]).alias("k"), F.when(x["s"] == "STRING", F.try_variant_get(x["v"], "$", "string")).alias("t"))
    read = lambda x: F.struct(x["key"].alias("key"), x["i"].alias("i"), F.when(x["t"].isNull(), x["v"]).otherwise(_read(x["t"])).alias("v"), x["k"].alias("k"), x["t"].alias("t"))
    again = lambda x: F.struct(x["key"].alias("key"), x["i"].alias("i"), x["v"].alias("v"), F.when(x["t"].isNull(), x["k"]).otherwise(kind(F.schema_of_variant(x["v"]))).alias("k"), x["t"].alias("t"))
    # a bare object where an array is meant is its element 0
    bare = lambda x: F.struct(x["key"].alias("key"), F.when(F.coalesce((x["k"] == "object") & F.array_contains(F.array(*map(F.lit, names)), x["key"]), F.lit(False)), -1).when(x["k"] == "object", x["i"]).alias("o"), x["i"].alias("i"), F.when(x["k"].isNotNull(), x["v"]).alias("v"), F.when(x["k"].isNull(), x["t"]).alias("text"))
    step = lambda x: F.struct(F.coalesce(F.concat(F.lit("."), x["key"], F.when(x["o"] == -1, "[]").otherwise("")), F.lit("[]")).alias("table"), F.coalesce(F.concat(F.lit("."), x["key"], F.when(x["o"] == -1, "[0]").otherwise("")), F.concat(F.lit("["), x["i"].cast("string"), F.lit("]"))).alias("place"), F.when(x["o"].isNotNull(), F.greatest(x["o"], F.lit(0))).cast("bigint").alias("ordinal"), x["key"].alias("name"), x["v"].alias("v"), x["text"].alias("text"))
    # within the record itself a place begins without a dot
    join = lambda at, end: F.when(at == "", F.regexp_replace(end, "^[.]", "")).otherwise(F.concat(at, end))

    def settle(x):
        around = F.when(c["ordinal"].isNotNull(), c["place"]).otherwise(c["around"])
        return F.struct(join(c["table"], x["table"]).alias("table"), join(c["place"], x["place"]).alias("place"), around.alias("around"), F.when(x["v"].isNotNull(), x["ordinal"]).alias("ordinal"), x["name"].alias("name"), x["v"].alias("v"), x["text"].alias("text"))

    like = F.filter(_let(items, typed, said), lambda x: x["k"].isNotNull() | F.coalesce(x["t"].rlike(_JSON_LIKE), F.lit(False)))
    return _let(like, read, again, bare, step, settle)


def _roots(records: DataFrame, owners: list[str], text: str) -> DataFrame:
    """``owners, v, text`` of the records that may hold objects: read (``v``) or left to the walk (``text``).

    A chain of steps on one array and an explode: a filter on what is read would be moved to before
    the reading, and read again.
    """
    rows = records.select(*owners, F.col(text).cast("string").alias("__text")).filter(F.col("__text").rlike(r"^[ \t\r\n]*[\[{\"]"))
    read = lambda t: F.struct(t.alias("t"), _read(t).alias("v"))
    # a record may be a text that holds the record
    inner = lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v"), F.when(F.schema_of_variant(x["v"]) == "STRING", F.try_variant_get(x["v"], "$", "string")).alias("i"))
    again = lambda x: F.struct(F.coalesce(x["i"], x["t"]).alias("text"), F.when(x["i"].isNull(), x["v"]).when(x["i"].rlike(_JSON_LIKE), _read(x["i"])).alias("v"))
    found = _let(F.array("__text"), read, inner, again)
    kept = F.filter(found, lambda x: F.when(x["v"].isNull(), x["text"].rlike(_JSON_LIKE)).otherwise(_is_container(x["v"])))
    last = F.transform(kept, lambda x: F.struct(x["v"].alias("v"), F.when(x["v"].isNull(), x["text"]).alias("text")))
    return rows.select(*owners, F.explode(last).alias("x")).select(*owners, "x.v", "x.text")


def _chain(records: DataFrame, owners: list[str], text: str, names: list[str], levels: int, look: set[str] | None, keep_values: bool) -> DataFrame:
    """``owners, state, table, place, around, ordinal, name, v, text`` of the readable records after ``levels`` explodes.

    ``state`` is done for objects that are elements (and the record itself), else the row is left to
    the walk. Each level opens the containers that the level before has found and keeps the objects
    among them; one explode at the end makes rows of them all. One plan without a shuffle.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    root = F.struct(F.lit("").alias("table"), F.lit("").alias("place"), F.lit("").alias("around"), none("bigint", "ordinal"), none("string", "name"), F.col("v").alias("v"), none("string", "text"))
    value = (lambda x: x["v"]) if keep_values else (lambda x: F.lit(None).cast("variant"))
    row = lambda x, state, v, text: F.struct(F.lit(state).alias("state"), x["table"].alias("table"), x["place"].alias("place"), x["around"].alias("around"), x["ordinal"].alias("ordinal"), x["name"].alias("name"), v.alias("v"), text.alias("text"))
    finished = lambda found, test: F.transform(F.filter(found, test), lambda x: row(x, DONE, value(x), x["text"]))
    rest = lambda found, test: F.transform(F.filter(found, test), lambda x: row(x, TEXT, F.lit(None).cast("variant"), F.coalesce(x["text"], F.to_json(x["v"]))))
    rows = _roots(records, owners, text).filter("v is not null").select(*owners, F.array(root).cast(HELD).alias("open"))
    rows = rows.select(*owners, "open", finished("open", lambda x: F.schema_of_variant(x["v"]).startswith("OBJECT<")).alias("out"))
    onward = F.flatten(F.transform(F.filter("open", lambda x: x["v"].isNotNull()), lambda c: _kids(c, names, look))).alias("open")
    found = F.concat("out", finished("open", lambda x: x["ordinal"].isNotNull()), rest("open", lambda x: x["text"].isNotNull())).alias("out")
    for _ in range(levels):
        rows = rows.select(*owners, "out", onward).select(*owners, "open", found)
    return rows.select(*owners, F.explode(F.concat("out", rest("open", lambda x: x["v"].isNotNull()))).alias("x")).select(*owners, "x.*")


def _unread(records: DataFrame, owners: list[str], text: str) -> DataFrame:
    """Whole records that the built-in reader can't read, as the walk takes them."""
    rows = _roots(records, owners, text).filter("v is null")
    return rows.select(*owners, F.lit("").alias("place"), F.lit("").alias("table"), F.lit("").alias("around"), F.lit(None).cast("string").alias("name"), "text")


def _for_the_walk(text: str) -> bool:
    """Whether the built-in reader may fail on a text that is JSON: repeated fields, long numbers, great depth or size."""
    repeated = False

    def pairs(found):
        nonlocal repeated
        out = dict(found)
        repeated |= len(out) < len(found)
        return out

    if len(text) > 1_000_000 or text.count("[") + text.count("{") > 300 or _LONG_NUMBER.search(text):
        return True
    json.loads(text, object_pairs_hook=pairs)
    return repeated


_LONG_NUMBER = re.compile(r"\d{300}")


def infer(records: DataFrame, text: str, arrays: Iterable[str] = ()) -> DataFrame:
    """The merged schema as :func:`merged_schema` gives it, and rows of kind ``level`` for the places of objects, of kind ``unread`` for texts within records that only the walk can read.

    One pass; a task adds up what it sees and hands on one row per field and kind.
    """
    names = frozenset(arrays)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for value in b.column(0):
                for _, table, _, _, _, entries in objects_in(value.as_py(), names, note=lambda place: counts.update([(place, "", "unread")])):
                    counts[table, "", "level"] += 1
                    counts.update((table, e["key"], e["kind"]) for e in entries)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], ["table_path", "field", "kind", "seen"])

    counted = records.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "table_path string, field string, kind string, seen bigint")
    return counted.groupBy("table_path", "field", "kind").agg(F.sum("seen").alias("seen"))


def merged_schema(records: DataFrame, owner: str, text: str, arrays: Iterable[str] = ()) -> DataFrame:
    """``table_path, field, kind, seen``: every field of every object of all records, by the place of the object.

    ``table_path`` is the place without positions, as ``attrs.targets[].inputs[]`` (``''``: the
    record itself). The kinds are those of JSON: text, number, boolean, null, object, array; a field
    may have several. ``"1.0"`` is a text, ``1.0`` a number. Text that holds an object or array
    counts as that, a bare object in a field of ``arrays`` as an array. One aggregate over all
    records, of which a task hands on one row per field and kind.
    """
    return infer(records, text, arrays).filter("kind not in ('level', 'unread')")


def plan_levels(schema: DataFrame) -> tuple[int, set[str] | None, bool]:
    """What an inferred schema asks for: how many explodes, the places of the fields they look into, whether the walk is needed.

    The places come to the driver if they are no more than PRUNE_FIELDS; else every field is looked
    into. Fields that hold an object or array in no record are never looked into.
    """
    holds, here = F.col("kind").isin("array", "object"), F.col("table_path")
    place = F.when(~holds, here).when(here == "", F.col("field")).otherwise(F.concat(here, F.lit("."), "field"))
    # an explode for each field and each position on the way; dots in names only make it more
    steps = F.when(place == "", 0).otherwise(F.size(F.split(place, r"\.")) + F.size(F.split(place, r"\[\]")) - 1)
    known = schema.filter(holds | F.col("kind").isin("level", "unread")).select(F.when(holds, "look").otherwise(F.col("kind")).alias("kind"), steps.alias("steps"), place.alias("place"))
    # a place on the way comes to the driver if it is one that is exploded, of all others only their depth
    shown = F.when((F.col("kind") == "look") & (F.col("steps") <= MOST_LEVELS), F.col("place"))
    rows = known.select("kind", F.least("steps", F.lit(MOST_LEVELS + 1)).alias("steps"), shown.alias("place")).distinct().limit(PRUNE_FIELDS + 1).collect()
    levels = max((r.steps for r in rows if r.kind == "level"), default=0)
    if len(rows) > PRUNE_FIELDS or levels > MOST_LEVELS:
        return MOST_LEVELS, None, True
    return levels, {r.place for r in rows if r.kind == "look"}, any(r.kind == "unread" for r in rows)


def flatten(records: DataFrame, owner: str, text: str, arrays: Iterable[str] = (), root: bool = True, schema: DataFrame | None = None, fields: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every array level exploded: one row per object in an array, linked to its owner and its parent object.

    Returns ``owner_id, table_path, object_path, parent_path, ordinal, fields`` and the columns ``keep``. ``object_path``
    is the surrogate key of the object within its owner, ``parent_path`` that of the nearest
    object around it (``''``: the record), ``ordinal`` its place in its array, counted from 0 with
    nulls. ``fields`` holds the scalars that stand in the object itself (null without ``fields``). With ``root`` the record
    itself is a row of table ``''``.

    The merged schema of the records (``schema``, or inferred here by :func:`infer`) says how many
    levels there are and which fields hold more; each level is one explode of the rows before,
    without a shuffle. Only texts that the built-in reader can't read go through a walk in Python.

    Text that holds an object or array is read as that value; the fields named in ``arrays`` mean
    arrays, so a bare object there is element 0. Null, blank, cut-off or otherwise unreadable
    records give no row. Numbers of any length and any depth are read; half of a surrogate pair
    becomes ``?``; of a repeated field the last counts. A text within a record that only the walk can
    read is both a field and the value it holds. Repeated records give
    repeated rows. Column names of ``records`` don't matter beyond the two that are named.
    """
    names, own = sorted(set(arrays)), [*keep, "owner_id"]
    rows = records.select(*keep, F.col(owner).cast("string").alias("owner_id"), F.col(text).alias("__s"))
    levels, look, walk = plan_levels(schema if schema is not None else infer(records, text, arrays))
    chain = _chain(rows, own, "__s", names, levels, look, fields)
    place = [F.col("ordinal").isNotNull().alias("element"), F.col("table").alias("table_path"), F.col("place").alias("object_path"), F.col("around").alias("parent_path"), "ordinal"]
    walked = F.map_from_entries(F.transform(F.filter("entries", lambda e: ~e["kind"].isin("object", "array")), lambda e: F.struct(e["key"], e["text"])))
    shape = lambda df, held: df.select(*own, "element", "table_path", "object_path", "parent_path", "ordinal", (held if fields else F.lit(None).cast("map<string,string>")).alias("fields"))
    found = shape(chain.filter(F.col("state") == DONE).select(*own, *place, "v"), _scalars(F.col("v")))
    found = found.unionByName(shape(_walk(_unread(rows, own, "__s"), own, frozenset(names)), walked))
    if walk:
        found = found.unionByName(shape(_walk(chain.filter(F.col("state") != DONE), own, frozenset(names)), walked))
    kept = found.filter(F.col("element") | (F.lit(root) & (F.col("object_path") == "")))
    return kept.select(*own, "table_path", "object_path", F.when(F.col("element"), F.col("parent_path")).alias("parent_path"), "ordinal", "fields")


def _scalars(v: Column) -> Column:
    """The fields of an object that hold no object or array, not even as a text, as text."""
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("s"), F.try_variant_get(e["value"], "$", "string").alias("text")))
    plain = F.filter(named, lambda e: ~(e["s"].startswith("ARRAY<") | e["s"].startswith("OBJECT<")))
    # only few texts look like JSON; those that are hold a level of their own
    plain = F.filter(plain, lambda e: ~F.coalesce((e["s"] == "STRING") & e["text"].rlike(_JSON_LIKE) & _read(e["text"]).isNotNull(), F.lit(False)))
    return F.map_from_entries(F.transform(plain, lambda e: F.struct(e["key"], e["text"])))


def child_table(objects: DataFrame, table_path: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one array level, with its fields as typed columns.

    ``columns`` maps field names to Spark types. Values that don't fit the type are null.
    """
    typed = [F.expr(f"try_cast(fields['{k}'] as {t})").alias(k) for k, t in columns.items()]
    return objects.filter(F.col("table_path") == table_path).select("owner_id", "object_path", "parent_path", "ordinal", *typed)


def level(table_path: Column | str) -> Column:
    """The array field that a table path ends in: ``dependencies`` of ``graph.dependencies[]``, ``abis`` of ``abis[][]``."""
    return F.regexp_extract(table_path, r"([^.\[\]]*)(?:\[\])+$", 1)


def level_fields(schema: DataFrame, arrays: Iterable[str] = ()) -> dict[str, list[str]]:
    """The scalar fields of each array level, wherever it stands, from a merged schema (its distinct names come to the driver).

    Fields that mean arrays and are only ever null are levels of their own, no columns; so are
    fields that hold only objects or arrays.
    """
    scalar, holds = F.col("kind").isin("text", "number", "boolean"), F.col("kind").isin("object", "array")
    schema = schema.filter("kind not in ('level', 'unread')")
    rows = schema.filter(r"table_path rlike '\\[\\]$'").groupBy(level("table_path").alias("level"), "field").agg(F.max(scalar).alias("some"), F.max(holds).alias("holds")).orderBy("level", "field").collect()
    names, out = set(arrays), {}
    for r in rows:
        fields = out.setdefault(r.level, [])
        if r.some or (r.field not in names and not r.holds):
            fields.append(r.field)
    return out


def level_table(objects: DataFrame, name: str, columns: dict[str, str], keys: Iterable[str] = ("owner_id", "object_path", "parent_path", "ordinal")) -> DataFrame:
    """The flat table of every array ``name``, at any place and in any layout, with its fields as typed columns.

    A field named like another column, in any case, gets ``_`` behind it. Values that don't fit the type are null.
    """
    keys = list(keys)
    taken, typed = {k.lower() for k in keys}, []
    for field, kind in columns.items():
        to = field
        while to.lower() in taken:
            to += "_"
        taken.add(to.lower())
        typed.append(F.col("fields")[field].try_cast(kind).alias(to))
    return objects.filter(level("table_path") == name).select(*keys, *typed)
