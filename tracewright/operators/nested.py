"""Deeply nested JSON records as related flat tables.

Each record is read token by token with an explicit stack (any depth, no recursion, no
tree) into triples

    (rec, grp, parent, pos, path, kind, value)

* ``parent``  the way to the array the element stands in (``data.exam[0].answers``);
  empty for what belongs to the record itself
* ``pos``     the index of the element in that array, null for the record itself
* ``grp``     ``parent`` with every index blanked (``data.exam[].answers``): the
  repeated ancestor by which triples of all records are grouped
* ``path``    the keys from the element down to the value, joined by dots
* ``kind``    JSON type of the value: object, array, string, number, boolean, null
* ``value``   text of a scalar as written (strings decoded), null for containers

Within ways and paths the characters ``.``, ``[``, ``]`` and ``%`` of a key are percent-encoded, so
two ways are equal only if all their keys are (:func:`decoded` gives the plain text).

Every element of an array gives one triple with an empty ``path`` (so that empty
objects and scalars in arrays are rows too), every key below it one triple more.
``table`` pivots the triples of one group into a flat table, ``tables`` those of all
groups with all their paths; their rows link to their parents by ``(rec, parent, pos)``; the parent row of an element is found by
splitting ``parent`` at its last index (``parent_link``).

The reading is row-local (one Arrow batch in, one out: no shuffle); only the pivot of a
group shuffles, by ``(rec, parent, pos)``, which never gathers more than the keys of
one element.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import jsontext

TRIPLE_SCHEMA = "rec bigint, grp string, parent string, pos bigint, path string, kind string, value string"
_ARROW = pa.schema(
    [("rec", pa.int64()), ("grp", pa.string()), ("parent", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("value", pa.string())]
)
_FLUSH_ROWS = 50_000
#: Characters of ways a record may have before its triples are sent on in parts.
_FLUSH_CHARS = 1 << 24

_MARKS = re.compile(r"[.\[\]%]")


def _key(k: str) -> str:
    return _MARKS.sub(lambda m: f"%{ord(m.group()):02X}", k) if _MARKS.search(k) else k


def decoded(way: Column) -> Column:
    """A way with the keys' own dots, brackets and percent signs."""
    for code, sign in (("%2E", "."), ("%5B", "["), ("%5D", "]"), ("%25", "%")):
        way = F.replace(way, F.lit(code), F.lit(sign))
    return way


def parse_strict(text: str | None):
    """(True, value) for valid JSON, (False, None) otherwise; NaN and Infinity are not JSON."""
    if text is None:
        return False, None
    try:
        return True, jsontext.load(text)
    except ValueError:
        return False, None


def _kind(v) -> str:
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    return "null" if v is None else "number"


def _text(v) -> str | None:
    if v is None or isinstance(v, (dict, list)):
        return None
    return v if isinstance(v, str) else "true" if v is True else "false" if v is False else repr(v)


def _holds(s: str) -> str | None:
    """The text without outer blanks if it begins and ends as a JSON object or array does."""
    s = s.strip()
    return s if len(s) > 1 and (s[0] + s[-1]) in ("{}", "[]") else None


def _expand(v):
    """The container a text holds when it is a whole JSON object or array, else the text."""
    if isinstance(v, str) and (s := _holds(v)):
        ok, inner = parse_strict(s)
        if ok:
            return inner
    return v


def walk(root, root_path: str = "", expand_text: bool = False) -> Iterator[tuple]:
    """Triples of one parsed value without its record number, in document order."""
    # entry: value, repeated parent way, same with blanked indexes, pos, path below the element, full way
    stack = [(root, "", "", None, root_path, root_path, root_path)]
    while stack:
        v, parent, grp, pos, path, way, blank = stack.pop()
        if expand_text:
            v = _expand(v)
        yield grp, parent, pos, path, _kind(v), _text(v)
        if isinstance(v, dict):
            below = [
                (x, parent, grp, pos, f"{path}.{k}" if path else k, f"{way}.{k}" if way else k, f"{blank}.{k}" if blank else k)
                for k, x in ((_key(k), x) for k, x in v.items())
            ]
        elif isinstance(v, list):
            below = [(x, way, blank, i, "", f"{way}[{i}]", f"{blank}[]") for i, x in enumerate(v)]
        else:
            continue
        stack.extend(reversed(below))


class _NeedsTree(Exception):
    """A record whose equal keys or size ask for the parsed value."""


class _Place:
    """Where a value stands: what its triple begins with, and its ways."""

    __slots__ = ("parent", "grp", "pos", "path", "way", "blank")

    def __init__(self, parent: str, grp: str, pos: int | None, path: str, way: str, blank: str) -> None:
        self.parent, self.grp, self.pos, self.path, self.way, self.blank = parent, grp, pos, path, way, blank


def _read(text: str, at: tuple[str, ...], root: _Place, expand_text: bool) -> list[tuple]:
    """Triples of a JSON text from its tokens; ValueError if it is none.

    ``at``: the keys down to the value the triples begin at.  Texts within texts are read
    the same way; each level of them doubles the escapes, so they nest no deeper than the
    logarithm of the length.
    """
    out: list[tuple] = []
    chars = 0
    # frame: place of the container or None (not wanted), keys seen or None (array), next index, keys of `at` passed
    stack: list[list] = []
    here: _Place | None = root if not at else None
    passed = 0
    for kind, value, _, _ in jsontext.tokens(text):
        if kind in ("}", "]"):
            stack.pop()
            continue
        frame = stack[-1] if stack else None
        if kind == "key":
            if value in frame[1]:
                raise _NeedsTree
            frame[1].add(value)
            p = frame[0]
            if p is not None:
                k = _key(value)
                here = _Place(p.parent, p.grp, p.pos, f"{p.path}.{k}" if p.path else k, f"{p.way}.{k}" if p.way else k, f"{p.blank}.{k}" if p.blank else k)
            elif 0 <= frame[3] < len(at) and value == at[frame[3]]:
                passed = frame[3] + 1
                here = root if passed == len(at) else None
            else:
                here, passed = None, -1
            continue
        if frame is not None and frame[1] is None:
            p, i = frame[0], frame[2]
            frame[2] += 1
            here, passed = (None, -1) if p is None else (_Place(p.way, p.blank, i, "", f"{p.way}[{i}]", f"{p.blank}[]"), -1)
        opens = kind in ("{", "[")
        if here is not None:
            chars += len(here.way)
            if chars > _FLUSH_CHARS or len(out) > _FLUSH_ROWS:
                raise _NeedsTree
            if opens:
                out.append((here.grp, here.parent, here.pos, here.path, "object" if kind == "{" else "array", None))
            elif kind == "string" and expand_text and (inner := _holds(value)):
                try:
                    below = _read(inner, (), here, True)
                except ValueError:
                    below = [(here.grp, here.parent, here.pos, here.path, "string", value)]
                out += below
            else:
                out.append((here.grp, here.parent, here.pos, here.path, kind, None if kind == "null" else value))
        if opens:
            stack.append([here, set() if kind == "{" else None, 0, passed if here is None else -1])
    return out


def _parsed(text: str, at: tuple[str, ...], expand_text: bool) -> Iterator[tuple]:
    """The same triples one by one, from the parsed value."""
    ok, value = parse_strict(text)
    for key in at:
        ok = ok and isinstance(value, dict) and key in value
        value = value[key] if ok else None
    return walk(value, ".".join(map(_key, at)), expand_text) if ok else iter(())


def record_triples(text: str | None, at: tuple[str, ...] = (), expand_text: bool = False) -> Iterable[tuple]:
    """The triples of one JSON text without its record number; none if it is null or no JSON."""
    name = ".".join(map(_key, at))
    try:
        return _read(text, at, _Place("", "", None, name, name, name), expand_text) if text is not None else ()
    except _NeedsTree:
        return _parsed(text, at, expand_text)
    except ValueError:
        return ()


def triples(df: DataFrame, rec: str, body: str, *, at: tuple[str, ...] = (), expand_text: bool = False) -> DataFrame:
    """Path-value-ordinal triples of a JSON text column.

    ``at`` names the keys under which the reading starts (``("data",)``: only what lies
    under the top-level key ``data``, with ways that begin with ``data``); a record
    without them gives nothing.  ``expand_text``: a text that is a whole JSON object or
    array counts as what it holds, at any level.  Of equal keys of an object the last counts.

    Null, empty or invalid JSON gives no row.  Repeated records give repeated rows.
    Only ``rec`` and ``body`` are read; other columns, whatever their names, are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        for b in batches:
            for rec_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in record_triples(text, at, expand_text):
                    out.append((rec_id, *t))
                    chars += len(t[1]) + len(t[3])
                    if len(out) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                        yield _batch(out)
                        out, chars = [], 0
        if out:
            yield _batch(out)

    narrow = df.select(F.col(rec).cast("bigint").alias("rec"), F.col(body).cast("string").alias("body"))
    return narrow.where(F.col("body").isNotNull()).mapInArrow(run, TRIPLE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(_clean(c), f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _clean(values):
    """Lone surrogates (``\\ud800`` escapes) cannot be stored as UTF-8: they become U+FFFD."""
    try:
        for v in values:
            if isinstance(v, str) and not v.isascii():
                v.encode()
        return values
    except UnicodeEncodeError:
        return [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else v for v in values]


def groups(t: DataFrame) -> DataFrame:
    """The repeated ancestors: one row per group with its element and record counts."""
    return t.where((F.col("path") == "") & F.col("pos").isNotNull()).groupBy("grp").agg(
        F.count(F.lit(1)).alias("elements"), F.countDistinct("rec").alias("records")
    )


_LINKS = ("rec", "grp", "parent", "pos", "up_parent", "up_pos")


def table(t: DataFrame, grp: str, columns: list[str] | None = None) -> DataFrame:
    """One flat table: the elements of ``grp`` with the given relative paths as columns.

    Keys the element lacks are null.  ``up_parent`` / ``up_pos`` link to the row of the
    enclosing element (null when the record itself encloses it).  Without ``columns`` all
    paths of the group are learnt from ``paths_of`` (one job); given ones run none.
    """
    rows = t.where(F.col("grp") == grp)
    names = column_names(learnt_paths(rows)) if columns is None else column_names(columns)
    return _pivoted(rows, ["rec", "parent", "pos"], names)


def tables(t: DataFrame, *extra: str) -> DataFrame:
    """The flat tables of all groups in one frame, told apart by ``grp``: no group and no path is left out.

    One row per element with the links of ``table``; the columns are the paths of all groups
    (an element has null where its group or the element lacks one), learnt from ``paths_of`` in one job
    that collects distinct paths only.  Rows with an empty ``grp`` are the records themselves:
    their values outside every array, ``pos`` null.  ``extra``: further columns of ``t`` that
    tell records apart.
    """
    return _pivoted(t, [*extra, "rec", "grp", "parent", "pos"], column_names(learnt_paths(t), extra))


def learnt_paths(t: DataFrame) -> list[str]:
    """The distinct relative paths that hold a scalar in some group, in order."""
    return sorted(r.path for r in paths_of(t).select("path").distinct().collect())


def column_names(paths: list[str], extra: tuple[str, ...] = ()) -> dict[str, str]:
    """Path -> column: the keys of the path with slashes between them (a dot would have to be quoted), ``value`` for a scalar element; numbered where a name is taken (Spark ignores case)."""
    out: dict[str, str] = {}
    taken = {*_LINKS, *extra}
    for p in sorted(paths, key=lambda p: (p == "", p)):
        plain = _plain(p.replace(".", "/")).replace(".", "_").replace("`", "'") or "value"
        name, n = plain, 1
        while name.lower() in taken:
            n += 1
            name = f"{plain}_{n}"
        taken.add(name.lower())
        out[p] = name
    return out


def _plain(way: str) -> str:
    return re.sub(r"%(2E|5B|5D|25)", lambda m: chr(int(m.group(1), 16)), way)


def _pivoted(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    picked = [F.max(F.when((F.col("path") == c), F.col("value"))).alias(name) for c, name in names.items()]
    flat = rows.groupBy(*by).agg(*(picked or [F.count(F.lit(1)).alias("keys")]))
    up_parent, up_pos = parent_link(F.col("parent"))
    return flat.withColumns({"up_parent": up_parent, "up_pos": up_pos})


def paths_of(t: DataFrame) -> DataFrame:
    """Every (group, relative path) with how often it holds a scalar."""
    return t.where(~F.col("kind").isin("object", "array")).groupBy("grp", "path").agg(F.count(F.lit(1)).alias("n"))


def parent_link(parent: Column) -> tuple[Column, Column]:
    """(parent, pos) of the element that encloses the array at ``parent``; nulls at the top."""
    head = F.regexp_extract(parent, r"^(.*)\[(\d+)\][^\[\]]*$", 1)
    idx = F.regexp_extract(parent, r"^(.*)\[(\d+)\][^\[\]]*$", 2)
    return F.when(idx != "", head), F.when(idx != "", idx.cast("bigint"))


def _last_key(way: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(way, r"(\[\d+\])+$", ""), r"\."), -1)


def found_elements(collections: DataFrame, golden: DataFrame) -> DataFrame:
    """Elements of request collections and recorded answers as (rec, kind, parent, pos, name).

    ``collections``: ``col_id``, ``body``; ``golden``: ``golden_id``, ``response.body``.
    See :func:`collection_elements` and :func:`data_elements`.
    """
    return collection_elements(collections).unionByName(data_elements(golden))


def data_elements(golden: DataFrame) -> DataFrame:
    """Each object that is an element of an array anywhere in ``response.body.data``: the rows of the groups' tables."""
    g = golden.select("golden_id", F.col("response.body").alias("body"))
    rows = flat_rows(g, "golden_id", "body", {"kind": ("", "kind")}, at=("data",), expand_text=True)
    hit = rows.where(F.col("pos").isNotNull() & (F.col("kind") == "object"))
    return hit.select("rec", F.lit("data").alias("kind"), decoded(F.col("parent")).alias("parent"), "pos", decoded(_last_key(F.col("parent"))).alias("name"))


def flat_rows(df: DataFrame, rec: str, body: str, columns: dict[str, tuple[str, str]], *, at: tuple[str, ...] = (), expand_text: bool = False) -> DataFrame:
    """The tables of all groups with given columns, pivoted while the record is read: (rec, grp, parent, pos, *columns).

    ``columns``: name -> (path, ``kind`` or ``value``).  An element has a row if it has any of the
    paths.  No shuffle: an element's triples are all in its record, and a repeated record gives
    repeated rows.
    """
    names = list(columns)
    slots: dict[str, list[tuple[int, bool]]] = {}
    for i, (path, what) in enumerate(columns.values()):
        slots.setdefault(path, []).append((i, what == "kind"))
    kinds = [("rec", pa.int64()), ("grp", pa.string()), ("parent", pa.string()), ("pos", pa.int64()), *((n, pa.string()) for n in names)]
    schema = pa.schema(kinds)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_clean(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for rec_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: dict[tuple, list] = {}
                for grp, parent, pos, path, kind, value in record_triples(text, at, expand_text):
                    for i, wants_kind in slots.get(path, ()):
                        row = found.setdefault((grp, parent, pos), [None] * len(names))
                        row[i] = kind if wants_kind else value
                out += [(rec_id, *k, *v) for k, v in found.items()]
                if len(out) >= _FLUSH_ROWS:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    narrow = df.select(F.col(rec).cast("bigint").alias("rec"), F.col(body).cast("string").alias("body")).where(F.col("body").isNotNull())
    return narrow.mapInArrow(run, "rec bigint, grp string, parent string, pos bigint" + "".join(f", `{n}` string" for n in names))


_NODE = r"item(?:\[\d+\]\.item)*"


def _dots(way: Column) -> Column:
    """``item[0].item[2]`` -> ``0.2``."""
    return F.regexp_replace(F.regexp_replace(way, r"\]\.item\[|\]$", "."), r"^item\[|\.$", "")


def collection_elements(collections: DataFrame) -> DataFrame:
    """Segments of ``request.url.path`` and headers of saved responses of each request node.

    Read from the flat rows of the groups: the nodes themselves (``item[]``..), their path lists,
    responses and headers.  A path given as one text has the segments between its slashes (empty ones are none);
    a segment given as an object is its ``value``; one lone object as ``response`` or
    ``header`` is a list of one; null segments and headers without a key give no row.
    """
    columns = {n: (p, "value") for n, p in (("itself", ""), ("value", "value"), ("route", "request.url.path"), ("key", "key"), ("header_key", "header.key"), ("response_header_key", "response.header.key"))}
    rows = flat_rows(collections, "col_id", "body", {"route_kind": ("request.url.path", "kind"), **columns}).where(F.col("parent").rlike(rf"^{_NODE}"))
    me = F.concat("parent", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    in_list = rf"^({_NODE}\[\d+\])\.request\.url\.path$"
    both = rf"^({_NODE}\[\d+\])\.response\[(\d+)\]\.header$"
    lone_response = rf"^({_NODE}\[\d+\])\.response\.header$"
    lone_header = rf"^({_NODE}\[\d+\])\.response$"
    at_node = F.col("parent").rlike(rf"^{_NODE}$")
    zero = F.lit(0).cast("bigint")
    row = "array<struct<kind:string,parent:string,pos:bigint,name:string>>"
    none = F.array().cast(row)

    def one(kind: str, parent: Column, pos: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), parent.alias("parent"), pos.alias("pos"), name.alias("name"))

    def header(pattern: str, response: Column, pos: Column, name: str) -> Column:
        mine = F.array(one("header", F.concat(_dots(F.regexp_extract("parent", pattern, 1)), F.lit("#"), response), pos, F.col(name)))
        return F.when(F.col(name).isNotNull() & F.col("parent").rlike(pattern), mine).otherwise(none)

    segments = F.transform(F.filter(F.split("route", "/"), lambda s: s != ""), lambda s, i: one("path", _dots(me), i.cast("bigint"), s))
    segment = F.coalesce("itself", "value")
    found = F.concat(
        # a path as a list: plain segments, or objects with a value
        F.when(segment.isNotNull() & F.col("parent").rlike(in_list), F.array(one("path", _dots(F.regexp_extract("parent", in_list, 1)), F.col("pos"), segment))).otherwise(none),
        # a path as one text: a scalar of the node itself
        F.when(at_node & (F.col("route_kind") == "string") & F.col("route").isNotNull(), segments).otherwise(none),
        # response and header are each a list or a lone object
        header(both, F.regexp_extract("parent", both, 2), F.col("pos"), "key"),
        header(lone_response, F.lit("0"), F.col("pos"), "key"),
        header(lone_header, F.col("pos").cast("string"), zero, "header_key"),
        F.when(at_node & F.col("response_header_key").isNotNull(), F.array(one("header", F.concat(_dots(me), F.lit("#0")), zero, F.col("response_header_key")))).otherwise(none),
    )
    return rows.select("rec", F.inline(found))
