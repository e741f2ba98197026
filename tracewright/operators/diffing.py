"""Mask, compare, classify: recorded against replayed answers.

Flat texts are masked with column expressions.  Nested JSON is masked and compared in one
row-local Arrow pass per pair of bodies; everything around it (alignment, classes,
summaries, taint) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import jsontext
from tracewright.operators.relational import with_group

MASK = "<<MASKED>>"

#: Default mask rules.
MASKED_FIELDS = ("created_at", "updated_at", "deleted_at", "request_id", "trace_id", "session_id", "token", "access_token", "refresh_token")
MUTATION_FIELDS = ("id", "order_id", "user_id", "randomId")
VALUE_PATTERNS = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}", r"^Bearer\s")
PART_PATTERNS = (r"[A-Za-z0-9]{5}(?=\\\d+_\d+\.\w+$)",)


@dataclass(frozen=True)
class MaskRules:
    """What is masked: keys, keys in changed data only, texts by their beginning, parts of texts in changed data only."""

    fields: tuple[str, ...] = MASKED_FIELDS
    mutation_fields: tuple[str, ...] = MUTATION_FIELDS
    patterns: tuple[str, ...] = VALUE_PATTERNS
    mutation_parts: tuple[str, ...] = PART_PATTERNS


def load_rules(rules: DataFrame) -> MaskRules:
    """Mask rules from a table of (``kind``, ``rule``, ``seq``), a small one; a kind without rows has no rules, an unknown kind is an error.

    Kinds: ``field``, ``mutation_field``, ``pattern``, ``mutation_part``.
    """
    kinds = {"field": [], "mutation_field": [], "pattern": [], "mutation_part": []}
    for r in rules.where("rule is not null").orderBy("seq").collect():
        if r.kind not in kinds:
            raise ValueError(f"no such kind of mask rule: {r.kind}")
        kinds[r.kind].append(r.rule)
    return MaskRules(*(tuple(v) for v in kinds.values()))


def mask_json_texts(df: DataFrame, key: str, body: str, context: str = "readonly", rules: MaskRules = MaskRules()) -> DataFrame:
    """(key, way, value): the scalars of JSON bodies after masking, by their ways (row-local).

    A masked container is one masked scalar.  Null and invalid bodies give no row.
    """
    from tracewright.operators.nested import walk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(context, rules)
        for b in batches:
            ids, ways, values = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                has, doc, ok = _load(text)
                if not has or not ok or not text.strip():
                    continue
                for _, parent, pos, path, kind, value in walk(masker.document(doc)):
                    if kind not in ("object", "array"):
                        ids.append(i)
                        ways.append(path if pos is None else f"{parent}[{pos}]" + (f".{path}" if path else ""))
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(ways, pa.string()), pa.array(values, pa.string())], [key, "way", "value"])

    narrow = df.select(key, F.col(body).cast("string").alias("__body")).where(F.col("__body").isNotNull())
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, way string, value string")


def mask_text(c: Column, whole: Sequence[str] = VALUE_PATTERNS, parts: Sequence[str] = ()) -> Column:
    """A text that a ``whole`` pattern matches from its start is masked, else each ``parts`` match in it."""
    out = c
    for p in parts:
        out = F.regexp_replace(out, p, MASK)
    for p in reversed(whole):
        out = F.when(c.rlike(f"^(?:{p})"), F.lit(MASK)).otherwise(out)
    return out


class Masker:
    """Masks values of a parsed JSON document; ``context`` is ``readonly`` or ``mutation``."""

    def __init__(self, context: str = "readonly", rules: MaskRules = MaskRules()) -> None:
        mutation = context == "mutation"
        self.fields = frozenset(rules.fields) | (frozenset(rules.mutation_fields) if mutation else frozenset())
        self.whole = [re.compile(p) for p in rules.patterns]
        self.parts = [re.compile(p) for p in rules.mutation_parts] if mutation else []

    def text(self, s: str) -> str:
        if any(p.match(s) for p in self.whole):
            return MASK
        for p in self.parts:
            s = p.sub(MASK, s)
        return s

    def document(self, root):
        """The masked document; walked with a stack, so any depth will do."""
        top = [root]
        stack = [(top, 0)]
        while stack:
            holder, key = stack.pop()
            v = holder[key]
            if isinstance(v, dict):
                v = {k: (MASK if k in self.fields else x) for k, x in v.items()}
                holder[key] = v
                stack.extend((v, k) for k in v if k not in self.fields)
            elif isinstance(v, list):
                v = list(v)
                holder[key] = v
                stack.extend((v, i) for i in range(len(v)))
            elif isinstance(v, str):
                holder[key] = self.text(v)
        return top[0]


def same_bag(a, b) -> bool:
    """Equal but for the order in arrays, at any depth."""
    return jsontext.canonical(a) == jsontext.canonical(b)


def differences(golden, actual) -> list[tuple[str, str]]:
    """(kind, way): missing or added key, item, type or value changes, in document order."""
    out: list[tuple[str, str]] = []
    stack = [(golden, actual, "root")]
    while stack:
        a, b, way = stack.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            out += [("missing_key", f"{way}['{k}']") for k in a if k not in b] + [("added_key", f"{way}['{k}']") for k in b if k not in a]
            stack.extend((a[k], b[k], f"{way}['{k}']") for k in reversed(list(a)) if k in b)
        elif isinstance(a, list) and isinstance(b, list):
            out += [("missing_item", f"{way}[{i}]") for i in range(len(b), len(a))] + [("added_item", f"{way}[{i}]") for i in range(len(a), len(b))]
            stack.extend((a[i], b[i], f"{way}[{i}]") for i in reversed(range(min(len(a), len(b)))))
        elif type(a) is not type(b):
            out.append(("type_change", way))
        elif a != b:
            out.append(("value_change", way))
    return out


def _load(text: str | None):
    """(is there a body, its value, is it JSON)."""
    if text is None:
        return False, None, True
    try:
        return True, jsontext.load(text), True
    except ValueError:
        return True, text, not text.strip()


def diff_bodies(pairs: DataFrame, context: str = "readonly", ignore_order: Sequence[str] = (), keep: Sequence[str] = ("case_key",), rules: MaskRules = MaskRules()) -> DataFrame:
    """The ``keep`` columns, ``body_class``, ``diffs`` and ``not_json`` (of the actual body) for rows of ``golden_body`` and ``actual_body``.

    Row-local, repeated rows give repeated results.  ``body_class``: equal, body_presence_mismatch, array_order_only, missing_fields,
    type_mismatch or value_mismatch.  Null against null is equal, null against anything else
    a presence mismatch; an empty object is not null.  ``ignore_order`` lists ways whose
    arrays are compared as bags.  A text that is no JSON counts as a text value.
    """
    for way in ignore_order:
        if not re.fullmatch(r"root(?:\['[^']*'\]|\[\d+\])*", way):
            raise ValueError(f"no way into a document: {way}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(context, rules)
        for b in batches:
            classes, diffs, odd = [], [], []
            for g, a in zip(b.column("__golden").to_pylist(), b.column("__actual").to_pylist()):
                (has_g, golden, _), (has_a, actual, is_json) = _load(g), _load(a)
                found: list[tuple[str, str]] = []
                if has_g != has_a:
                    kind = "body_presence_mismatch"
                elif not has_g:
                    kind = "equal"
                else:
                    golden, actual = masker.document(golden), masker.document(actual)
                    found = [d for d in differences(golden, actual)]
                    if ignore_order and found:
                        found = [d for d in found if not _covered(d[1], ignore_order, golden, actual)]
                    names = {k for k, _ in found}
                    if not found:
                        kind = "equal"
                    elif same_bag(golden, actual):
                        kind = "array_order_only"
                    elif names & {"missing_key", "missing_item", "added_key", "added_item"}:
                        kind = "missing_fields"
                    elif "type_change" in names:
                        kind = "type_mismatch"
                    else:
                        kind = "value_mismatch"
                classes.append(kind)
                odd.append(not is_json)
                diffs.append([{"kind": k, "way": w} for k, w in found])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(classes, pa.string()), pa.array(diffs, pa.list_(pa.struct([("kind", pa.string()), ("way", pa.string())]))), pa.array(odd, pa.bool_())],
                [*b.schema.names[:-2], "body_class", "diffs", "not_json"],
            )

    narrow = pairs.select(*keep, F.col("golden_body").alias("__golden"), F.col("actual_body").alias("__actual"))
    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in narrow.schema.fields[:-2])
    return narrow.mapInArrow(run, kept + "body_class string, diffs array<struct<kind:string,way:string>>, not_json boolean")


def _at(doc, way: str):
    for key, index in re.findall(r"\['([^']*)'\]|\[(\d+)\]", way):
        try:
            doc = doc[int(index)] if index else doc[key]
        except (KeyError, IndexError, TypeError):
            return None
    return doc


def _covered(way: str, ignore_order: Sequence[str], golden, actual) -> bool:
    """Does the difference lie in an array that is equal as a bag and listed to be compared so?"""
    return any(way.startswith(w) and same_bag(_at(golden, w), _at(actual, w)) for w in ignore_order)


#: What to look at for each failure class.
HINTS = {
    "golden_not_found": "record the case first",
    "response_not_json": "look at the error page",
    "status_code_mismatch": "compare the status codes",
    "array_order_only": "compare the ordering",
    "body_presence_mismatch": "one side has no body",
    "missing_fields": "compare the field lists",
    "type_mismatch": "compare the field types",
    "value_mismatch": "compare the values",
}


def failure_class(golden_missing: Column, not_json: Column, status_equal: Column, body_class: Column) -> Column:
    """The first class that applies; null for a pass, ``unknown`` for a body that could not be classed."""
    return (
        F.when(golden_missing, "golden_not_found")
        .when(not_json, "response_not_json")
        .when(~status_equal, "status_code_mismatch")
        .when(body_class.isNull(), "unknown")
        .when(body_class != "equal", body_class)
    )


def hint(cls: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    return F.when(cls.isNotNull(), F.coalesce(table[cls], F.lit("look at both bodies")))


def verify(golden: DataFrame, actual: DataFrame, keys: Sequence[str], context: str = "readonly", rules: MaskRules = MaskRules()) -> DataFrame:
    """Each replayed or recorded case with status and body compared, its failure class and hint.

    Both sides: the keys, ``status_code``, ``body``.  A replayed case without a recording is
    ``golden_not_found``; a recorded case without a replay differs in its status.
    """
    g = golden.select(*keys, F.lit(True).alias("_recorded"), F.col("status_code").alias("golden_status"), F.col("body").alias("golden_body"))
    a = actual.select(*keys, F.lit(True).alias("_replayed"), F.col("status_code").alias("actual_status"), F.col("body").alias("actual_body"))
    both = F.col("_recorded").isNotNull() & F.col("_replayed").isNotNull()
    status_equal = both & F.col("golden_status").eqNullSafe(F.col("actual_status"))
    pairs = g.join(a, list(keys), "full_outer").withColumns({"status_match": status_equal, "_missing": F.col("_recorded").isNull()})
    diffs = diff_bodies(pairs, context, keep=(*keys, "golden_status", "actual_status", "status_match", "_missing"), rules=rules)
    out = diffs.withColumn("failure_type", failure_class(F.col("_missing"), F.col("not_json"), F.col("status_match"), F.col("body_class")))
    return out.select(*keys, "golden_status", "actual_status", "status_match", "body_class", F.size("diffs").alias("diff_count"), "failure_type", hint(F.col("failure_type")).alias("debug_hint"), F.col("failure_type").isNull().alias("passed"))


def tainted(df: DataFrame, folder: str, anomaly: Column) -> DataFrame:
    """``tainted``: some case of the folder is an anomaly, so none of its cases counts."""
    return with_group(df, [folder], tainted=F.bool_or(F.coalesce(anomaly, F.lit(False))))


def paths(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, way, kind, value): every scalar and container of a JSON body by its way (keys percent-encoded as in the nested operator)."""
    from tracewright.operators.nested import triples

    t = triples(df, key, body)
    way = F.when(F.col("pos").isNull(), F.col("path")).otherwise(
        F.concat("parent", F.lit("["), F.col("pos").cast("string"), F.lit("]"), F.when(F.col("path") == "", F.lit("")).otherwise(F.concat(F.lit("."), F.col("path"))))
    )
    return t.select(F.col("rec").alias(key), way.alias("way"), "kind", "value")


def strip_keys(df: DataFrame, key: str, body: str, names: Sequence[str]) -> DataFrame:
    """The path table without the subtrees of the named keys, at any depth; a key is compared whole, its own dots included."""
    from tracewright.operators.nested import _key

    steps = F.transform(F.split("way", r"\."), lambda k: F.regexp_replace(k, r"(\[\d+\])+$", ""))
    return paths(df, key, body).where(~F.arrays_overlap(steps, F.array(*[F.lit(_key(n)) for n in names])))
