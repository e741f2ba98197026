"""JSON texts read token by token, at any depth.

The readers keep their own stack, so a value nested a hundred thousand levels deep is as
good as a flat one, and :func:`tokens` never holds more than one token.  Strings are
decoded by the standard library's scanner.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}


def tokens(text: str) -> Iterator[tuple[str, str | None, int, int]]:
    """(kind, value, start, end) of each token of one JSON value; a text that is none is a ValueError.

    Kinds: ``{``, ``}``, ``[``, ``]``, ``key``, ``string``, ``number``, ``boolean``, ``null``.  Keys and
    strings carry their decoded text and stand between ``start`` and ``end`` with their
    quotes; numbers and words carry the text as written.
    """
    skip, number, n = _BLANK.match, _NUMBER.match, len(text)
    stack: list[str] = []
    i = skip(text, 0).end()
    want = "value"  # value, first (value or ]), key, first key (key or }), next (comma or closing)
    while True:
        c = text[i : i + 1]
        if want in ("value", "first"):
            if c == '"':
                value, end = scanstring(text, i + 1, True)
                yield "string", value, i, end
            elif c == "{" or (c == "[" and c):
                yield c, None, i, i + 1
                stack.append(c)
                want = "first key" if c == "{" else "first"
                i = skip(text, i + 1).end()
                continue
            elif c == "]" and want == "first":
                stack.pop()
                yield "]", None, i, i + 1
                end = i + 1
            elif c in _WORDS and c and text.startswith(_WORDS[c][0], i):
                word, kind = _WORDS[c]
                end = i + len(word)
                yield kind, word, i, end
            else:
                m = number(text, i)
                if not m:
                    raise ValueError(f"no JSON value at {i}")
                end = m.end()
                yield "number", m.group(), i, end
        elif want in ("key", "first key"):
            if c == '"':
                value, end = scanstring(text, i + 1, True)
                yield "key", value, i, end
                i = skip(text, end).end()
                if text[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                i = skip(text, i + 1).end()
                want = "value"
                continue
            if c != "}" or want == "key":
                raise ValueError(f"no key at {i}")
            stack.pop()
            yield "}", None, i, i + 1
            end = i + 1
        else:
            if c == ",":
                want = "key" if stack[-1] == "{" else "value"
                i = skip(text, i + 1).end()
                continue
            if c not in ("}", "]") or (c == "}") != (stack[-1] == "{"):
                raise ValueError(f"neither comma nor closing bracket at {i}")
            stack.pop()
            yield c, None, i, i + 1
            end = i + 1
        i = skip(text, end).end()
        if not stack:
            if i != n:
                raise ValueError(f"text after the value at {i}")
            return
        want = "next"


def _scalar(kind: str, value: str | None) -> Any:
    if kind == "string":
        return value
    if kind == "number":
        return json.loads(value) if len(value) < 4000 else (float(value) if re.search(r"[.eE]", value) else _long(value))
    return {"true": True, "false": False, "null": None}[value]


def _long(digits: str) -> int | float:
    """An integer of thousands of digits, which the interpreter refuses to read."""
    return float(digits)


def build(text: str) -> Any:
    """The value of a JSON text, built without recursion; of equal keys the last one counts."""
    root: list = []
    holder: Any = root
    stack: list[tuple[Any, str | None]] = []
    key: str | None = None
    for kind, value, _, _ in tokens(text):
        if kind == "key":
            key = value
            continue
        if kind in ("}", "]"):
            holder, key = stack.pop()
            continue
        v = {} if kind == "{" else [] if kind == "[" else _scalar(kind, value)
        if isinstance(holder, dict):
            holder[key] = v
        else:
            holder.append(v)
        if kind in ("{", "["):
            stack.append((holder, key))
            holder = v
    return root[0]


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def load(text: str) -> Any:
    """The value of a JSON text of any depth; NaN and Infinity are no JSON and a ValueError, like any other fault."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return build(text)
    except ValueError:
        if _DIGITS.search(text):  # too long for the interpreter, not for JSON
            return build(text)
        raise


_DIGITS = re.compile(r"\d{4000}")


def is_json(text: str) -> bool:
    """Is the text one whole JSON value?"""
    try:
        load(text)
        return True
    except ValueError:
        return False


def _short(part: str) -> str:
    return part if len(part) <= 400 else part[0] + hashlib.blake2b(part.encode("utf-8", "surrogatepass")).hexdigest() + part[-1]


def canonical(value: Any, ordered: bool = False) -> str:
    """Text that is equal for equal values but for the order of their arrays (``ordered``: only of their keys).

    Long parts stand by their digest, so a deep value costs no more than its size.
    """
    done: list[str] = []
    # entry: value to write, or the number of written parts to join with their keys
    todo: list[tuple[str, Any]] = [("value", value)]
    while todo:
        what, v = todo.pop()
        if what == "object":
            n = len(v)
            parts = done[len(done) - n :] if n else []
            del done[len(done) - n :]
            done.append(_short("{" + ",".join(f"{json.dumps(k)}:{p}" for k, p in zip(v, parts)) + "}"))
        elif what == "array":
            parts = done[len(done) - v :] if v else []
            del done[len(done) - v :]
            done.append(_short("[" + ",".join(parts if ordered else sorted(parts)) + "]"))
        elif isinstance(v, dict):
            keys = sorted(v)
            todo.append(("object", keys))
            todo.extend(("value", v[k]) for k in reversed(keys))
        elif isinstance(v, list):
            todo.append(("array", len(v)))
            todo.extend(("value", x) for x in reversed(v))
        else:
            done.append(f"{type(v).__name__}:{json.dumps(v)}")
    return done[0]
