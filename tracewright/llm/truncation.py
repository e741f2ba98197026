"""Texts cut off by a field limit or in transfer.

A text is complete when its end is a place where texts of its kind do end.  A backward
n-gram model is trained on the whole column: for the last 1..8 characters of a text it
knows how often that context ended a text and how often a text went on after it.  The
log-odds of "end" against "goes on", interpolated from short to long contexts, are
compared with a threshold per language and form.

Characters are read so that the context reaches far enough: a run of digits counts as one
character, so does a word of more than ``SHORT_WORD`` letters and an identifier; blanks
are skipped.  ``return f(x)`` and ``x = f(y)`` both end in ``)``, but a text ends after the
first only.

Training is two passes over the texts with small states: the contexts at ends, which are kept
(eight hashes a text, equal ones of a task together) and serve both the counts and, once
the model is there, the histogram of the thresholds; then how often each known context is
inside a text.  Applying the model is one more row-local pass.  A context is known if it ends
``MIN_ENDS`` texts and ``MIN_SHARE`` of all texts, so there are at most ``ORDERS / MIN_SHARE``.

Exact signs decide where there are any: an explicit mark of clipping or an open delimiter
(a code fence or a JSON value that is never closed) means cut, a JSON value that is closed
means complete, and so does an end at which a line of the prompt ends (an answer that gives
the prompt back ends wherever the prompt does).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import jsontext
from tracewright.llm.language import LANGUAGES, language
from tracewright.llm.spans import Hasher
from tracewright.session import cut_lineage, spread

#: Longest context, in characters as counted here.
ORDERS = 8
#: A context must have ended this many texts, and this share of all, to tell more than the shorter one within it.
MIN_ENDS = 4
MIN_SHARE = 1e-5
#: Weight of the shorter context's estimate, in observations.
BACKOFF = 4.0
#: Words up to this many lower-case letters are told apart.
SHORT_WORD = 6
#: Log-odds about which the two heaps part; the threshold is the least filled place nearest to it.
THRESHOLD = -3.0
#: A group's histogram counts beside this many texts of all groups, so that few texts move it little.
POOLED = 400
#: Code points per step.
CHUNK_CHARS = 1 << 20

#: Marks that clipping leaves behind.
_CLIPPED = re.compile(r"(?:…|\.\.\.|�|[\[(<](?:output )?(?:truncated|clipped|cut|cut off)[\])>])\s*$", re.I)

_U = np.uint64
_NUMBER, _LONG_WORD, _NAME, _START, _WORD = _U(1), _U(2), _U(3), _U(4), _U(5)
_SHORT = _U(1) << _U(40)  # set in the symbols of short words


# ---------------------------------------------------------------- characters as the model reads them


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 0 other, 1 lower-case letter, 2 upper-case letter, 3 underscore, 4 digit, 5 blank."""
    t = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        t[c] = 4 if "0" <= ch <= "9" else 5 if ch in " \t\r\xa0" else 3 if ch == "_" else 2 if ch.isupper() else 1 if ch.isalpha() else 0
    return t


def symbols(cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, text) of each character as the model counts them; ``begin`` are the offsets of the texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    cls = np.where(cp < 0x250, _classes()[np.minimum(cp, 0x24F)], 0).astype(np.uint8)
    wordy = (cls >= 1) & (cls <= 4)
    first = np.zeros(n + 1, bool)
    first[begin] = True
    start = np.flatnonzero(~wordy | first[:n] | ~np.concatenate([[False], wordy[:-1]]))
    stop = np.append(start[1:], n)
    keep = cls[start] != 5
    start, stop = start[keep], stop[keep]
    sym = cp[start].astype(_U) + _U(16)
    word = wordy[start]
    s, e = start[word], stop[word]
    # blanks and others end a run, so a run of word characters lasts until the next start
    count = lambda k: np.concatenate([[0], np.cumsum(cls == k)])
    lower, digit = count(1), count(4)
    length = e - s
    low, dig = lower[e] - lower[s], digit[e] - digit[s]
    named = Hasher(cp)
    h = ((named.sums[e] - named.sums[s]) * named.down[s]) | _SHORT
    sym[word] = np.where(
        dig == length,
        _NUMBER,
        np.where((low == length) & (length <= SHORT_WORD), h, np.where((low >= length - 1) & (cls[s] <= 2) & (dig == 0) & (low + (cls[s] == 2) == length), _LONG_WORD, _NAME)),
    )
    return sym, np.searchsorted(begin, start, side="right") - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _last(sym: np.ndarray) -> np.ndarray:
    """The symbols as the last ones of a context: a word there may be the head of a longer one, so all words are one."""
    return np.where((sym & _SHORT > 0) | (sym == _LONG_WORD) | (sym == _NAME), _WORD, sym)


def contexts(sym: np.ndarray, text: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes [len(at), ORDERS] of the contexts of each order that end at the positions ``at``.

    ``group`` is the group of each text; beyond the beginning of a text stands one start sign.
    """
    h = _mix(group[text[at]].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(7))
    out = np.empty((len(at), ORDERS), _U)
    own = text[at]
    for k in range(ORDERS):
        i = at - k
        ok = i >= 0
        s = np.full(len(at), _START)
        s[ok] = np.where(text[i[ok]] == own[ok], sym[i[ok]], _START)
        s = s if k else _last(s)
        h = _mix(h * _U(0x94D049BB133111EB) + s)
        out[:, k] = h
    return out


# ---------------------------------------------------------------- texts and their groups


def form(text: str) -> int:
    """0 prose, 1 JSON, 2 code fence first, 3 code."""
    s = text.lstrip()
    if s[:1] in "{[" and s[:2] not in ("[[",):
        return 1
    if s[:3] == "```":
        return 2
    head = s.split("\n", 1)[0]
    return 3 if re.match(r"(?:[\w.]+ = |[\w.]+\(|(?:if|for|with|while|return|def|class|raise|import|from|public|private) )", head) and re.search(r"[=()]|:$", head) else 0


FORMS = 4


def groups_of(texts: list[str]) -> np.ndarray:
    """Language and form of each text as one number."""
    return np.fromiter((FORMS * (0 if (f := form(t)) in (2, 3) else LANGUAGES.index(language(t))) + f for t in texts), np.int64, len(texts))


GROUPS = FORMS * len(LANGUAGES)


def _ready(text: str) -> str:
    return text.replace("​", "").replace("﻿", "").rstrip()


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[str]]]:
    """(batch, rows, their texts) in steps of about one chunk; blank texts are left out."""
    for b in batches:
        rows: list[int] = []
        texts: list[str] = []
        size = 0
        for i, t in enumerate(b.column(column).to_pylist()):
            t = _ready(t or "")
            if t:
                rows.append(i)
                texts.append(t)
                size += len(t)
            if size >= CHUNK_CHARS:
                yield b, rows, texts
                rows, texts, size = [], [], 0
        if rows:
            yield b, rows, texts


def _symbolise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return symbols(cp, np.cumsum(lens) - lens)


def _ends(text: np.ndarray, texts: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(texts), side="right") - 1


#: Characters at the end of a text that are read first; as many more as its last contexts need.
_TAIL = 400


def _tail_contexts(texts: list[str], group: np.ndarray | None = None) -> np.ndarray:
    """Contexts at the end of each text; the group is that of the whole text."""
    group = groups_of(texts) if group is None else group
    out = np.empty((len(texts), ORDERS), _U)
    rows, size = np.arange(len(texts)), _TAIL
    while len(rows):
        part = [texts[i] if len(texts[i]) <= size else texts[i][-size:] for i in rows]
        sym, text = _symbolise(part)
        # the first symbol of a tail may be the rest of a longer word: one more than the context must be there
        count = np.bincount(text, minlength=len(part))
        whole = np.fromiter((len(texts[i]) <= size for i in rows), bool, len(rows))
        done = whole | (count > ORDERS)
        have = count > 0  # else the tail is all blanks (kept ones are whole)
        got = np.full((len(part), ORDERS), 0, _U)
        if have.any():
            ends = _ends(text, len(part))
            got[have] = contexts(sym, text, group[rows], ends[have])
        out[rows[done]] = got[done]
        rows, size = rows[~done], size * 4
    return out


# ---------------------------------------------------------------- training


def _count_table(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["ctx", "n"])


class EndModel:
    """Sorted context hashes with how often each ended a text and was inside one."""

    def __init__(self, ctx: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> None:
        self.ctx, self.ends, self.inner = ctx, ends.astype(np.float64), inner.astype(np.float64)

    def log_odds(self, tails: np.ndarray) -> np.ndarray:
        """Log-odds of an end for rows of context hashes, from the shortest to the longest known context."""
        p = np.full(len(tails), 0.05)
        open_ = np.ones(len(tails), bool)
        for k in range(ORDERS):
            at = np.minimum(np.searchsorted(self.ctx, tails[:, k]), max(len(self.ctx) - 1, 0))
            known = open_ & (self.ctx[at] == tails[:, k]) if len(self.ctx) else np.zeros(len(tails), bool)
            # an end context the model has not kept is rare among ends, however common inside: with
            # the first one unknown the text ends as hardly any does
            if k == 0:
                p[~known] = 1e-4
            open_ = known
            e, i = self.ends[at[known]], self.inner[at[known]]
            p[known] = (e + BACKOFF * p[known]) / (e + i + BACKOFF)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))


_TAILS = "grp int, tail binary, n bigint"


def tails(texts: DataFrame, column: str) -> DataFrame:
    """(grp, tail, n): the end contexts of every non-blank text, equal ones of a step together; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, part in _steps(batches, column):
            group = groups_of(part)
            # the longest context tells all the shorter ones apart
            found = _tail_contexts(part, group)
            _, first, n = np.unique(found[:, -1], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[first].astype(np.int32)), pa.array([found[i].tobytes() for i in first], pa.binary()), pa.array(n.astype(np.int64))], ["grp", "tail", "n"]
            )

    return cut_lineage(spread(texts.select(column).where(F.length(column) > 0)).mapInArrow(run, _TAILS))


def _read_tails(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.frombuffer(b"".join(b.column("tail").to_pylist()), _U).reshape(-1, ORDERS)
    return b.column("grp").to_numpy(), hashes, b.column("n").to_numpy()


def train(texts: DataFrame, column: str, ending: DataFrame | None = None) -> EndModel:
    """Fit the model on every non-blank text of the column; ``ending``: its :func:`tails`, if they are there already."""
    ending = tails(texts, column) if ending is None else ending

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            _, hashes, n = _read_tails(b)
            keys, at = np.unique(hashes, return_inverse=True)
            parts.append((keys, np.bincount(at.reshape(-1), np.repeat(n, ORDERS), len(keys)).astype(np.int64)))
            if len(parts) >= 64:
                parts = [_sum(parts)]
        if parts:
            yield _count_table(*_sum(parts))

    narrow = texts.select(column).where(F.length(column) > 0)
    least = max(MIN_ENDS, MIN_SHARE * (ending.agg(F.sum("n")).first()[0] or 0))
    top = ending.mapInArrow(ends, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    ctx = top.column("ctx").to_numpy().view(_U)
    order = np.argsort(ctx)
    ctx, end_counts = ctx[order], top.column("n").to_numpy()[order]
    bits = _bitmap(ctx)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ctx), np.int64)
        for _, _, part in _steps(batches, column):
            group = groups_of(part)
            sym, text = _symbolise(part)
            last = np.zeros(len(sym), bool)
            last[_ends(text, len(part))] = True
            at = np.flatnonzero(~last)
            h = _mix(group[text[at]].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(7))
            own = text[at]
            for k in range(ORDERS):
                # a context the model lacks has no longer ones in it: those positions drop out
                i = at - k
                s = np.where((i >= 0) & (text[np.maximum(i, 0)] == own), sym[np.maximum(i, 0)], _START)
                s = s if k else _last(s)
                h = _mix(h * _U(0x94D049BB133111EB) + s)
                slot = (h & _U(len(bits) * 8 - 1)).astype(np.int64)
                maybe = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                j = np.minimum(np.searchsorted(ctx, h[maybe]), len(ctx) - 1)
                hit = ctx[j] == h[maybe]
                total += np.bincount(j[hit], minlength=len(ctx))
                live = maybe[hit]
                at, own, h = at[live], own[live], h[live]
        used = np.flatnonzero(total)
        yield _count_table(ctx[used], total[used])

    inner = np.zeros(len(ctx), np.int64)
    if len(ctx):
        got = spread(narrow).mapInArrow(inside, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n")).toArrow()
        inner[np.searchsorted(ctx, got.column("ctx").to_numpy().view(_U))] = got.column("n").to_numpy()
    return EndModel(ctx, end_counts, inner)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _bitmap(ctx: np.ndarray) -> np.ndarray:
    """1 bit per hash slot: spares a search for nearly all positions inside texts."""
    size = 1 << 23
    slot = (ctx & _U(size - 1)).astype(np.int64)
    bits = np.zeros(size >> 3, np.uint8)
    np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return bits


# ---------------------------------------------------------------- exact signs


def open_delimiter(text: str) -> bool:
    """Is a code fence, or a JSON value the text begins with, never closed?"""
    if text.count("```") % 2:
        return True
    s = text.lstrip()
    if s[:1] not in ("{", "["):
        return False
    if s[:1] == "[" and not re.match(r"\[\s*(?:[\[{\"\d\]]|true|false|null)", s):
        return False
    if jsontext.is_json(s):
        return False
    # a stack over the delimiters outside of strings: closed in the right order or not
    stack, inside, escaped = [], False, False
    for c in s:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return False
            if not stack:
                return False
    return bool(stack) or inside


def closed_json(text: str) -> bool:
    s = text.strip()
    if s[:1] not in ("{", "[", '"'):
        return False
    return jsontext.is_json(s)


def clipped(text: str) -> bool:
    return bool(_CLIPPED.search(text))


_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
#: Characters at the end of an answer that are looked up in its prompt.
_ECHO = 24


def echoes_end(text: str, source: str | None) -> bool:
    """Does the text end as a line of its source ends? Case, quote marks and blanks aside."""
    if not source:
        return False
    tail = "".join(_QUOTE.sub("", text[-4 * _ECHO :]).casefold().split()).rstrip("`")[-_ECHO:]
    if len(tail) < _ECHO:
        return False
    lines = source.casefold().splitlines()
    kept = "".join("".join(x.split()) + "\0" for x in lines)
    # the tail may span lines: the breaks inside it are ignored, the one after it is wanted
    flat = kept.replace("\0", "")
    at = flat.find(tail)
    if at < 0:
        return False
    ends = set()
    size = 0
    for x in lines:
        size += len("".join(x.split()).rstrip("`")) if not x.strip().strip("`") else len("".join(x.split()))
        ends.add(size)
    while at >= 0:
        if at + len(tail) in ends or flat[at + len(tail) :].strip("`") == "":
            return True
        at = flat.find(tail, at + 1)
    return False


# ---------------------------------------------------------------- thresholds and application


_EDGES = np.linspace(-10, 10, 161)
#: The part of the histogram in which a threshold may lie, in bins of twice the width.
_LOW, _HIGH = -5.5, -1.0


def thresholds(counts: np.ndarray) -> dict[int, float]:
    """Per group the least filled place between the two heaps of its log-odds; ``counts``: groups x bins of ``_EDGES``.

    A group of ``n`` texts counts beside ``POOLED`` texts with the shape of all groups, so the
    thresholds of large groups are their own and those of small ones near the common one.
    """
    at = np.flatnonzero((_EDGES[:-1] >= _LOW) & (_EDGES[:-1] < _HIGH))
    pairs = counts[:, at].reshape(len(counts), -1, 2).sum(2).astype(float)
    total = max(1, counts.sum())
    return {g: _valley(own + POOLED * pairs.sum(0) / total, _EDGES[at][::2] + 0.125) for g, own in enumerate(pairs)}


def _valley(heights: np.ndarray, mids: np.ndarray) -> float:
    smooth = np.convolve(heights, [0.25, 0.5, 0.25], "same")
    flat = np.flatnonzero(smooth <= smooth.min() * 1.05 + 0.5)
    return float(mids[flat[np.argmin(np.abs(mids[flat] - THRESHOLD))]])


def score_texts(model: EndModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of an end, group) of non-blank texts."""
    return model.log_odds(_tail_contexts(texts)), groups_of(texts)


def histogram(ending: DataFrame, model: EndModel) -> dict[int, float]:
    """Thresholds from the log-odds of all texts, scored from their :func:`tails` (groups x bins counts reach the driver)."""
    bins = len(_EDGES) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GROUPS, bins), np.int64)
        for b in batches:
            group, hashes, n = _read_tails(b)
            np.add.at(total, (group, np.clip(np.digitize(model.log_odds(hashes), _EDGES) - 1, 0, bins - 1)), n)
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield _count_table(used.astype(_U), flat[used])

    got = ending.mapInArrow(run, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GROUPS * bins, np.int64)
    counts[got.column("ctx").to_numpy()] = got.column("n").to_numpy()
    return thresholds(counts.reshape(GROUPS, -1))


def cut_flags(model: EndModel, limits: dict[int, float], texts: list[str], sources: list[str | None] | None = None) -> np.ndarray:
    """Which of the non-blank texts break off."""
    s, g = score_texts(model, texts)
    limit = np.array([limits.get(i, THRESHOLD) for i in range(GROUPS)])
    cut = s < limit[g]
    for i, t in enumerate(texts):
        if cut[i]:
            cut[i] = not closed_json(t) and not (sources and echoes_end(t, sources[i]))
        else:
            cut[i] = clipped(t) or (open_delimiter(t) and not (sources and echoes_end(t, sources[i])))
    return cut


def fit(texts: DataFrame, column: str) -> tuple[EndModel, dict[int, float]]:
    """(model, thresholds) of a column; runs three jobs.  Both are small values: keep them and pass them as ``fitted``."""
    ending = tails(texts, column)
    model = train(texts, column, ending)
    return model, histogram(ending, model)


def flag_truncated(df: DataFrame, key: str, column: str, *, source: str | None = None, keep: tuple[str, ...] = (), fitted: tuple[EndModel, dict[int, float]] | None = None) -> DataFrame:
    """``key``, the ``keep`` columns and ``truncated`` for every row.

    ``source`` names the column the text answers.  Null and blank texts are not truncated.  The model is fitted on the same rows unless
    given; an empty table has an empty model and no rows.
    """
    model, limits = fitted or fit(df, column)
    asked = F.col(source).cast("string") if source else F.lit(None).cast("string")
    narrow = df.select(F.col(key), *keep, asked.alias("__source"), F.col(column).cast("string").alias("__text"))
    fields = narrow.schema.fields[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = np.zeros(b.num_rows, bool)
            asked = b.column("__source")
            for _, rows, texts in _steps(iter([b]), "__text"):
                flags[rows] = cut_flags(model, limits, texts, asked.take(pa.array(rows)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(flags)], [*b.schema.names[:-2], "truncated"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", truncated boolean"
    return spread(narrow).mapInArrow(run, schema)


def finished(traces: DataFrame) -> DataFrame:
    return traces.where(~F.col("status").eqNullSafe("running"))


def rates(flagged: DataFrame, by: Column | str = "caller") -> DataFrame:
    """Per source: rows with an answer, those cut, and the share.

    With the columns ``status`` and ``output_tokens`` also the cut ones that count as ``ok`` and the mean
    tokens the model wrote per kept character of cut and of whole answers: where the first
    is higher, the field lost what the model had written; where they are alike, the model
    itself stopped.
    """
    cut = F.col("truncated")
    more = []
    if {"status", "output_tokens", "chars"} <= set(flagged.columns):
        per_char = F.when(F.col("chars") > 0, F.col("output_tokens") / F.col("chars"))
        more = [
            F.count_if(cut & (F.col("status") == "ok")).alias("truncated_at_ok"),
            F.avg(F.when(cut, per_char)).alias("tokens_per_char_cut"),
            F.avg(F.when(~cut, per_char)).alias("tokens_per_char_whole"),
        ]
    return flagged.groupBy(by).agg(F.count(F.lit(1)).alias("answers"), F.count_if(cut).alias("truncated"), F.avg(cut.cast("double")).alias("rate"), *more)
