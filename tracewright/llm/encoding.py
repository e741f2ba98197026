"""Encoding of a text column with a public byte-level BPE vocabulary.

Pre-tokenisation is done without a regex.  All texts of a batch become one array of
code points; a table gives each code point its class (letter, number, space, other)
and a look at the next two code points refines it (a contraction after an apostrophe,
the last space before a word).  Each refined class is a function from the automaton's
8 states to the state after it.  These functions form a finite monoid, so composition
is one table lookup and associative: the state before every code point comes from a
blocked scan (compose within blocks, scan the block totals, apply).  A code point
starts a token where its class breaks in the state before it.

The slices are merged by byte-pair ranks; results are cached by slice, so that each
distinct slice is merged once per worker.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import spread, tokenizer_path

#: Code points per step of work; bounds the memory of one step, not the input.
CHUNK_CHARS = 2_000_000
#: Distinct slices kept with their ids per worker; beyond it the cache starts anew.
CACHE_SLICES = 400_000
#: Slices longer than this are merged each time: they hardly ever recur.
CACHE_LENGTH = 64

# States: what the text before a code point leaves open.
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIX, ONE_LEFT, TWO_LEFT = range(8)
# Refined classes.
C_LETTER, C_NUMBER, C_OTHER, C_APOS2, C_APOS3, C_BLANK_MORE, C_SPACE_LAST, C_BLANK_LAST = range(8)
C_START = 8  # added to a class at the first code point of a text: forget what came before

# Unicode White_Space, and the letters of the contractions 's 't 'm 'd / 're 've 'll.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_TAILS = "stmd"
LONG_TAILS = ("re", "ve", "ll")


def _step(cls: int, state: int) -> tuple[int, bool]:
    """(next state, does a token start here)."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if cls in (C_LETTER, C_NUMBER):
        run = LETTERS if cls == C_LETTER else NUMBERS
        return run, state not in (run, PREFIX)
    if cls == C_OTHER or (cls in (C_APOS2, C_APOS3) and state in (OTHERS, PREFIX)):
        return OTHERS, state not in (OTHERS, PREFIX)
    if cls in (C_APOS2, C_APOS3):
        return (ONE_LEFT if cls == C_APOS2 else TWO_LEFT), True
    if cls == C_BLANK_MORE:
        return BLANKS, state != BLANKS
    return (PREFIX if cls == C_SPACE_LAST else FRESH), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function index of each class, compose[f, g] = g after f, apply[f, state], starts[class, state])."""
    gens = []
    starts = np.zeros((16, 8), bool)
    for cls in range(16):
        base, first = cls % 8, cls >= C_START
        pairs = [_step(base, FRESH if first else s) for s in range(8)]
        gens.append(tuple(p[0] for p in pairs))
        starts[cls] = [True if first else p[1] for p in pairs]
    index: dict[tuple, int] = {}
    for g in [tuple(range(8)), *gens]:
        index.setdefault(g, len(index))
    todo = list(index)
    while todo:  # close under composition
        f = todo.pop()
        for g in list(index):
            for h in (tuple(g[f[s]] for s in range(8)), tuple(f[g[s]] for s in range(8))):
                if h not in index:
                    index[h] = len(index)
                    todo.append(h)
    funcs = list(index)
    compose = np.array([[index[tuple(g[f[s]] for s in range(8))] for g in funcs] for f in funcs], np.int32)
    return np.array([index[g] for g in gens], np.int32), compose, np.array(funcs, np.int8), starts


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 other, 3 white space."""
    import unicodedata

    table = np.full(0x110000, 2, np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))[0]
        if cat == "L":
            table[cp] = 0
        elif cat == "N":
            table[cp] = 1
    table[WHITE_SPACE] = 3
    return table


def scan_states(cls: np.ndarray, block: int = 256) -> np.ndarray:
    """State before each code point, by a blocked associative scan."""
    gens, compose, apply, _ = _monoid()
    n = len(cls)
    if n == 0:
        return np.zeros(0, np.int8)
    block = min(block, max(1, int(n**0.5)))
    rows = -(-n // block)
    f = np.zeros(rows * block, np.int32)  # 0 is the identity
    f[:n] = gens[cls]
    f = f.reshape(rows, block)
    before = np.zeros((rows, block), np.int32)
    acc = np.zeros(rows, np.int32)
    for j in range(block):
        before[:, j] = acc
        acc = compose[acc, f[:, j]]
    totals, step = acc.copy(), 1
    while step < rows:  # doubling scan over the block totals
        totals[step:] = compose[totals[:-step], totals[step:]]
        step *= 2
    entry = np.concatenate([[FRESH], apply[totals[:-1], FRESH]])
    return apply[before, entry[:, None]].reshape(-1)[:n]


def token_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Offsets at which a pre-token starts; ``text_starts`` are the offsets of the non-empty texts."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    raw = class_table()[cp]
    first = np.zeros(n + 2, bool)
    first[text_starts] = True
    first[n] = True
    cls = raw.copy()  # letters, numbers, others already have their refined value
    nxt = np.full(n, 4, np.uint8)  # class of the next code point of the same text, 4 at the end
    nxt[:-1] = raw[1:]
    nxt[first[1 : n + 1]] = 4
    blank = raw == 3
    last = blank & (nxt < 3)
    cls[blank & ~last] = C_BLANK_MORE
    cls[last] = np.where(cp[last] == 32, C_SPACE_LAST, C_BLANK_LAST)
    apos = np.flatnonzero((cp == 39) & (nxt < 3))
    if len(apos):
        one = cp[apos + 1]
        two = np.where(first[apos + 2], 0, cp[np.minimum(apos + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in SHORT_TAILS])
        long = np.zeros(len(apos), bool)
        for a, b in LONG_TAILS:
            long |= (one == ord(a)) & (two == ord(b))
        cls[apos[short]] = C_APOS2
        cls[apos[long]] = C_APOS3
    cls[text_starts] += C_START
    return np.flatnonzero(_monoid()[3][cls, scan_states(cls)])


class Merger:
    """Byte-pair ranks of one vocabulary file (``.tiktoken``) with a cache of slices."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words: list[bytes] | None = None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the pair of least rank first, leftmost on ties."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        n = len(data)
        end = list(range(1, n + 1))  # the part that starts at i ends at end[i]; 0 when it is gone
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of its parts has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            got = self.merge(piece.encode())
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_SLICES:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def decode(self, ids) -> str:
        if self.words is None:
            self.words = [b""] * (max(self.ranks.values()) + 1)
            for w, i in self.ranks.items():
                self.words[i] = w
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, count of ids per text, offset in its text of each pre-token, pre-tokens per text)."""
    m = merger(path)
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    offsets: list[np.ndarray] = []
    pieces_per: list[np.ndarray] = []
    for part in _chunks([t or "" for t in texts]):
        joined = "".join(part)
        lens = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lens)
        begin = ends - lens
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        st = token_starts(cp, begin[lens > 0])
        stops = np.append(st[1:], len(joined))
        get, slow = m.cache.get, m.ids
        got = [get(p) or slow(p) for p in (joined[a:b] for a, b in zip(st.tolist(), stops.tolist()))]
        per = np.fromiter(map(len, got), np.int64, len(got))
        ids.append(np.fromiter((i for g in got for i in g), np.int32, int(per.sum())))
        cum = np.concatenate([[0], np.cumsum(per)])
        lo, hi = np.searchsorted(st, begin), np.searchsorted(st, ends)
        counts.append(cum[hi] - cum[lo])
        pieces_per.append(hi - lo)
        offsets.append(st - np.repeat(begin, hi - lo))
    if not ids:
        z = np.zeros(0, np.int64)
        return z.astype(np.int32), z, z, z
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(offsets), np.concatenate(pieces_per)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str | None = None, with_offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens.

    Null and empty texts have the empty list.  Strings that look like special tokens are
    ordinary text.  ``with_offsets`` adds ``offsets``: where each pre-token begins in its
    text, in code points.  Row-local: no shuffle, memory bounded by one chunk of text and
    the longest single text.  Only ``key`` and ``text`` are read.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    narrow = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _row_ranges(b.column(1)):
                part = b.slice(lo, hi - lo)
                ids, counts, offsets, pieces = encode_texts(part.column(1).to_pylist(), path)
                cols = [part.column(0), _lists(ids, counts, pa.int32())]
                names = [key, "ids"]
                if with_offsets:
                    cols.append(_lists(offsets.astype(np.int32), pieces, pa.int32()))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {kind}, ids array<int>" + (", offsets array<int>" if with_offsets else "")
    return spread(narrow).mapInArrow(run, schema)


def _row_ranges(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about one chunk of text each."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)) if len(texts) else []
    lo, base = 0, 0
    for i, s in enumerate(size):
        if s - base >= CHUNK_CHARS:
            yield lo, i + 1
            lo, base = i + 1, s
    if lo < len(texts):
        yield lo, len(texts)


def count_tokens(df: DataFrame, key: str, text: str, *, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``keep`` columns and ``tokens``: the number of ids of every row.

    0 for null and empty texts.  Only the counts leave the Python worker.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    narrow = df.select(F.col(key), *keep, F.col(text).cast("string").alias("__text"))
    fields = narrow.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            counts = [encode_texts(texts[lo:hi].to_pylist(), path)[1] for lo, hi in _row_ranges(texts)]
            tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(tokens, pa.int64())], [*b.schema.names[:-1], "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"
    return spread(narrow).mapInArrow(run, schema)
