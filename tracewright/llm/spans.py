"""Long exact spans shared between records.

For each record: how many characters of its text lie in runs of at least ``min_chars``
characters that occur verbatim in the text of a record with another owner.

Method: difference-cover anchors.  With a perfect difference set D modulo a period P,
any two positions i and j have a shift k < P with i+k and j+k both in D modulo P.  So two
equal runs of ``min_chars`` contain a pair of equal windows of ``min_chars - P + 1``
characters that both start at cover positions.  Only those windows (|D|/P of all) are
hashed and compared; a run is then extended around its anchors to its exact extent.

1. *Anchors.*  Each row's cover windows are hashed; a window is a hit when two owners have it.
2. *Extension.*  In rows with a hit anchor at p, every window of ``min_chars`` that holds the
   anchor (start in p-(min_chars-window)..p) is a candidate; it is shared when two owners
   have it.  A character is shared when it lies in a shared window, which is the definition.

No pairs of rows are ever formed: "two owners have it" is the least against the greatest
owner of a hash, an aggregate that combines ahead of the shuffle.  The rows lie in hash
groups; a group sends each distinct hash once with its least and greatest owner, so a text
held by a third of all rows arrives once per group, and the answer goes back to groups,
not rows.  Hashes move as packed columns (8 bytes an anchor; 12 a candidate window), as
rows of their own they would take four times the shuffle.  Where there are more buckets
than a task can fill with blocks of some size, they move in two steps.  The two exchanges that carry
text are each read twice by the same plan, so Spark reuses them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import groups_for

#: Perfect difference sets (each difference modulo the period occurs once).
COVERS = {
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    31: (0, 1, 3, 8, 12, 18),
    13: (0, 1, 3, 9),
    7: (0, 1, 3),
    1: (0,),
}
#: An anchor is at least this share of a run: shorter ones hit in every shared phrase, and each hit costs
#: a candidate row with all its windows; longer ones need a denser cover.
ANCHOR_SHARE = 0.5
#: UTF-8 bytes of text per hash group; one group is one unit of work in a Python worker.
GROUP_BYTES = 16 << 20
#: Buckets one exchange of packed hashes fills; with more it is done in two steps.
FAN_OUT = 4096
#: Code points hashed at a time.
CHUNK_CHARS = 1 << 20
#: Hashes gathered before they are packed and sent.
BLOCK_HASHES = 1 << 21

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64


def cover_for(min_chars: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length) for runs of ``min_chars``: the sparsest with long enough anchors."""
    for period, cover in COVERS.items():
        window = min_chars - period + 1
        if window >= ANCHOR_SHARE * min_chars:
            return period, cover, window
    raise ValueError("min_chars must be positive")


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """B**k and B**-k modulo 2**64 for k up to ``size``."""
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        a = np.empty(size, _U)
        a[0], m = 1, 1
        while m < size:
            k = min(m, size - m)
            a[m : m + k] = a[:k] * _U(pow(base, m, 1 << 64))
            m += k
        out.append(a)
    return out[0], out[1]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0x7FB5D329728EA185)
    h ^= h >> _U(33)
    return h


class Hasher:
    """Window hashes of a run of code points from prefix sums: h = sum c[i+k] B**k."""

    def __init__(self, cp: np.ndarray, which: int = 0) -> None:
        size = 1 << max(16, int(len(cp)).bit_length())
        up, self.down = _powers(which, size)
        c = cp.astype(_U)
        c *= _U(0xD6E8FEB86659FD93 if which == 0 else 0xA0761D6478BD642F)
        c ^= c >> _U(29)
        c *= _U(0xE7037ED1A0B428DB)
        c *= up[: len(cp)]
        self.sums = np.zeros(len(cp) + 1, _U)
        np.cumsum(c, out=self.sums[1:])

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        return _scramble((self.sums[at + length] - self.sums[at]) * self.down[at])


def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, .. (count[0] of them), lo[1], .."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(lo, count)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, lengths) for runs of rows with about one chunk of text."""
    part: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        s = t.as_py() or ""
        part.append(s)
        size += len(s)
        if size >= CHUNK_CHARS:
            yield first, _points(part), np.fromiter(map(len, part), np.int64, len(part))
            part, size, first = [], 0, i + 1
    if part:
        yield first, _points(part), np.fromiter(map(len, part), np.int64, len(part))


def _points(part: list[str]) -> np.ndarray:
    return np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)


def _anchors(lens: np.ndarray, period: int, cover: tuple[int, ...], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset among all code points of the chunk) of every cover window."""
    longest = int(lens.max(initial=0))
    grid = (np.arange(-(-max(longest, 1) // period))[:, None] * period + np.array(cover)).reshape(-1)
    count = np.searchsorted(grid, lens - window, side="right")
    row = np.repeat(np.arange(len(lens)), count)
    begin = np.cumsum(lens) - lens
    return row, begin[row] + grid[_ranges(np.zeros(len(lens), np.int64), count)]


class _Sender:
    """Gathers (hash, group, least and greatest owner) and packs distinct ones by bucket."""

    def __init__(self, bucket_of: Callable[[np.ndarray], np.ndarray]) -> None:
        self.bucket_of, self.parts, self.size = bucket_of, [], 0

    def add(self, h: np.ndarray, tail: np.ndarray, group: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, tail, group, least, most))
        self.size += len(h)
        if self.size >= BLOCK_HASHES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h, tail, group, least, most = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        # rows arrive in order, so equal owners stand together and compress well; only hashes
        # that recur in a group need to be combined
        order = np.lexsort((group, tail, h))
        same = (h[order][1:] == h[order][:-1]) & (tail[order][1:] == tail[order][:-1]) & (group[order][1:] == group[order][:-1])
        cut = np.flatnonzero(np.concatenate([[True], ~same]))
        least, most = np.minimum.reduceat(least[order], cut), np.maximum.reduceat(most[order], cut)
        keep = order[cut]  # lexsort is stable: the first row of its kind
        back = np.argsort(keep)
        keep, least, most = keep[back], least[back], most[back]
        bucket = self.bucket_of(h[keep])
        by = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[by], return_index=True)
        for b, i in zip(names.tolist(), np.split(by, first[1:])):
            k = keep[i]
            mixed = np.flatnonzero(least[i] != most[i]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int32()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (h[k], tail[k], group[k].astype(np.int32), least[i], mixed, most[i][mixed])),
                ],
                names=_BLOCK,
            )


def _buckets(groups: int, fan_out: int) -> tuple[int, int]:
    """(coarse, fine): buckets of the one exchange, or of the first and of each second one.

    A task fills as many blocks as there are buckets; beyond ``fan_out`` they would hold a few
    hashes each, so hashes are then spread in two exchanges, as a radix sort does.
    """
    if groups <= fan_out:
        return groups, 1
    coarse = math.ceil(math.sqrt(groups))
    return coarse, math.ceil(groups / coarse)


def _unpacked(block: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail, group, least, most) of packed blocks."""
    cols = {n: block.column(n).to_pylist() for n in _BLOCK[1:]}
    kinds = {"h": _U, "tail": np.uint32, "grp": np.int32, "least": np.int64}
    h, tail, grp, least = (np.concatenate([np.frombuffer(x, kinds[n]) for x in cols[n]]) for n in kinds)
    most, base = least.copy(), 0
    for x, m, v in zip(cols["h"], cols["mixed"], cols["most"]):
        most[base + np.frombuffer(m, np.int32)] = np.frombuffer(v, np.int64)
        base += len(x) // 8
    return h, tail, grp, least, most


def _exchange(sent: DataFrame, coarse: int, fine: int) -> DataFrame:
    """The hashes of packed blocks that two owners have, back to each group that holds them."""
    if fine > 1:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _Sender(lambda h: ((h % _U(coarse)) * _U(fine) + (h // _U(coarse)) % _U(fine)).astype(np.int64))
            for b in batches:
                if b.num_rows:
                    h, tail, grp, least, most = _unpacked(b)
                    yield from out.add(h, tail, grp.astype(np.int64), least, most)
            yield from out.flush()

        sent = sent.repartitionById(coarse, F.col("bucket")).mapInArrow(spread, _BLOCK_SCHEMA)
    # one partition per bucket: hashed onto partitions, several would fall on one task
    return sent.repartitionById(coarse * fine, F.col("bucket")).groupBy("bucket").applyInArrow(_receive, _BACK_SCHEMA)


_BLOCK = ["bucket", "h", "tail", "grp", "least", "mixed", "most"]
_BLOCK_SCHEMA = "bucket int, h binary, tail binary, grp binary, least binary, mixed binary, most binary"
_BACK_SCHEMA = "gid int, h binary, tail binary"


def _receive(block: pa.Table) -> pa.Table:
    """Of one bucket: the hashes two owners have, back to each group that holds them."""
    h, tail, grp, least, most = _unpacked(block)
    order = np.lexsort((tail, h))
    hs, ts = h[order], tail[order]
    cut = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])]))
    shared = np.minimum.reduceat(least[order], cut) != np.maximum.reduceat(most[order], cut)
    hit = order[np.repeat(shared, np.diff(np.append(cut, len(h))))]
    hit = hit[np.argsort(grp[hit], kind="stable")]
    gids, first = np.unique(grp[hit], return_index=True)
    parts = np.split(hit, first[1:]) if len(gids) else []
    return pa.table(
        {
            "gid": pa.array(gids, pa.int32()),
            "h": pa.array([h[p].tobytes() for p in parts], pa.binary()),
            "tail": pa.array([tail[p].tobytes() for p in parts], pa.binary()),
        }
    )


def _known(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The (hash, tail) pairs sent back to a group, sorted."""
    if not back.num_rows:
        return np.zeros(0, _U), np.zeros(0, np.uint32)
    h = np.concatenate([np.frombuffer(x, _U) for x in back.column("h").to_pylist()])
    tail = np.concatenate([np.frombuffer(x, np.uint32) for x in back.column("tail").to_pylist()])
    order = np.lexsort((tail, h))
    return h[order], tail[order]


def _member(h: np.ndarray, tail: np.ndarray | None, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (hash, tail) pairs are known; without tails, which hashes."""
    kh, kt = known
    if not len(kh):
        return np.zeros(len(h), bool)
    at = np.searchsorted(kh, h)
    found = np.zeros(len(h), bool)
    live = np.flatnonzero(at < len(kh))
    while len(live):  # equal hashes with other tails follow one another
        live = live[kh[at[live]] == h[live]]
        if tail is None:
            found[live] = True
            break
        hit = kt[at[live]] == tail[live]
        found[live[hit]] = True
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(kh)]
    return found


def _candidate_windows(cp: np.ndarray, lens: np.ndarray, spans: list[np.ndarray], length: int):
    """(row, offset, hash, tail) of the windows whose starts lie in the given intervals of each row."""
    begin = np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(lens)), [len(s) for s in spans])
    flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
    lo, count = flat[:, 0].astype(np.int64) + begin[row], (flat[:, 1] - flat[:, 0]).astype(np.int64)
    at = _ranges(lo, count)
    return (
        np.repeat(row, count),
        at,
        Hasher(cp).windows(at, length),
        (Hasher(cp, 1).windows(at, length) >> _U(32)).astype(np.uint32),
    )


def shared_spans(df: DataFrame, *, key: str, owner: str, text: str, min_chars: int = 200, group_bytes: int = GROUP_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(``key``, ``shared_chars``) of every row with at least one shared run.

    ``shared_chars`` is the number of code points of ``text`` that lie in runs of
    ``min_chars`` or more which occur verbatim in the text of a row with another ``owner``.
    Rows of one owner never count against each other; rows with a null owner count as one
    owner.  Null, empty and shorter texts share nothing and give no row.  Repeated rows of
    one owner give one output row each.  Runs may overlap; each character counts once.
    Only the three named columns are read.
    """
    spark = df.sparkSession
    period, cover, window = cover_for(min_chars)
    reach = min_chars - window
    rows = df.select(
        F.col(key).alias("key"), F.xxhash64(F.lit(1), F.col(owner)).alias("owner"), F.col(text).cast("string").alias("txt")
    ).where(F.char_length("txt") >= min_chars)
    key_kind = rows.schema["key"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("txt"))).first()[0]
    groups = groups_for(spark, total, group_bytes)
    coarse, fine = _buckets(groups, fan_out)

    def grouped(d: DataFrame, gid: Column) -> DataFrame:
        return d.withColumn("gid", gid).repartitionById(groups, F.col("gid"))

    texts = grouped(rows, F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(lambda h: (h % _U(coarse)).astype(np.int64))
        for b in batches:
            own = b.column("owner").to_numpy(zero_copy_only=False)
            gid = b.column("gid").to_numpy(zero_copy_only=False)
            for first, cp, lens in _chunks(b.column("txt")):
                row, at = _anchors(lens, period, cover, window)
                h = Hasher(cp).windows(at, window)
                yield from out.add(h, np.zeros(len(h), np.uint32), gid[first + row].astype(np.int64), own[first + row], own[first + row])
        yield from out.flush()

    def find_candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows with hit anchors, each with the intervals of its candidate starts."""
        known = _known(right)
        left = left.combine_chunks()
        keep, spans = [], []
        if left.num_rows and len(known[0]):
            for first, cp, lens in _chunks(left.column("txt")):
                row, at = _anchors(lens, period, cover, window)
                hit = _member(Hasher(cp).windows(at, window), None, known)
                row, at = row[hit], at[hit]
                p = at - (np.cumsum(lens) - lens)[row]
                lo, hi = np.maximum(p - reach, 0), np.minimum(p, lens[row] - min_chars) + 1
                for r, a, z in zip(*_merge(row, lo, hi)):
                    keep.append(first + r)
                    spans.append(np.stack([a, z], 1).astype(np.int32).tobytes())
        got = left.take(pa.array(keep, pa.int64())).select(["key", "owner", "txt", "gid"])
        return got.append_column("spans", pa.array(spans, pa.binary()))

    cand_schema = f"key {key_kind}, owner bigint, txt string, gid int, spans binary"
    hits = _exchange(texts.mapInArrow(send_anchors, _BLOCK_SCHEMA), coarse, fine).repartitionById(groups, F.col("gid"))
    found = texts.groupBy("gid").cogroup(hits.groupBy("gid")).applyInArrow(find_candidates, cand_schema)
    cand = found.repartitionById(groups, F.col("gid"))

    def each_chunk(table: pa.Table | pa.RecordBatch):
        spans = [np.frombuffer(s, np.int32).reshape(-1, 2) for s in table.column("spans").to_pylist()]
        for first, cp, lens in _chunks(table.column("txt")):
            mine = spans[first : first + len(lens)]
            yield first, lens, *_candidate_windows(cp, lens, mine, min_chars)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(lambda h: (h % _U(coarse)).astype(np.int64))
        for b in batches:
            own = b.column("owner").to_numpy(zero_copy_only=False)
            gid = b.column("gid").to_numpy(zero_copy_only=False)
            for first, _, row, _, h, tail in each_chunk(b):
                yield from out.add(h, tail, gid[first + row].astype(np.int64), own[first + row], own[first + row])
        yield from out.flush()

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _known(right)
        left = left.combine_chunks()
        keys, chars = [], []
        if left.num_rows and len(known[0]):
            for first, lens, row, at, h, tail in each_chunk(left):
                hit = _member(h, tail, known)
                row, at = row[hit], at[hit]
                if not len(at):
                    continue
                # starts ascend within the chunk; each adds what the one before leaves open
                gap = np.append(np.diff(at), min_chars)
                gap[np.append(row[1:] != row[:-1], True)] = min_chars
                rows_hit, begin = np.unique(row, return_index=True)
                keys.append(first + rows_hit)
                chars.append(np.add.reduceat(np.minimum(gap, min_chars), begin))
        index = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        got = np.concatenate(chars) if chars else np.zeros(0, np.int64)
        return pa.table({"key": left.column("key").take(pa.array(index, pa.int64())), "shared_chars": pa.array(got, pa.int64())})

    shared = _exchange(cand.mapInArrow(send_windows, _BLOCK_SCHEMA), coarse, fine).repartitionById(groups, F.col("gid"))
    result = cand.groupBy("gid").cogroup(shared.groupBy("gid")).applyInArrow(measure, f"key {key_kind}, shared_chars bigint")
    return result.withColumnRenamed("key", key)


def _merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Per row the union of the half-open intervals; rows come in order, starts ascend within a row."""
    ok = hi > lo
    row, lo, hi = row[ok], lo[ok], hi[ok]
    if not len(row):
        return [], [], []
    # hi ascends with lo within a row, so an interval is apart when it starts beyond the one before
    apart = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])])
    start = np.flatnonzero(apart)
    a, z, r = lo[start], hi[np.append(start[1:], len(row)) - 1], row[start]
    rows, first = np.unique(r, return_index=True)
    return rows.tolist(), np.split(a, first[1:]), np.split(z, first[1:])
