"""Subject areas of documents by seeded non-negative matrix factorisation.

The rows of the matrix are the sentences of all documents, its columns their terms (words,
word pairs, pairs of Chinese characters), weighted by rarity.  It is factored into sentence x
component and component x term matrices by alternating multiplicative updates.  Components are
anchored: the component of a subject begins with the terms that stand out in its labelled
examples, and a term anchored to one subject is zero in the components of all others, which
the updates keep at zero.  Further components take up what sentences of all subjects share;
they begin with the terms that examples of many subjects hold, and only with those.  Terms
that no example holds find their component by the sentences they stand in.  The components
are then subjects as they are, without any matching afterwards.

A sentence's weights of the subjects' components, normalised to 1, are its mixture, and it is
about the subject with the majority of it.  A document's mixture is the mean of the mixtures of
the sentences that are about some subject; it deals with the subjects that have ``MIN_SHARE`` of
its mixture, the largest first, at most ``MAX_SUBJECTS``.

Texts are read once: sentences are kept as term hashes, then as term numbers (written to the
checkpoint folder).  The factors are updated in turn.  Given the terms, the sentence side is
local to each task; given the sentences, the term side needs two sums of fixed size (components x
terms and components x components), which are added up in two levels.  Nothing grows with the
number of documents but the rows each task walks over.  A term counts if it stands in ``MIN_DOCS``
documents and in ``MIN_DOC_SHARE`` of all, so the vocabulary has at most the terms of an average
document divided by ``MIN_DOC_SHARE``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage, spread

#: A term stands in this many documents at least (examples count as documents), and in this share of them.
MIN_DOCS = 4
MIN_DOC_SHARE = 1e-5
#: Power of the rarity that weights a term: what all sentences share weighs little.
RARITY = 2
#: Components beside the subjects.
SHARED = 6
#: Updates of the term side at most, and of the sentence side within each; fewer once the term side changes by less than ``SETTLED``.
ROUNDS = 3
INNER = 8
SETTLED = 0.02
#: A sentence is about the subject that has this share of its mixture.
MAJORITY = 0.5
#: Share of a document's mixture a subject needs; passing mentions lie below.
MIN_SHARE = 0.25
MAX_SUBJECTS = 2
#: Sentences a second subject needs, and the share of all sentences the first one needs.
MIN_SENTENCES = 2
MIN_TOLD = 0.15

# ---------------------------------------------------------------- terms

#: Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοιρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaoipvABEZHIKMNOPTYX")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_NAMED = re.compile(r"[`‘][^`\n]{0,200}`")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|&[a-z]{2,8};|https?://\S+")
_LOG = re.compile(r"^\d{2}:\d{2}:\d{2}\S* .*$", re.M)
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_HAN_GAP = re.compile(r"(?<=[一-鿿])[ \t　 ]+(?=[一-鿿])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[。！？]+|\n\s*\n+|(?:^|\n)\s*(?:[-*#>]+|\d+[.)])\s+")
_IDENTIFIER = re.compile(r"\b[A-Za-z]*[a-z][A-Z]\w*")
_WORD = re.compile(r"[a-zà-öø-ÿœß]+|[一-鿿]+")


_LOST = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u2122]{1,3}")


def _found_again(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group().encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


def repaired(text: str) -> str:
    """The text with look-alike letters, odd forms, lost encodings and invisible characters set right."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _LOST.sub(_found_again, text))).translate(_LOOK_ALIKES)
    return text


def sentences(text: str) -> list[str]:
    """Sentences of the prose of a text; code, logs, markup and quoted names are left out."""
    s = _LOG.sub("\n\n", _TAG.sub(" ", _NAMED.sub(" ", _FENCED.sub("\n\n", repaired(text)))))
    return [x for x in (p.strip() for p in _SENTENCE.split(s) if p) if len(x) > 1]


@lru_cache(maxsize=200_000)
def _stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def terms(sentence: str) -> list[str]:
    """Distinct terms: words of three letters and more, pairs of adjacent ones, pairs of Chinese characters."""
    s = _HAN_GAP.sub("", _IDENTIFIER.sub(" ", sentence)).lower()
    out: dict[str, None] = {}
    before = ""
    for w in _WORD.findall(s):
        if w[0] >= "一":
            for i in range(len(w) - 1):
                out[w[i : i + 2]] = None
            before = ""
            continue
        w = _stem(w)
        if len(w) > 2:
            out[w] = None
        if before and len(before) > 2 and len(w) > 2:
            out[f"{before} {w}"] = None
        before = w
    return list(out)


_HASHES: dict[str, int] = {}


def term_hash(term: str) -> int:
    """64 bits that stand for a term."""
    h = _HASHES.get(term)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[term] = xxhash.xxh3_64_intdigest(term)
    return h


def _nested(flat: pa.Array, sizes: list[int] | np.ndarray, per_doc: list[int] | np.ndarray) -> pa.ListArray:
    """Lists of lists from the flat values, the sizes of the inner lists and how many of them each row has."""

    def offsets(n) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32))

    return pa.ListArray.from_arrays(offsets(per_doc), pa.ListArray.from_arrays(offsets(sizes), flat))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences): each document's sentences as term hashes; the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes, per_doc = [], [], []
            for text in b.column(1).to_pylist():
                own = [terms(x) for x in sentences(text)]
                per_doc.append(len(own))
                for ts in own:
                    sizes.append(len(ts))
                    flat += [term_hash(t) for t in ts]
            lists = _nested(pa.array(np.array(flat, np.uint64).view(np.int64)), sizes, per_doc)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "sentences"])

    return spread(docs).mapInArrow(run, "doc_id bigint, sentences array<array<bigint>>")


def _count_terms(docs: DataFrame) -> DataFrame:
    """(term, docs) over all hashed documents, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row, _ = _flat(b.column(1), False)
            order = np.lexsort((ids, row))
            ids, row = ids[order], row[order]
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
            found, n = np.unique(ids[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["term", "docs"])

    return docs.mapInArrow(run, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- the model


class Vocabulary:
    """Numbers of the known terms, by their hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def get(self, term: str) -> int | None:
        n = int(self.numbers(np.array([term_hash(term)], np.uint64).view(np.int64))[0])
        return n if n >= 0 else None

    def __contains__(self, term: str) -> bool:
        return self.get(term) is not None


class Subjects:
    """Component x term matrix with the subjects first; ``value``: the weight of each term."""

    def __init__(self, subjects: list[str], vocabulary: Vocabulary, value: np.ndarray, h: np.ndarray) -> None:
        self.subjects, self.vocabulary, self.value, self.h = subjects, vocabulary, value, h


def _weights(h: np.ndarray, values: np.ndarray, ids: np.ndarray, row: np.ndarray, n: int, inner: int = INNER) -> np.ndarray:
    """Sentence x component weights for fixed terms, by multiplicative updates."""
    k = len(h)
    value = values[ids]
    num = np.empty((n, k))
    for c in range(k):
        num[:, c] = np.bincount(row, h[c, ids] * value, n)
    gram = h @ h.T
    w = num + 1e-9
    for _ in range(inner):
        w *= num / (w @ gram + 1e-9)
    return w


def _flat(lists: pa.ListArray, by_sentence: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(term numbers, sentence or document of each, how many) of documents as lists of sentences."""
    inner = lists.flatten()
    ids = inner.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(inner.offsets.to_numpy())
    if not by_sentence:
        cut = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        size = np.diff(cut[ends])
    return ids, np.repeat(np.arange(len(size)), size), len(size)


def _seed(subjects: list[str], examples: list[tuple[str, str]], vocabulary: Vocabulary) -> np.ndarray:
    """Initial components: anchored terms in their subject only, common ones in the shared components only, others in all subjects."""
    k, v = len(subjects), len(vocabulary)
    count = np.zeros((k, v))
    size = np.zeros(k)
    at = {s: i for i, s in enumerate(subjects)}
    for subject, text in examples:
        s = at[subject]
        for sent in sentences(text):
            size[s] += 1
            for t in terms(sent):
                n = vocabulary.get(t)
                if n is not None:
                    count[s, n] += 1
    rate = count / np.maximum(size[:, None], 1)
    total = rate.sum(0)
    best = rate.argmax(0)
    share = rate.max(0) / np.maximum(total, 1e-12)
    seen = count.sum(0)
    spread = (count > 0).sum(0)
    anchored = (seen >= 2) & (share >= 0.75)
    common = (spread >= max(3, k // 3)) & (share < 0.5)
    h = np.full((k + SHARED, v), 0.02)
    h[:k, common] = 0.0
    h[:, anchored] = 0.0
    h[best[anchored], np.flatnonzero(anchored)] = 1.0
    some = ~anchored & ~common & (seen > 0)
    h[:k, some] = 0.02 + rate[:, some] / np.maximum(rate[:, some].max(0), 1e-12) * 0.5
    noise = np.random.RandomState(3).rand(SHARED, v)
    h[k:] = np.where(common, 0.3 + noise, 0.0)
    return h / np.linalg.norm(h, axis=1, keepdims=True).clip(1e-12)


def _sums(encoded: DataFrame, h: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(W'V, W'W) over all sentences: per task, then per component in two levels."""
    k, v = h.shape
    small = h.astype(np.float32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wv, ww = np.zeros((k, v)), np.zeros((k, k))
        for b in batches:
            ids, row, n = _flat(b.column(1), True)
            if not len(ids):
                continue
            w = _weights(small, values, ids, row, n)
            value = values[ids]
            for c in range(k):
                wv[c] += np.bincount(ids, w[row, c] * value, v)
            ww += w.T @ w
        yield from _packed(np.concatenate([wv, ww], 1))

    wv, ww = np.zeros((k, v)), np.zeros((k, k))
    for c, a in _added(encoded.mapInArrow(task, _SUMS)):
        wv[c], ww[c] = a[:v], a[v:]
    return wv, ww


_SUMS = "c int, salt int, sums binary"


def _packed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix of one task, salted for the first level of the sum."""
    from pyspark import TaskContext

    n = len(rows)
    salt = TaskContext.get().partitionId() % 64
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, salt, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["c", "salt", "sums"]
    )


def _added(parts: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, sum over all tasks), added in two levels."""

    def add(t: pa.Table) -> pa.Table:
        sums = t.column("sums").to_pylist()
        total = np.frombuffer(sums[0]).copy()
        for x in sums[1:]:
            total += np.frombuffer(x)
        return pa.table({"c": t.column("c").slice(0, 1), "salt": t.column("salt").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    done = parts.groupBy("c", "salt").applyInArrow(add, _SUMS).groupBy("c").applyInArrow(add, _SUMS).toArrow()
    for c, x in zip(done.column("c").to_pylist(), done.column("sums").to_pylist()):
        yield c, np.frombuffer(x)


def fit(documents: DataFrame, areas: DataFrame, examples: DataFrame, *, rounds: int = ROUNDS) -> tuple[Subjects, DataFrame]:
    """(model, encoded documents); runs its passes at once.

    ``documents``: ``doc_id``, ``text``; ``areas``: ``subject``; ``examples``: ``subject``,
    ``text``, the labelled rows (a small table, read to the driver).  The encoded documents
    hold each document's sentences as term numbers.
    """
    subjects = sorted(r.subject for r in areas.select("subject").where(F.col("subject").isNotNull()).distinct().collect())
    labelled = [(r.subject, r.text) for r in examples.select("subject", "text").where(F.col("text").isNotNull()).collect() if r.subject in set(subjects)]
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    read = cut_lineage(hashed(docs))
    texts = examples.select(F.lit(-1).cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    total = max(1, read.count() + len(labelled))
    least = max(MIN_DOCS, MIN_DOC_SHARE * total)
    kept = _count_terms(read.unionByName(hashed(texts))).where(F.col("docs") >= least).toArrow()
    order = np.argsort(kept.column("term").to_numpy())
    vocabulary, df = Vocabulary(kept.column("term").to_numpy()), kept.column("docs").to_numpy()[order]
    rarity = np.log(1 + total / np.maximum(df, 1)) / np.log(1 + total)
    model = Subjects(subjects, vocabulary, rarity**RARITY, _seed(subjects, labelled, vocabulary))
    encoded = cut_lineage(_encode(read, vocabulary))
    for _ in range(rounds if len(vocabulary) else 0):
        wv, ww = _sums(encoded, model.h, model.value)
        new = model.h * (wv / (ww @ model.h + 1e-9))
        new /= np.linalg.norm(new, axis=1, keepdims=True).clip(1e-12)
        change = np.linalg.norm(new - model.h) / max(np.linalg.norm(model.h), 1e-12)
        model.h = new
        if change < SETTLED:
            break
    return model, encoded


def _encode(read: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Hashes as term numbers; unknown terms and sentences without a known one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            hashes, row, n = _flat(lists, True)
            doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ids = vocabulary.numbers(hashes)
            known = ids >= 0
            sizes = np.bincount(row[known], minlength=n)
            some = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _nested(pa.array(ids[known].astype(np.int32)), sizes[some], np.bincount(doc[some], minlength=b.num_rows))], ["doc_id", "sentences"]
            )

    return read.mapInArrow(run, "doc_id bigint, sentences array<array<int>>")


def mixtures(model: Subjects, lists: pa.ListArray) -> np.ndarray:
    """Sentence x subject: each sentence's weights of the subjects' components, normalised to 1 (0 where it has none)."""
    ids, row, n = _flat(lists, True)
    k = len(model.subjects)
    if not len(ids):
        return np.zeros((n, k))
    w = _weights(model.h, model.value, ids, row, n)[:, :k]
    return w / np.maximum(w.sum(1, keepdims=True), 1e-12)


def assign(model: Subjects, encoded: DataFrame, *, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, subject, share) of every subject with a good part of the document's mixture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mixed = mixtures(model, b.column(1))
            ends = np.cumsum(np.diff(b.column(1).offsets.to_numpy()))
            ids, names, shares = [], [], []
            at = 0
            for doc_id, end in zip(b.column(0).to_pylist(), ends.tolist()):
                for s, share in chosen(mixed[at:end], min_share):
                    ids.append(doc_id)
                    names.append(model.subjects[s])
                    shares.append(share)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "subject", "share"])

    return encoded.mapInArrow(run, "doc_id bigint, subject string, share double")


def chosen(mixed: np.ndarray, min_share: float = MIN_SHARE) -> list[tuple[int, float]]:
    """Subjects of one document from the mixtures of its sentences, largest first.

    The document's mixture is the mean over the sentences that are about some subject: fillers
    belong to none.  The first subject needs ``MIN_TOLD`` of all sentences, each further one
    ``MIN_SENTENCES``.
    """
    told = mixed[mixed.max(1, initial=0.0) >= MAJORITY]
    if not len(told):
        return []
    whole = told.mean(0)
    count = np.bincount(told.argmax(1), minlength=mixed.shape[1])
    out: list[tuple[int, float]] = []
    for s in np.lexsort((-count, -whole))[:MAX_SUBJECTS]:
        enough = count[s] >= MIN_SENTENCES if out else count[s] >= MIN_TOLD * len(mixed)
        if whole[s] >= min_share and enough:
            out.append((int(s), float(whole[s])))
    return out


def found(documents: DataFrame, areas: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, subject): none, one or two rows per document.

    Null and blank texts, logs and code have no sentences and no subject; repeated texts are
    assigned each under its own id; an empty table gives no row.
    """
    model, encoded = fit(documents, areas, examples)
    return assign(model, encoded).select("doc_id", "subject")


def composition(documents: DataFrame, areas: DataFrame, examples: DataFrame) -> DataFrame:
    """Per subject of ``areas``: its documents and its weight (the sum of its shares), and their share of all."""
    model, encoded = fit(documents, areas, examples)
    per = assign(model, encoded).groupBy("subject").agg(F.countDistinct("doc_id").alias("docs"), F.sum("share").alias("weight"))
    out = areas.select("subject").where("subject is not null").distinct().join(per, "subject", "left").na.fill(0, ["docs"]).na.fill(0.0, ["weight"])
    from pyspark.sql.window import Window

    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))  # as many rows as subjects
    return out.withColumn("corpus_share", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(0.0)))
