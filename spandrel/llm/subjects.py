"""Subject areas of documents: bisecting k-means over document vectors, leaves labelled by discriminative terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import Scratch, spread as spread_rows

SPACE = 1 << 18  # hashed terms
DIMS = 256  # of a document vector
DEPTH = 5  # levels of bisection: up to 32 leaves
ROUNDS = 2  # passes of 2-means at each level
SHARPNESS = 20.0  # of a document's shares in leaves
REFINE = 2  # passes that sharpen term weights by segments
LEAST = 0.2  # "about a quarter": headings and boilerplate dilute a quarter of the prose to some .22 of all characters
LEAST_DOCS = 3  # documents that hold a term of the vocabulary
MAX_LABELS = 50_000  # labelled documents used; a bounded sample of hand-given labels, the smallest ids first
_BLOCK = 1 << 15

_TOKEN = re.compile(r"\w+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_SEGMENT = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


def stem(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith("es") and word[-3:-2] in "sxzh" and len(word) > 4:
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        return word[:-1]
    return word


def terms(token: str) -> list[str]:
    """Stems of the parts of a word or identifier, parts of fewer than three letters left out."""
    return [stem(p) for p in (q.lower() for q in _PARTS.findall(token)) if len(p) > 2]


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) % SPACE


class Reader:
    """Turns texts into term slots by segment; remembers the words it has seen."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}
        self.names: dict[int, str] = {}

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots in order, (terms, characters) of each segment, and (slot, count) of each distinct slot."""
        ids: list[int] = []
        sizes: list[int] = []
        known = self.known
        for segment in _SEGMENT.split(text):
            if not segment or segment.isspace():
                continue
            before = len(ids)
            for word in _TOKEN.findall(segment):
                got = known.get(word)
                if got is None:
                    if len(known) > 500_000:
                        known.clear()
                    got = known[word] = [slot(t) for t in terms(word)]
                    for t in terms(word):
                        self.names.setdefault(slot(t), t)
                ids += got
            sizes += (len(ids) - before, len(segment))
        flat = np.array(ids, np.int32)
        return flat, np.array(sizes, np.int32), np.stack(np.unique(flat, return_counts=True), 1).astype(np.int32)


_READ = "doc_id long, terms binary, segments binary, bag binary"


def _read(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            rows = [reader.read(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(3))], ["doc_id", "terms", "segments", "bag"])

    return spread_rows(documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _READ)


@dataclass
class Batch:
    """Documents of an Arrow batch as flat arrays."""

    ids: list[int]
    term: np.ndarray
    doc: np.ndarray  # of each term
    segment: np.ndarray  # of each term
    segment_doc: np.ndarray
    chars: np.ndarray  # of each segment


def _unpack(b: pa.RecordBatch) -> Batch:
    terms_ = [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
    segments = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in b.column(2).to_pylist()]
    flat = np.concatenate([*segments, np.zeros((0, 2), np.int32)])
    owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    return Batch(
        b.column(0).to_pylist(), np.concatenate([*terms_, np.zeros(0, np.int32)]), np.repeat(np.arange(len(terms_)), [len(t) for t in terms_]),
        np.repeat(np.arange(len(flat)), flat[:, 0]), owner, flat[:, 1].astype(float),
    )


def _sums(df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray | tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Sum over all rows of arrays of ``size`` (or of places and what is added there): folded within a split, blocks of
    splits added in tasks.

    The driver gets ``size`` numbers, which never depends on the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            part = fold(b)
            if isinstance(part, tuple):
                np.add.at(total, *part)
            else:
                total += part
        for k in range(0, size, _BLOCK):
            part = total[k : k + _BLOCK]
            at = np.nonzero(part)[0]
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["block", "at", "part"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK)
        for at, part in zip(rows["at"], rows["part"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(part)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "total": [total.tobytes()]})

    out = np.zeros(-(-size // _BLOCK) * _BLOCK)
    for block, total in df.mapInArrow(run, "block int, at binary, part binary").groupBy("block").applyInPandas(add, "block int, total binary").collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(total)
    return out[:size]


def _bags(b: pa.RecordBatch, column: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, slot, count of a column of bags."""
    rows = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in b.column(column).to_pylist()]
    flat = np.concatenate([*rows, np.zeros((0, 2), np.int32)])
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flat[:, 0], flat[:, 1]


def _document_frequency(b: pa.RecordBatch) -> np.ndarray:
    out = np.bincount(_bags(b)[1], minlength=SPACE + 1).astype(float)
    out[SPACE] = b.num_rows
    return out


def _vectors(bags: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, n: int) -> np.ndarray:
    """Normalised document vectors: logarithmic counts times ``weight`` of each term, hashed with a sign to DIMS."""
    doc, term, count = bags
    w = weight[term] * (1 + np.log(count))
    mixed = (term.astype(np.int64) * 2654435761) & 0xFFFFFFFF
    w = np.where(mixed & 1, w, -w)
    out = np.bincount(doc * DIMS + (mixed >> 8) % DIMS, w, n * DIMS).reshape(n, DIMS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _leaves(v: np.ndarray, tree: list[np.ndarray]) -> np.ndarray:
    """Leaf of each vector: at every level the nearer of the two centres of its node."""
    leaf, row = np.zeros(len(v), np.int64), np.arange(len(v))
    for centres in tree:
        leaf = leaf * 2 + ((v @ (centres[:, 1] - centres[:, 0]).T)[row, leaf] > 0)
    return leaf


def _memberships(v: np.ndarray, tree: list[np.ndarray]) -> np.ndarray:
    """How much of each vector belongs to each leaf: softened likeness to the leaves' centres."""
    like = v @ tree[-1].reshape(-1, v.shape[1]).T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
    out = np.exp((like - like.max(axis=1, keepdims=True)) * SHARPNESS)
    return out / out.sum(axis=1, keepdims=True)


def _by_group(v: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the rows of each group."""
    order = np.argsort(group, kind="stable")
    out = np.zeros((groups, v.shape[1]))
    first = np.nonzero(np.diff(group[order], prepend=-1))[0]
    if len(first):
        out[group[order][first]] = np.add.reduceat(v[order], first, axis=0, dtype=float)
    return out


def bisect(vectors: DataFrame, depth: int = DEPTH, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Centres (nodes, 2, DIMS) of each level of a bisecting k-means over the column ``v`` (int8), all documents.

    All nodes of a level are split in the same passes. A node starts from the two sides of its mean along its main
    direction, found by one power step from a fixed vector.
    """

    def load(b: pa.RecordBatch) -> np.ndarray:
        v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8).reshape(-1, DIMS).astype(np.float32)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)

    tree: list[np.ndarray] = []
    rng = np.random.default_rng(7)
    for level in range(depth):
        nodes, done = 1 << level, list(tree)
        start = rng.standard_normal((nodes, DIMS)).astype(np.float32)

        def spread(b: pa.RecordBatch, done=done, start=start, nodes=nodes) -> np.ndarray:
            v = load(b)
            leaf = _leaves(v, done)
            side = np.einsum("nd,nd->n", v, start[leaf])[:, None]
            return _by_group(np.concatenate([v, v * side, np.ones_like(side), side], 1), leaf, nodes).ravel()

        got = _sums(vectors, spread, nodes * (2 * DIMS + 2)).reshape(nodes, -1)
        n = np.maximum(got[:, 2 * DIMS : 2 * DIMS + 1], 1)
        mean = got[:, :DIMS] / n
        main = got[:, DIMS : 2 * DIMS] / n - mean * (got[:, 2 * DIMS + 1 :] / n)
        main /= np.maximum(np.linalg.norm(main, axis=1, keepdims=True), 1e-12)
        centres = np.stack([mean - main * 0.2, mean + main * 0.2], 1)
        for _ in range(rounds):
            centres = centres / np.maximum(np.linalg.norm(centres, axis=2, keepdims=True), 1e-12)

            def nearest(b: pa.RecordBatch, done=done, centres=centres.astype(np.float32), nodes=nodes) -> np.ndarray:
                v = load(b)
                return _by_group(v, _leaves(v, [*done, centres]), 2 * nodes).ravel()

            got = _sums(vectors, nearest, 2 * nodes * DIMS).reshape(nodes, 2, DIMS)
            empty = np.linalg.norm(got, axis=2, keepdims=True) < 1e-9
            centres = np.where(empty, centres, got)
        tree.append((centres / np.maximum(np.linalg.norm(centres, axis=2, keepdims=True), 1e-12)).astype(np.float32))
    return tree


@dataclass
class Model:
    """Term weights by subject, and what they came from."""

    subjects: list[str]
    place: np.ndarray  # (SPACE,): row of each slot among the vocabulary, -1 for none
    weight: np.ndarray  # (vocabulary, subjects): logarithm of how much more often than elsewhere, 0 if not telling
    tree: list[np.ndarray]
    mixture: np.ndarray  # (leaves, subjects)
    idf: np.ndarray  # (SPACE,)


def _segment_subject(x: Batch, place: np.ndarray, weight: np.ndarray, floor: float, leaf: np.ndarray | None = None) -> np.ndarray:
    """Subject of each segment, -1 for none: the largest sum of weights, if it is clear.

    Words of several subjects are read as the document's own: sums count by half, and up to as much again as the
    mixture of its leaves (``leaf``, documents by subjects) and that of its own words have of the subject.
    """
    out = np.full(len(x.chars), -1)
    telling = np.zeros(len(place), bool)
    telling[place >= 0] = weight.any(axis=1)[place[place >= 0]]
    hit = np.nonzero(telling[x.term])[0]
    if len(hit):
        segment = x.segment[hit]
        first = np.nonzero(np.diff(segment, prepend=-1))[0]
        score = np.add.reduceat(weight[place[x.term[hit]]], first, axis=0)
        clear = score.max(axis=1) >= floor
        owner = x.segment_doc[segment[first]]
        start = np.nonzero(np.diff(owner, prepend=-1))[0]
        mixture = np.add.reduceat(score, start, axis=0)
        mixture /= mixture.sum(axis=1, keepdims=True)
        if leaf is not None:
            mixture = (mixture + leaf[owner[start]]) / 2
        score *= 0.5 + np.repeat(mixture, np.diff(np.append(start, len(owner))), axis=0)
        out[segment[first]] = np.where(clear, score.argmax(axis=1), -1)
    return out


def fit(documents: DataFrame, subjects: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model, and the documents as term arrays (doc_id, terms, segments)."""
    read = scratch.keep(_read(documents))
    rows = sorted((r[0], r[1] or "") for r in subjects.filter("subject is not null").select("subject", "description").distinct().collect())
    names = [n for n, _ in rows]
    df = _sums(read.select("bag"), _document_frequency, SPACE + 1)
    n = max(df[SPACE], 1.0)
    df = df[:SPACE]
    place = np.full(SPACE, -1, np.int32)
    idf = np.where((df >= LEAST_DOCS) & (df <= 0.5 * n), np.log(n / np.maximum(df, 1)), 0.0)
    size = int((idf > 0).sum())
    place[idf > 0] = np.arange(size)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(_bags(b), idf, b.num_rows)
            q = np.clip(np.rint(v * 250), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in q], pa.binary())], ["v"])

    tree = bisect(scratch.keep(read.select("bag").mapInArrow(vectors, "v binary")))
    leaves = 1 << len(tree)

    # terms of each leaf, and the subjects that labelled documents of a leaf have
    named = {s.strip().lower(): i for i, s in enumerate(names)}
    given = labels.filter("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("s")).filter(F.col("s").isin(*named) if named else F.lit(False))
    given = given.distinct().orderBy("doc_id", "s").limit(MAX_LABELS).collect()
    known: dict[int, list[int]] = {}
    for i, s in given:
        known.setdefault(i, []).append(named[s])

    k = len(names)

    def by_leaf(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        doc, term, n_ = bags = _bags(b, 1)
        leaf = _leaves(np.rint(_vectors(bags, idf, b.num_rows) * 250).astype(np.float32), tree)
        keep = place[term] >= 0
        votes = np.array([leaves * size + leaf[row] * k + s for row, i in enumerate(b.column(0).to_pylist()) for s in known.get(i, ())], np.int64)
        return np.concatenate([leaf[doc[keep]] * size + place[term[keep]], votes]), np.concatenate([n_[keep], np.ones(len(votes))])

    got = _sums(read.select("doc_id", "bag"), by_leaf, leaves * size + leaves * k)
    count, votes = got[: leaves * size].reshape(leaves, size), got[leaves * size :].reshape(leaves, k)
    # a leaf is about a subject as far as the description's discriminative terms come up in it, measured against
    # the leaf where they come up most; a leaf where none does is about nothing
    total = np.maximum(count.sum(1, keepdims=True), 1)
    lift = count / total / np.maximum(count.sum(0) / max(count.sum(), 1), 1e-12)
    seeds = [{int(place[slot(t)]) for w in _TOKEN.findall(text) for t in terms(w)} - {-1} for _, text in rows]
    shared = {t for i, a in enumerate(seeds) for b in seeds[i + 1 :] for t in a & b}
    evidence = np.zeros((leaves, k))
    for i, own in enumerate(seeds):
        at = sorted(own - shared)
        evidence[:, i] = (np.where(lift[:, at] > 1.5, count[:, at], 0) / total).sum(1) if at else 0
    evidence /= np.maximum(evidence.max(0, keepdims=True), 1e-12)
    votes = votes / np.maximum(votes.sum(1, keepdims=True), 4)
    mixture = np.where(evidence >= 0.2, evidence + votes, 0)
    mixture = np.where(mixture >= 0.2 * mixture.max(1, keepdims=True), mixture, 0)
    mixture /= np.maximum(mixture.sum(1, keepdims=True), 1e-9)

    # terms by subject through the leaves' mixtures, then by the segments that these terms decide
    own = mixture.T @ count
    weight = _weights(own, count.sum(0), 2.0)
    for _ in range(REFINE):

        def by_segment(b: pa.RecordBatch, weight=weight) -> tuple[np.ndarray, np.ndarray]:
            x = _unpack(b)
            subject = _segment_subject(x, place, weight, 1.0)[x.segment]
            at = place[x.term]
            places, times = np.unique((at + size * (subject + 1))[at >= 0], return_counts=True)
            return places, times

        own = _sums(read.select("doc_id", "terms", "segments"), by_segment, size * (k + 1)).reshape(k + 1, size)
        weight = _weights(own[1:], own.sum(0), 3.0)
    return Model(names, place, weight, tree, mixture, idf), read


def _weights(own: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Logarithm of a term's share in a subject over the subject's share of all terms, if that is ``least`` times or more and no chance."""
    share = own.sum(1, keepdims=True) / max(total.sum(), 1)
    expected = total * share
    lift = own / np.maximum(expected, 1e-9)
    telling = (lift >= least) & (own >= 3) & (own >= 0.2 * total) & (own - expected >= 4 * np.sqrt(expected))
    return np.where(telling, np.log(np.maximum(lift, 1)), 0).T.astype(np.float32)


def subject_shares(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, subject, share: the part of each document's text (in characters) that is about a subject.

    1. One pass over all texts turns them into arrays of hashed term stems by segment (sentence or line); document
    frequencies are counted over all of them. 2. Document vectors (logarithmic counts, inverse document frequency,
    256 signed hash buckets, normalised) are clustered by bisecting k-means over all documents, 5 levels deep.
    3. A leaf's mixture of subjects comes from those of its discriminative terms that the subjects' descriptions
    name, and from at most 50,000 labelled documents. 4. Terms get weights by subject through the mixtures of the
    leaves they occur in, sharpened in two passes over segments. 5. A document shares in the leaves by its
    likeness to their centres, and so in their subjects; a segment belongs to the subject with the largest sum of
    weights times what the document's leaves and own words have of it, or to none.

    Nothing but sums over terms and centres, whose size doesn't depend on the corpus, comes to the driver.

    Defined results: null, empty and blank texts have no shares; rows that repeat a doc_id give the mean share;
    labels that name no subject are ignored, after trimming and lowering; without subjects or documents there are
    no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    if subjects.filter("subject is not null").isEmpty():
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    model, read = fit(documents, subjects, labels, scratch)
    names, known = model.subjects, documents.sparkSession.sparkContext.broadcast((model.place, model.weight, model.idf.astype(np.float32), model.tree, model.mixture.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        place, weight, idf, tree, mixture = known.value
        for b in batches:
            x = _unpack(b)
            leaf = _memberships(_vectors(_bags(b, 3), idf, b.num_rows), tree) @ mixture
            subject = _segment_subject(x, place, weight, 1.0, leaf)
            share = np.zeros((b.num_rows, k))
            at = subject >= 0
            np.add.at(share, (x.segment_doc[at], subject[at]), x.chars[at])
            share /= np.maximum(np.bincount(x.segment_doc, x.chars, b.num_rows), 1)[:, None]
            row, col = np.nonzero(share)
            yield pa.RecordBatch.from_arrays([pa.array([x.ids[r] for r in row], pa.int64()), pa.array([names[c] for c in col], pa.string()), pa.array(share[row, col])], ["doc_id", "subject", "share"])

    return read.select("doc_id", "terms", "segments", "bag").mapInArrow(run, "doc_id long, subject string, share double").groupBy("doc_id", "subject").agg(F.avg("share").alias("share"))


def main_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, subject, share of the subjects that at least ``least`` of a document's text is about."""
    return subject_shares(documents, subjects, labels).filter(F.col("share") >= least)
