"""Evaluation texts leaking into training text, by the q-gram lemma in diagonal bands and banded alignment."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import spread

LEAST_WORDS = 25  # words in a row that make a leak
EDITS = 4  # word edits allowed among as many words
PHRASE = 3  # words of a run that makes common phrasing when SHARED_BY items hold it; all other words are an item's own, in which near misses differ
SHARED_BY = 4
LEAST_OWN = 3  # own words of a leak; what has fewer is common phrasing
SHARED_RUNS = ((12, SHARED_BY - 1), (20, 2))  # words of a run, and items that hold it before it is shared text
SPAN = LEAST_WORDS + 2 * EDITS  # words of the longest span looked at; longer leaks hold shorter ones
Q = 12  # bytes of a q-gram
SHORT_Q = 8  # of windows that longer q-grams can't tell: any 25 words with 4 edits keep at least 6 of these
OFTEN = 12  # items that hold a q-gram before windows with few rare ones do without it
LEAST_GRAMS = 10  # q-grams of Q bytes that a window must be sure to keep
BAND = 2 * (EDITS + 1)  # word diagonals of a band; bands overlap by half, so that EDITS edits stay inside of one
HALF = BAND // 2
BITS = 21
BUCKETS = 1 << 19  # places where the half bands of an item may begin to be counted
INDEX_BYTES = 4 << 20  # text of the items that are indexed at once; more take as many passes over the documents

_PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:\[[\d:.,TZ \-/]{3,30}\]|\d{1,2}:\d\d(?::\d\d)?|\d+[.):|])[ \t]+)?(?:[A-Za-z][\w-]{0,15}:[ \t]+)?")
_ESCAPE = re.compile(r"\\+(?:[nrtbfv\"'/`]|u00[0-9a-fA-F]{2}|x[0-9a-fA-F]{2})|&(?:amp|lt|gt|quot|apos|nbsp|#\d{1,4}|#x[0-9a-fA-F]{1,4});")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]")
_KEPT = bytes(c if c in b"\x000123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 32 for c in range(256))
_SPACES = re.compile(b"  +")
_SOLID = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")  # scripts without spaces: each character is a word
_WIDE_GAP = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f\uff00-\uff0f\ufe30-\ufe4f\ud800-\udfff]")


def canonical(text: str) -> str:
    """Words in lower case between single spaces; line prefixes, escapes, punctuation and layout are gone. NUL stays."""
    return _spaced(_narrowed(text)).decode("utf-8", "replace")


def _narrowed(text: str) -> str:
    """Compatible forms, without what is seen nowhere; punctuation is a space, and words of one character have them around."""
    return text if text.isascii() else _SOLID.sub(r" \1 ", _WIDE_GAP.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))))


def _spaced(text: str) -> bytes:
    text = _PREFIX.sub("", text)
    if "\\" in text or "&" in text:
        text = _ESCAPE.sub(" ", text)
    # bytes of wider characters stay as they are
    return _SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(_KEPT))


def _grams(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` bytes (8 to 23) from each position on."""
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    a = raw.astype(np.uint64)
    w = a[:-1] | (a[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    w = w[:-4] | (w[4:] << np.uint64(32))
    n = len(raw) - q + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in sorted({min(8, q - 8), q - 8} - {0}):
        h ^= (w[at : at + n] + (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    return np.array([known[w] for w in words], np.uint64)


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` words from each word on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return out


# what is counted over all items: words of a run (or 0 for q-grams), and the items that make it common
_COMMON = ((0, SHARED_BY), (0, OFTEN), *SHARED_RUNS, (PHRASE, SHARED_BY))


def _counted_hashes(text: str, known: dict[str, int]) -> list[np.ndarray]:
    """The hashes of one canonical text that are counted over all items, in the order of ``_COMMON``."""
    words = _word_hashes(text.split(), known)
    return [_run_hashes(words, n) if n else _grams(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), Q) for n, _ in _COMMON]


def _canonical_texts(items: Iterable[tuple[str, list[str | None]]]) -> list[tuple[str, str]]:
    """Distinct (instance, canonical text)."""
    return [x for x in dict.fromkeys((name, canonical(t).strip()) for name, ts in items for t in ts if t) if x[1]]


def _common_here(texts: list[tuple[str, str]]) -> list[np.ndarray]:
    """For each of ``_COMMON`` the sorted hashes that so many of the items hold."""
    known: dict[str, int] = {}
    owner = {n: i for i, n in enumerate(dict.fromkeys(n for n, _ in texts))}
    hashes = [_counted_hashes(t, known) for _, t in texts]
    out = []
    for k, (_, least) in enumerate(_COMMON):
        flat = np.concatenate([*(h[k] for h in hashes), np.zeros(0, np.uint64)])
        who = np.repeat(np.array([owner[n] for n, _ in texts], np.uint64), [len(h[k]) for h in hashes])
        order = np.lexsort((who, flat))
        flat, who = flat[order], who[order]
        once = np.ones(len(flat), bool)
        once[1:] = (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])  # an item counts once
        distinct, n = np.unique(flat[once], return_counts=True)
        out.append(distinct[n >= least])
    return out


def _common_everywhere(instances: DataFrame, parts: int) -> DataFrame:
    """part, k, hash: what ``_common_here`` gives, counted over the items of all parts, for the parts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for name, part, *texts in zip(*(c.to_pylist() for c in b.columns)):
                for _, text in _canonical_texts([(name, texts)]):
                    for k, h in enumerate(_counted_hashes(text, known)):
                        h = np.unique(h).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), part, np.int32)), pa.array(np.full(len(h), k, np.int32)), pa.array(h)], ["name", "part", "k", "hash"])

    held = _parted(instances, parts).mapInArrow(run, "name string, part int, k int, hash long").distinct()
    least = F.element_at(F.array(*(F.lit(n) for _, n in _COMMON)), F.col("k") + 1)
    common = held.groupBy("k", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("k", "hash")
    return held.select("part", "k", "hash").distinct().join(common, ["k", "hash"], "left_semi")


def _parted(instances: DataFrame, parts: int) -> DataFrame:
    """instance_id, part and texts of the items that have any."""
    rows = instances.filter("instance_id is not null and coalesce(problem_statement, patch) is not null")
    return rows.select("instance_id", F.pmod(F.xxhash64("instance_id"), F.lit(parts)).cast("int").alias("part"), "problem_statement", "patch").distinct()


@dataclass
class Grams:
    """Index of the q-grams of some windows of all texts, and what the windows need of them."""

    q: int
    keys: np.ndarray  # sorted distinct hashes, and the highest of all
    first: np.ndarray  # first posting of each hash
    times: np.ndarray  # its postings
    bits: np.ndarray  # filter over the upper bits of the hashes
    text: np.ndarray  # text of each posting
    at: np.ndarray  # its byte
    word: np.ndarray  # its word
    least: np.ndarray  # fewest that a window with the q-gram of each posting must keep
    low: np.ndarray  # first window that the q-gram of each posting lies in
    high: np.ndarray  # end of these
    last: np.ndarray  # last byte of a q-gram in each window; windows in the order of texts and words
    kept: np.ndarray  # q-grams it must keep
    begin: np.ndarray  # its first word
    end: np.ndarray  # end of its words
    most: np.ndarray  # own words that may be edited

    @cached_property
    def slots(self) -> np.ndarray:
        """First hash by upper bits; made by the worker, as it is larger than the rest."""
        held = np.bincount((self.keys >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        return (np.cumsum(held) - held).astype(np.int32)


@dataclass
class Index:
    """Items by text."""

    items: list[str]  # instance of each text
    words: list[list[str]]
    shared: list[np.ndarray]  # words in 12 words that 3 items hold, or 20 that 2 hold
    own: list[np.ndarray]  # words outside of runs of PHRASE words that SHARED_BY items hold
    start: np.ndarray  # the first word of each text among those of all texts, one after the other
    all_own: np.ndarray  # ``own`` of these
    hashes: np.ndarray  # of these
    grams: list[Grams]


_HIGHEST = np.uint64(2**64 - 1)
_POWERS = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15, np.uint64))
_INVERSE = np.cumprod(np.full(1 << 10, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))


def _words_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each word; equal words have the same, others seldom."""
    global _POWERS, _INVERSE
    if len(_POWERS) <= len(raw):
        _POWERS = np.cumprod(np.full(2 * len(raw), 0x9E3779B97F4A7C15, np.uint64))
        _INVERSE = np.cumprod(np.full(2 * len(raw), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)])])
    return (sums[ends] - sums[starts]) * _INVERSE[starts]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in the ``n`` from one of ``at`` on."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, size), -1)
    return np.cumsum(step[:-1]) > 0


def _spans(shared: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end, and own words that may be edited, of each window of LEAST_WORDS words outside of shared text."""
    free = np.nonzero(~shared)[0]
    n = max(0, len(free) - LEAST_WORDS + 1)
    a, z = free[:n], free[LEAST_WORDS - 1 :] + 1
    count = np.concatenate([[0], np.cumsum(own)])
    longest = free[np.minimum(np.arange(n) + SPAN, len(free)) - 1] + 1
    return a, z, np.minimum(EDITS, EDITS * (count[longest] - count[a]) // LEAST_WORDS)


def _kept(q: int, used: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, a: np.ndarray, z: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last q-gram of the windows of words ``a`` to ``z`` (not included), and how many they are sure to keep.

    The q-gram lemma for word edits: an edit of a word (or beside it) takes no other q-grams than those that overlap
    it or the space behind it. What is left after EDITS edits, ``most`` of them on the item's own words, is at least
    all in use less those of the words that most overlap.
    """
    count = np.concatenate([[0], np.cumsum(used)])
    first, last = starts[a], np.maximum(ends[z - 1] - q + 1, starts[a])  # q-grams begin in [first, last)
    kept = count[last] - count[first]
    for m in np.unique(z - a).tolist():
        rows = np.nonzero(z - a == m)[0]
        for some in np.array_split(rows, len(rows) * m // 2_000_000 + 1):
            w = a[some][:, None] + np.arange(m)
            lo = np.minimum(np.maximum(starts[w] - q + 1, first[some][:, None]), last[some][:, None])
            hi = np.maximum(lo, np.minimum(ends[w] + 1, last[some][:, None]))
            lost, mine = count[hi] - count[lo], own[w]
            top = lambda x: np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(-np.sort(-x, axis=1)[:, :EDITS], axis=1)], axis=1)
            of_own, of_rest = top(np.where(mine, lost, 0)), top(np.where(mine, 0, lost))
            worst = np.zeros(len(some), np.int64)
            for n in range(EDITS + 1):
                worst = np.maximum(worst, of_own[np.arange(len(some)), np.minimum(n, most[some])] + of_rest[:, EDITS - n])
            kept[some] -= worst
    return first, last - 1, kept


def build_index(items: list[tuple[str, list[str | None]]], common: list[np.ndarray] | None = None) -> Index:
    """Index of (instance, texts); rows that repeat an instance add to it. ``common`` as counted over all items."""
    texts = _canonical_texts(items)
    common = common or _common_here(texts)
    known: dict[str, int] = {}
    words, shared, own, spans, hashes = [t.split() for _, t in texts], [], [], [], []
    tiers = (Q, Q, SHORT_Q)  # q-grams that few items hold, then more of them, then shorter ones for the windows that these can't tell
    placed: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]]] = [[] for _ in tiers]
    for (_, text), ws in zip(texts, words):
        rare, often, *runs, phrases = common
        ids = _word_hashes(ws, known)
        mask = np.zeros(len(ws), bool)
        for (n, _), held in zip(SHARED_RUNS, runs):
            mask |= _covered(np.nonzero(_among(_run_hashes(ids, n), held))[0], n, len(ws))
        shared.append(mask)
        own.append(~_covered(np.nonzero(_among(_run_hashes(ids, PHRASE), phrases))[0], PHRASE, len(ws)))
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        ends = np.append(np.nonzero(raw == 32)[0], len(raw))
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans.append(_spans(mask, own[-1]))
        hashes.append(_words_of(raw, starts, ends))
        left = np.arange(len(spans[-1][0]))
        for tier, (q, hot) in enumerate(zip(tiers, (rare, often, None))):
            if not len(left):
                placed[tier].append((np.zeros(0, np.uint64), left, left, left, (left, left, left, left)))
                continue
            keys = _grams(raw, q)
            used = np.zeros(len(raw) + 1, bool)
            used[: len(keys)] = True if hot is None else ~_among(keys, hot)
            first, last, kept = _kept(q, used, starts, ends, own[-1], *(x[left] for x in spans[-1]))
            sure = kept >= (LEAST_GRAMS if q == Q else 1)
            wanted = np.zeros(len(raw) + 2, np.int64)
            np.add.at(wanted, first[sure], 1)
            np.add.at(wanted, last[sure] + 1, -1)
            at = np.nonzero(used[: len(keys)] & (np.cumsum(wanted)[: len(keys)] > 0))[0]
            fewest = np.full(len(raw) + 1, 1 << 30, np.int32)
            for f, n, k in zip(first[sure].tolist(), last[sure].tolist(), kept[sure].tolist()):
                np.minimum(fewest[f : n + 1], k, out=fewest[f : n + 1])
            placed[tier].append((keys[at], at, np.searchsorted(ends, at, side="left"), fewest[at], (first[sure], last[sure], kept[sure], left[sure])))
            left = left[~sure]
    grams = []
    for q, rows in zip(tiers, placed):
        keys = np.concatenate([*(k for k, *_ in rows), np.zeros(0, np.uint64)])
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        text = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k, *_ in rows])[order]
        at, word, least = (np.concatenate([r[i] for r in rows]).astype(np.int32)[order] for i in (1, 2, 3))
        offset = np.cumsum([0, *(len(w[0]) for *_, w in rows)])
        low, high = (np.concatenate([n + w[i].searchsorted(r[1], side=side) for n, (*r, w) in zip(offset, rows)]).astype(np.int32)[order] for i, side in ((1, "left"), (0, "right")))
        last, kept = (np.concatenate([w[i] for *_, w in rows]) for i in (1, 2))
        begin, end, most = (np.concatenate([s[i][w[3]] for s, (*_, w) in zip(spans, rows)]) for i in range(3))
        keys, times = np.unique(keys, return_counts=True)
        first = np.cumsum(times) - times
        if keys[-1] != _HIGHEST:
            keys, first, times = np.append(keys, _HIGHEST), np.append(first, 0), np.append(times, 0)
        bits = np.zeros(1 << BITS, bool)
        bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        grams.append(Grams(q, keys, first.astype(np.int32), times.astype(np.int32), bits, text, at, word, least, low, high, last, kept, begin, end, most))
    start = np.cumsum([0, *map(len, words)])
    return Index([n for n, _ in texts], words, shared, own, start, np.concatenate([*own, np.zeros(0, bool)]), np.concatenate([*hashes, np.zeros(0, np.uint64)]), grams)


def _held(doc: list[str], item: list[str], own: list[bool], free: list[bool], a: int, low: int) -> bool:
    """Whether a span of item words from ``a`` on, LEAST_WORDS to SPAN of them free, is in ``doc`` with at most EDITS edits.

    A replaced, missing or added word is an edit. No part at either end of a span has more edits than matches, so a
    shorter quotation does not grow by chance words beside it. Of the item's own words in the span no larger share,
    EDITS in LEAST_WORDS, may be edited, and there are LEAST_OWN or more. Word j of the item is tried against the BAND words of ``doc`` from j + ``low``.
    """
    # ways by edits, edits not yet outweighed since the best point, and matches less edits (more than EDITS are as good);
    # the fewest own words edited of each
    n = len(doc)
    cells: list[dict[tuple[int, int, int], int]] = [{(0, 0, 0): 0} if 0 <= a + low + d < n and doc[a + low + d] == item[a] else {} for d in range(BAND)]
    words = mine = 0
    for j in range(a, len(item)):
        word, o = item[j], int(own[j])
        words, mine = words + free[j], mine + o
        if words > SPAN:
            return False
        nxt: list[dict[tuple[int, int, int], int]] = [{} for _ in range(BAND)]
        alive = False
        for d in range(BAND):
            cell = cells[d]
            if not cell:
                continue
            i = j + low + d
            same = 0 <= i < n and doc[i] == word
            for (e, owed, score), lost in cell.items():
                if same:
                    key, alive = (e, max(0, owed - 1), min(EDITS, score + 1)), True
                    if nxt[d].get(key, 99) > lost:
                        nxt[d][key] = lost
                if e < EDITS and score:
                    key, alive = (e + 1, owed + 1, score - 1), True
                    if not same and i < n and nxt[d].get(key, 99) > lost + o:
                        nxt[d][key] = lost + o
                    if d and nxt[d - 1].get(key, 99) > lost + o:
                        nxt[d - 1][key] = lost + o
                    if d + 1 < BAND and i + 1 < n and cells[d + 1].get(key, 99) > lost:
                        cells[d + 1][key] = lost
        if not alive:
            return False
        if words >= LEAST_WORDS and free[j] and mine >= LEAST_OWN and any(not owed and lost * LEAST_WORDS <= EDITS * mine for cell in nxt for (_, owed, _), lost in cell.items()):
            return True
        cells = nxt
    return False


class _Texts:
    """Texts one after the other, each word by its number; NUL ends each."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.spaces = np.nonzero(raw == 32)[0]
        self.ends = np.searchsorted(self.spaces, np.nonzero(raw == 0)[0])  # the word that ends each
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _words_of(self.raw, np.concatenate([[0], self.spaces + 1]), np.append(self.spaces, len(self.raw)))
        return self._hashes

    def bounds(self, n: int) -> tuple[int, int]:
        return int(self.ends[n - 1]) + 1 if n else 0, int(self.ends[n]) if n < len(self.ends) else len(self.spaces) + 1

    def words(self, a: int, z: int) -> list[str]:
        if z <= a:
            return []
        start = int(self.spaces[a - 1]) + 1 if a else 0
        return self.raw[start : int(self.spaces[z - 1]) if z - 1 < len(self.spaces) else len(self.raw)].tobytes().decode("utf-8", "replace").split(" ")


class Searcher:
    def __init__(self, index: Index):
        self.ix = index
        self.base = max(map(len, index.words), default=0) // BAND * BAND + BAND  # keeps diagonals positive
        self.lists: dict[int, tuple[list[bool], list[bool]]] = {}  # own and free words of the items looked at
        # half bands of a text are counted from a place of its own on
        place = (np.arange(len(index.items), dtype=np.int64) * 0x9E3779B1 >> 7) % BUCKETS * HALF + self.base
        self.places = [(place[g.text] - g.word).astype(np.int32) for g in index.grams]

    def search(self, texts: list[str | None]) -> list[tuple[int, str]]:
        """(position in ``texts``, item) of every leak."""
        # each text by itself, as most have no wide characters
        whole = _spaced("\n\x00\n".join(_narrowed(t.replace("\x00", " ") if "\x00" in t else t) if t else "" for t in texts))
        doc = _Texts(np.frombuffer(whole, np.uint8))
        found: dict[int, set[str]] = defaultdict(set)
        word_at = np.append(np.int32(0), np.cumsum(doc.raw == 32, dtype=np.int32))  # a space belongs to the word before
        for q in {g.q for g in self.ix.grams}:
            tiers = [n for n, g in enumerate(self.ix.grams) if g.q == q]
            for n, (at, key) in zip(tiers, _hits(doc.raw, [self.ix.grams[n] for n in tiers])):
                word, post = self._near(self.ix.grams[n], self.places[n], word_at[at], key)
                for shift in (0, HALF):
                    self._bands(doc, self.ix.grams[n], word, post, shift, found)
        return [(d, name) for d, names in found.items() for name in sorted(names)]

    def _near(self, grams: Grams, places: np.ndarray, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and posting of the q-grams ``key`` at ``word`` that may have enough others in their band."""
        reps = grams.times[key]
        word = np.repeat(word, reps)
        post = np.repeat(grams.first[key] - np.cumsum(reps) + reps, reps) + np.arange(len(word))
        # a band is two half bands side by side; texts may meet in a place, so counts never fall short
        half = (word + places[post]) // np.int32(HALF)
        count = np.bincount(half, minlength=1)
        beside = np.append(0, count[:-1])
        np.maximum(beside[:-1], count[1:], out=beside[:-1])
        keep = np.nonzero((count + beside)[half] >= grams.least[post])[0]
        return word[keep], post[keep]

    def _bands(self, doc: _Texts, grams: Grams, word: np.ndarray, post: np.ndarray, shift: int, found: dict[int, set[str]]) -> None:
        """Count the q-grams that a document and an item share in each band, and look at those that may hold a window."""
        bands = (len(doc.spaces) + self.base) // BAND + 2
        k = grams.text[post].astype(np.int64) * bands + (word - grams.word[post] + (self.base + shift)) // BAND
        d, at = np.searchsorted(doc.ends, word), grams.at[post]
        order = np.lexsort((at, d, k))
        k, d, at, post = k[order], d[order], at[order], post[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        once = new.copy()
        once[1:] |= at[1:] != at[:-1]  # a q-gram of the item counts once
        k, d, at, post, new = k[once], d[once], at[once], post[once], new[once]
        if not len(k):
            return
        row = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        stop = np.append(first[1:], len(k))[row]
        # windows whose first q-gram in the band is this one, and that share as many as they are sure to keep
        low, high = grams.low[post], grams.high[post]
        low[1:] = np.where(new[1:], low[1:], np.maximum(low[1:], high[:-1]))
        reach = np.arange(len(k)) + grams.least[post] - 1
        able = np.nonzero((reach < stop) & (low < high) & (at.take(reach, mode="clip") <= grams.last[high - 1]))[0]
        reps = (high - low)[able]
        window = np.repeat(low[able] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        by = np.repeat(able, reps)
        reach = by + grams.kept[window] - 1
        shares = (reach < stop[by]) & (at.take(reach, mode="clip") <= grams.last[window])
        window, row = window[shares], row[by[shares]]
        # by band, from here on: text, document, lowest diagonal
        row, part = np.unique(row, return_inverse=True)
        text, n, low = k[first[row]] // bands, d[first[row]], k[first[row]] % bands * BAND - self.base - shift
        left = self._matched(doc, grams, text, low, window, part)
        window, part = window[left], part[left]
        for r, starts in zip(*_grouped(part, grams.begin[window])):
            t, d = int(text[r]), int(n[r])
            if self.ix.items[t] not in found[d] and self._verify(doc, t, d, int(low[r]), starts):
                found[d].add(self.ix.items[t])

    def _matched(self, doc: _Texts, grams: Grams, text: np.ndarray, low: np.ndarray, window: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Places of the windows that are left, as item words that the band has nowhere are edits for certain.

        ``part`` is the band of each window, ascending; ``text`` and ``low`` are those of each band.
        """
        if not len(window):
            return window
        a, z = grams.begin[window], grams.end[window]
        new = np.append(True, part[1:] != part[:-1])
        begin, sizes = a[new], z[np.append(new[1:], True)] - a[new]
        offset = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum())
        mine = at + np.repeat(self.ix.start[text] + begin - offset, sizes)
        theirs = at + np.repeat(low + begin - offset, sizes)
        hashes, own = self.ix.hashes[mine], self.ix.all_own[mine]
        missed = np.ones(len(mine), bool)
        for n in range(BAND):
            missed &= doc.hashes.take(theirs + n, mode="clip") != hashes
        edits, lost = np.append(0, np.cumsum(missed)), np.append(0, np.cumsum(missed & own))
        s, e = a + (offset - begin)[part], z + (offset - begin)[part]
        return np.nonzero((edits[e] - edits[s] <= EDITS) & (lost[e] - lost[s] <= grams.most[window]) & ~missed[s])[0]

    def _verify(self, doc: _Texts, text: int, n: int, low: int, starts: np.ndarray) -> bool:
        """Whether document ``n`` holds a leak from one of the item's words ``starts`` on in the band from diagonal ``low`` on."""
        item = self.ix.words[text]
        if text not in self.lists:
            self.lists[text] = self.ix.own[text].tolist(), (~self.ix.shared[text]).tolist()
        own, free = self.lists[text]
        first, last = doc.bounds(n)
        for j in starts.tolist():
            a = max(first, j + low)
            words = doc.words(a, min(last, a + BAND))
            if item[j] not in words:
                continue
            stop, left = j, SPAN
            while stop < len(item) and left:
                left -= free[stop]
                stop += 1
            if _held(doc.words(a, min(last, stop + low + BAND)), item, own, free, j, low - a):
                return True
        return False


def _grouped(part: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct numbers of the ascending ``part``, and the values of each."""
    parts, first = np.unique(part, return_index=True)
    return parts, np.split(values, first[1:])


def _hits(raw: np.ndarray, every: list[Grams]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places whose q-gram is in each index (of one q), and its place among the index's hashes."""
    q, spots = every[0].q, [[] for _ in every]
    for lo in range(0, max(1, len(raw) - q + 1), 1 << 18):  # in blocks, so that a long text takes bounded memory
        h = _grams(raw[lo : lo + (1 << 18) + q - 1], q)
        upper = (h >> np.uint64(64 - BITS)).astype(np.int64)
        for grams, out in zip(every, spots):
            maybe = np.nonzero(grams.bits[upper])[0]
            some, key = h[maybe], grams.slots[upper[maybe]]
            lower = np.nonzero(grams.keys[key] < some)[0]
            while len(lower):  # few hashes have the same upper bits
                key[lower] += 1
                lower = lower[grams.keys[key[lower]] < some[lower]]
            hit = grams.keys[key] == some
            out.append((maybe[hit] + lo, key[hit]))
    for out in spots:
        yield tuple(np.concatenate(x) for x in zip(*out))


def leaked(documents: DataFrame, instances: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, instance_id of documents that hold at least 25 words in a row of one item's text, a few edits allowed.

    All items against all documents: the items' q-grams are indexed and broadcast, and every document is searched
    whole in one narrow pass. For each window of 25 words of an item the q-gram lemma says how many of its q-grams
    any 4 edits must leave, from the window's own words and q-grams. q-grams that 4 or more items hold are left out;
    windows that are not sure to keep 10 of the others (short words, common phrasing) are indexed by all their
    q-grams of 8 bytes, of which 25 words keep at least 6. Shared q-grams are counted in overlapping bands of word
    diagonals, wide enough for 4 edits, so no leak falls below its window's bound; what is left is verified by a
    banded alignment of words: a leak is a span of 25 to 33 item words with at most 4 edits (longer ones hold such a
    span). Words in passages that several items hold are shared text and count nothing. Near misses repeat the
    phrasing of an item and differ in what it says: words outside of runs of 3 words that 4 or more items hold are
    an item's own, and of these too at most 4 in 25 may be edited. In scripts without spaces each character is a
    word.

    Items of more than ``index_bytes`` of text are indexed in parts of about as much, each in a pass of its own over
    the documents; what counts as shared is counted over all of them by hash.

    Defined results: null and empty texts have no leaks; items without text are ignored; rows that repeat a
    document or an item give one row; empty tables give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    size = instances.selectExpr("sum(coalesce(length(problem_statement), 0) + coalesce(length(patch), 0)) as n").first()[0] or 0
    parts = max(1, -(-size // index_bytes))
    rows = _parted(instances, parts)
    common = _common_everywhere(instances, parts).persist() if parts > 1 else None
    docs = spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    found = None
    for part in range(parts):
        held = rows.filter(F.col("part") == part).collect()  # bounded by index_bytes, or one item
        counted = None
        if common is not None:
            known = common.filter(F.col("part") == part).collect()  # hashes of these items' texts
            counted = [np.sort(np.array([r["hash"] for r in known if r["k"] == k], np.int64).view(np.uint64)) for k in range(len(_COMMON))]
        index = spark.sparkContext.broadcast(build_index(sorted((r[0], [r[2], r[3]]) for r in held), counted))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(index.value)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                lo = 0
                while lo < len(ids):
                    hi, held = lo, 0
                    while hi < len(ids) and (hi == lo or held < 1_000_000):  # characters searched at once
                        held += len(texts[hi] or "")
                        hi += 1
                    out = searcher.search(texts[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array([ids[lo + d] for d, _ in out], pa.int64()), pa.array([n for _, n in out], pa.string())], ["doc_id", "instance_id"])
                    lo = hi

        got = docs.mapInArrow(run, "doc_id long, instance_id string")
        found = got if found is None else found.unionByName(got)
    return found.distinct()
