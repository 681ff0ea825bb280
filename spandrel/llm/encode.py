"""Encoding of the whole corpus with a public byte-level BPE, cut at forced boundaries."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_WS = re.compile(r"[\s\x85]")  # as Python sees it, which is more than the pattern does
CACHE = 400_000  # fragments a worker remembers before it starts afresh


def token_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: whether a pair of bytes occurs inside any token."""
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


class Encoder:
    """Encodes texts by cutting them at forced boundaries, each distinct fragment once.

    No merge can cross two neighbouring bytes that occur side by side in no token, so such a pair between two
    characters is a certain cut of the merges, wherever it lies: within a word or a run of signs, too, the parts give
    the same ids as the whole. What the pre-split sees must stay the same as well. It looks ahead only from white
    space, so nothing is cut behind white space; and a run that begins with an apostrophe may be read as a
    contraction, so nothing is cut before one unless a letter or digit is before it, where the pre-split cuts itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.base = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        cuts = ~token_pairs(ranks)
        cuts[:, 0x80:0xC0] = False  # inside of a character
        cuts[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
        plain = np.zeros(256, bool)
        plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        cuts[~plain, 0x27] = False
        self.cuts = cuts.ravel()
        self.known: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            raw = np.frombuffer(text.encode(), np.uint8)
            at = np.nonzero(self.cuts[raw[:-1].astype(np.uint16) << 8 | raw[1:]])[0] + 1
            edges = [0, *at.tolist(), len(text)]
            return [text[a:z] for a, z in zip(edges, edges[1:])]
        whole = text.encode()
        raw = np.frombuffer(whole, np.uint8)
        forced = self.cuts[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        if wide := [m.start() for m in _WIDE_WS.finditer(text) if text[m.start()] > "\x7f"]:  # the byte behind each
            behind = np.nonzero(np.append((raw[1:] & 0xC0) != 0x80, True))[0] + 1
            forced[behind[wide][behind[wide] < len(raw)] - 1] = False
        edges = [0, *(np.nonzero(forced)[0] + 1).tolist(), len(raw)]
        return [whole[a:z].decode() for a, z in zip(edges, edges[1:])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known
        parts = self.cut(text)
        try:
            return list(chain.from_iterable(map(known.__getitem__, parts)))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for part in set(parts).difference(known):
                known[part] = self.base.encode_ordinary(part)
            return list(chain.from_iterable(map(known.__getitem__, parts)))


_made: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a ``.tiktoken`` file, made once a worker process."""
    if vocabulary not in _made:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[vocabulary] = Encoder(ranks)
    return _made[vocabulary]


def encode_corpus(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids (array of int) of every row, by the byte-level vocabulary file that every executor can read.

    Narrow: one pass, no shuffle; a batch holds a few rows, so that very long texts fit a worker.

    Defined results: null and empty texts give the empty list; blank texts are encoded as they are; repeated rows
    give one row each; strings that look like special tokens are ordinary text; an empty table gives no rows;
    other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            offsets, ids = [0], []
            for text in batch.column(1).to_pylist():
                ids.append(np.array(enc.encode(text), np.int32))
                offsets.append(offsets[-1] + len(ids[-1]))
                if offsets[-1] > 2**30:
                    raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch for texts this long")
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id"), F.col("text"))).mapInArrow(run, "doc_id long, ids array<int>")
