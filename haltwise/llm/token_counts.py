"""Token counts of sections: whole documents are encoded once and tokens allocated by their character spans.

Encoding sections one by one would cut tokens at their borders and count others
than the model sees. Here a document is encoded whole, every token gets the span
of the characters it has bytes of, and the spans are joined with the sections'
intervals (both in order, by binary search). The rule: a token belongs to the
section that it shares most characters with, of equals to the earlier; a token
that meets no section belongs to none (section null). So the counts of a
document's rows add up to its tokens.

Defined results: a null or empty text, or one without sections, gives one row
with section null; sections must be in order and apart, empty ones get no token;
repeated rows are counted each. One narrow pass, no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = "array<struct<name:string,start:int,stop:int>>"


class Encoder:
    """A byte-level BPE with the byte length of each token."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, i in table.items():
            self.sizes[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of each token's characters; tokens that share a character's bytes both have it."""
        ids = np.asarray(self.encode(text), dtype=np.int64)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        raw = text.encode()
        if len(raw) == len(text):
            return starts, ends
        char = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


_encoders: dict[tuple[bytes, str], Encoder] = {}


def encoder_of(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary, made once in a Python worker."""
    if (ranks, pattern) not in _encoders:
        _encoders.clear()
        _encoders[ranks, pattern] = Encoder(ranks, pattern)
    return _encoders[ranks, pattern]


def allocate(starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """The section of each token, -1 for none."""
    if not len(opens) or not len(starts):
        return np.full(len(starts), -1, dtype=np.int64)
    first = np.searchsorted(closes, starts, side="right")  # first section that ends after the token's start
    last = np.searchsorted(opens, ends, side="left") - 1  # last that starts before its end
    out = np.where(last < first, -1, first)
    for t in np.flatnonzero(last > first):
        k = np.arange(first[t], last[t] + 1)
        shared = np.minimum(ends[t], closes[k]) - np.maximum(starts[t], opens[k])
        out[t] = k[shared.argmax()]
    alone = out >= 0
    hit = out[alone]
    alone[alone] = np.minimum(ends[alone], closes[hit]) > np.maximum(starts[alone], opens[hit])
    return np.where(alone, out, -1)


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """Sections by line, each with its line end, named by number from 0."""
    parts = text.split("\n")
    pieces = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    out, at = [], 0
    for i, piece in enumerate(pieces):
        out.append((str(i), at, at + len(piece)))
        at += len(piece)
    return out


def count_sections(docs: DataFrame, ranks_path: str, pattern: str, sections: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (its place), name, start, stop, n_tokens and doc_tokens, one row per section of each document.

    sections: a column of (name, start, stop) in code points; lines where it is None.
    The ranks (under 1 MB) are read on the driver and sent with the tasks.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                given = part.column(2).to_pylist() if sections else None
                rows: list[tuple] = []
                for i, (d, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1))):
                    text = t.as_py() or ""
                    own = [(s["name"], s["start"], s["stop"]) for s in given[i] or []] if given is not None else line_sections(text)
                    starts, ends = encoder.spans(text) if text else (np.empty(0, np.int64),) * 2
                    where = allocate(starts, ends, np.array([s[1] for s in own], np.int64), np.array([s[2] for s in own], np.int64))
                    n = np.bincount(where + 1, minlength=len(own) + 1).tolist()
                    if n[0] or not own:
                        rows.append((d, None, None, None, None, n[0], len(starts)))
                    rows += [(d, k, s[0], s[1], s[2], n[k + 1], len(starts)) for k, s in enumerate(own)]
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "section", "name", "start", "stop", "n_tokens", "doc_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), *([F.col(sections).cast(SECTIONS).alias("s")] if sections else []))
    return picked.mapInArrow(run, "doc_id long, section int, name string, start int, stop int, n_tokens long, doc_tokens long")


def op6_token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return count_sections(docs, ranks_path, pattern)
