"""SentencePiece (BPE with byte fallback) encoding and decoding by a merge-type prefix table.

The last token of the encoding of a prefix is unique: of the pieces that end at
a position (found by an automaton) it is the one whose pairing with the last
token of the prefix before it is *compatible*, that is, no merge would join
across their boundary first. The table holds one id per prefix; the ids are
read off backwards. Work is linear in the text and needs no merge queue.

Defined results: a null text is an empty one; an empty text has no pieces, only
the begin and end ids when they are asked for; other columns are kept by
`encode_documents`, which replaces input columns of the names it adds.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltwise.llm.common import give_back

SPACE = "▁"
#: Marks keys of remembered units: a line end and what follows it; a unit without a space mark.
LINE, BARE = "\x01", "\x02"
#: Units of text (words with their space) whose ids a task remembers, and pairs of tokens that it has tested.
REMEMBERED_UNITS = 300_000
REMEMBERED_PAIRS = 400_000
#: Characters of text whose ids and decoded texts a task holds at once.
CHARS_AT_ONCE = 2_000_000
#: A rank after all merges.
LAST = 1 << 60
OUT = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)


class _Units(dict):
    """Unit -> ids as little-endian uint32 bytes; forgets all when full."""

    def __init__(self, table: "PrefixTable"):
        self.table = table

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED_UNITS:
            self.clear()
        if unit[:1] == LINE:  # a word after a line end
            ids = self.table.encode_unit("\n") + self.table.encode_unit(unit[2:])
        elif unit[:1] == BARE:
            ids = self.table.encode_unit(unit[1:])
        else:
            ids = self.table.encode_unit(SPACE + unit if unit[:1] not in (SPACE, "\n") else unit)
        out = self[unit] = array("I", ids).tobytes()
        return out


class PrefixTable:
    """The tables that encoding needs, made from a model's serialized bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.surface = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.surface[self.unk] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.id_of = {pieces[i]: i for i in plain}
        # Space runs share one score below all others: they merge last, leftmost first.
        self.space_runs = {len(pieces[i]): i for i in plain if len(pieces[i]) > 1 and set(pieces[i]) == {SPACE}}
        runs = set(self.space_runs.values())
        singles = [i for i in plain if len(pieces[i]) == 1]
        longer = sorted((i for i in plain if len(pieces[i]) > 1 and i not in runs), key=lambda i: -scores[i])
        if runs and longer and max(scores[i] for i in runs) >= scores[longer[-1]]:
            raise ValueError("a piece of spaces only must score below the other merges")
        if len({scores[i] for i in longer}) != len(longer):
            raise ValueError("merges must have distinct scores")
        if any(SPACE in pieces[i][1:] for i in longer):
            raise ValueError("a space mark inside a piece is not supported")
        # Rank: single characters first, then by score. Tables below are by rank.
        order = singles + longer
        self.id_by_rank = order
        self.length = [len(pieces[i]) for i in order]
        rank_of = {pieces[i]: r for r, i in enumerate(order)}
        self.merged: dict[tuple[int, int], int] = {}
        # By token: (token, rank at which it is merged away) from the whole token down to its last, or first, character.
        self.right_edge: list[list[tuple[int, int]]] = [[(r, LAST)] for r in range(len(order))]
        self.left_edge: list[list[tuple[int, int]]] = [[(r, LAST)] for r in range(len(order))]
        self.pairs: dict[int, bool] = {}
        reached = set(range(len(singles)))
        for r in range(len(singles), len(order)):
            p = pieces[order[r]]
            for k in range(1, len(p)):
                a, b = rank_of.get(p[:k]), rank_of.get(p[k:])
                if a is not None and b is not None and a < r and b < r and a in reached and b in reached and self._stable(a, b):
                    self.merged[a, b] = r
                    self.left_edge[r] += [(a, r), *self.left_edge[a][1:]]
                    self.right_edge[r] += [(b, r), *self.right_edge[b][1:]]
                    reached.add(r)
                    break
        self.pairs.clear()
        self.automaton = ahocorasick.Automaton()
        for r in reached:
            self.automaton.add_word(pieces[order[r]], (r, self.length[r]))
        self.automaton.make_automaton()
        self.unit = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if not any("\n" in pieces[i] for i in plain) else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.split_lines = not any("\n" in pieces[i] for i in plain)
        self.units = _Units(self)
        self.runs: dict[int, list[int]] = {}

    def _stable(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side in an encoding.

        Merges happen in the order of their ranks. On its way to a, the text left of the boundary ends in the tokens of a's
        right edge, each there until the next larger one is merged; likewise b's left edge. If some token of the one edge
        merges with some token of the other before either is gone, a and b would not have come about. Of equal merges the
        left one goes first, so at a tie the left token is gone and the right one is not.
        """
        merged = self.merged
        for x, x_gone in self.right_edge[a]:
            for y, y_gone in self.left_edge[b]:
                rank = merged.get((x, y))
                if rank is not None and rank < x_gone and rank <= y_gone:
                    return False
        return True

    def _learn(self, key: int) -> bool:
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self._stable(key >> 20, key & 0xFFFFF)
        return got

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a run of text with space marks at its start only."""
        n = len(unit)
        last = [-1] * n  # by the last character
        length, by_rank, get, learn = self.length, self.id_by_rank, self.pairs.get, self._learn
        for end, (r, size) in self.automaton.iter(unit):
            if last[end] < 0:
                start = end - size
                if start < 0 or (before := last[start]) < 0:  # a boundary: the start, or a character without a piece, over which nothing merges
                    last[end] = r
                else:
                    ok = get(key := before << 20 | r)
                    if learn(key) if ok is None else ok:
                        last[end] = r
        out: list[int] = []
        i = n - 1
        while i >= 0:
            r = last[i]
            if r >= 0:
                out.append(by_rank[r])
                i -= length[r]
            else:
                raw = unit[i].encode()
                i -= 1
                out.extend(self.byte_ids[b] for b in reversed(raw)) if self.byte_ids[0] != self.unk else out.append(self.unk)
        out.reverse()
        if unit[:2] == SPACE * 2:
            single = self.id_of.get(SPACE)
            k = next((j for j, x in enumerate(out) if x != single), len(out))
            out[:k] = self._spaces(k)
        return out

    def _spaces(self, k: int) -> list[int]:
        """Ids of k space marks: all their merges score alike, so the leftmost goes first."""
        if k not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            size, nxt, prev = [1] * k, list(range(1, k + 1)), list(range(-1, k - 1))
            heap = list(range(k - 1)) if 2 in self.space_runs else []
            while heap:
                i = heapq.heappop(heap)
                j = nxt[i] if size[i] else k
                if j >= k or size[i] + size[j] not in self.space_runs:
                    continue
                size[i], size[j], nxt[i] = size[i] + size[j], 0, nxt[j]
                if nxt[i] < k:
                    prev[nxt[i]] = i
                    heapq.heappush(heap, i)
                if prev[i] >= 0:
                    heapq.heappush(heap, prev[i])
            self.runs[k] = [self.space_runs[s] if s > 1 else self.id_of[SPACE] for s in size if s]
        return self.runs[k]

    def forget(self) -> None:
        """At a task's end: a Python worker goes on to other tasks, of other operators too."""
        self.units.clear()
        self.pairs.clear()
        self.runs.clear()
        give_back()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end, as little-endian uint32."""
        if not text:
            return b""
        if self.split_lines and "  " not in text and text[0] != " " and SPACE not in text and LINE not in text and BARE not in text:
            units = text.replace("\n", f" {LINE}\n").split(" ")
            if text[0] == "\n":
                units[0] = SPACE
        else:
            units = self.unit.findall(SPACE + text.replace(" ", SPACE))
            # A unit that opens without a space mark follows a line end: its key says so.
            units = [u if u[0] in (SPACE, "\n") else BARE + u for u in units]
        return b"".join(map(self.units.__getitem__, units))

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, bytes put together, the first space mark dropped."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_tables: dict[bytes, PrefixTable] = {}


def table_of(model: bytes) -> PrefixTable:
    """The table of a model, made once in a Python worker."""
    if model not in _tables:
        _tables.clear()
        _tables[model] = PrefixTable(model)
    return _tables[model]


def portions(texts: pd.Series, chars: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists that end as soon as they have so many characters."""
    part, size = [], 0
    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", bos: bool = True, eos: bool = True, decode: bool = True) -> DataFrame:
    """docs plus ids (little-endian uint32 bytes), n_tokens and decoded (null unless decode).

    One narrow pass: no shuffle. The model file (under 1 MB) is read on the driver and sent with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def coded(batches):
        t = table_of(model)
        head, tail = (np.asarray([i], dtype="<u4").tobytes() if on else b"" for i, on in ((t.bos, bos), (t.eos, eos)))
        for texts in batches:
            # A batch of long texts would be held six times over, so its rows leave in portions.
            for part in portions(texts):
                ids = [head + t.encode(x) + tail for x in part]
                yield pd.DataFrame({"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [t.decode(x) if decode else None for x in ids]})
        t.forget()

    coded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    encode = F.pandas_udf(coded, OUT)
    kept = [c for c in docs.columns if c not in OUT.fieldNames()]
    return docs.select(*kept, encode(F.col(text_col)).alias("_e")).select(*kept, "_e.*")


def op1_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """The digests of op1 from the encoding."""
    e = encode_documents(docs.select("doc_id", "text"), model_path)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
