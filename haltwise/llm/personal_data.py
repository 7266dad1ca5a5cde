"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what reveals them.

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found
by fixed patterns. Other words can reveal them too. A term in the documents of
an identifier e discloses it by the pointwise mutual information

    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))   of   IC(e) = log2(N / n(e))

where n counts documents over the whole corpus; IC - PMI = log2(n(t) / n(t, e))
is the information still missing to name the identifier from the term. Terms
with at most `generalise_bits` missing are generalised to their shape, those
with at most `remove_bits` are removed, wherever they stand, with or without the
identifier, provided the pair was seen in `min_contexts` different contexts (a
context is the words around the identifier and around the term, so copies of a
passage are one).

Plan: one pass finds identifiers. Only entities of `min_contexts` documents can
be in such a pair: a second pass gives their documents' terms, summed with
partial aggregation. Corpus counts n(t) are needed for candidate terms only: a
third pass sums them per batch before the shuffle. A fourth finds all places of
told terms. A bitmap of hashes (128 KB whatever the corpus) goes with each of
these passes and an exact join follows. Nothing else is broadcast and the texts
are not shuffled.

Defined results: null or empty text has no spans; offsets are code points, end
exclusive; repeated rows count each and get the same spans, repeated ids with
other texts their own; other columns are kept by `sanitise`.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import give_back, stash, tidied

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NO_DIGIT = re.compile("[^0-9]+")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}\"'|#*$%&<>"
AROUND = 5
FIELDS = "key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>"
PAIRS = "key long, entity string, term string, context long"
PLACES = "key long, term string, start int, stop int"
#: Bits of a map of entities or terms.
MAP_BITS = 1 << 20
#: Rows of a batch that a pass gives out.
ROWS_AT_ONCE = 50_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, found from each @ so that long runs cost their length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # The next @ may take no word of this one: the local part stops at an @ anyway.
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Direct identifiers by kind in the order of KINDS, then by start; failing matches are dropped without a retry."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = NO_DIGIT.sub("", m.group())
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15]
    return out


def term_of(word: str) -> str | None:
    """A word as a term: lower case, without punctuation at its edges; None for what is too short or has no letter."""
    t = word.strip(EDGE).lower()
    return t if len(t) >= 3 and any(map(str.isalpha, t)) else None


def _entity(kind: str, surface: str) -> str:
    return f"{kind}:{surface.lower()}" if kind in ("email", "ip") else f"{kind}:{NO_DIGIT.sub('', surface)}"


def _words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word that is a term and touches no identifier, edges left out."""
    covered: list[list[int]] = []
    for x, y in sorted((a, b) for _, a, b in spans):
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    out, i = [], 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if (i < len(covered) and covered[i][0] < e) or not (t := term_of(m.group())):
            continue
        raw = m.group()
        s += len(raw) - len(raw.lstrip(EDGE))
        out.append((t, s, s + len(raw.strip(EDGE))))
    return out


def _hash(terms: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(terms).encode())


def cooccurrences(text: str, spans: list[tuple[str, int, int]], wanted: Callable[[str], bool]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """(entity, the document's terms, context hashes) for each wanted entity; a context is the words around its first mention and around the term's."""
    first: dict[str, int] = {}
    for kind, a, b in spans:
        e = _entity(kind, text[a:b])
        if e not in first or a < first[e]:
            first[e] = a
    first = {e: a for e, a in first.items() if wanted(e)}
    if not first:
        return
    words = _words(text, spans)
    line, starts = [t for t, _, _ in words], [s for _, s, _ in words]
    around: dict[str, int] = {}
    for i, t in enumerate(line):
        if t not in around:
            around[t] = _hash(line[max(0, i - AROUND) : i + AROUND + 1])
    terms, near = list(around), np.array(list(around.values()), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for e, a in first.items():
        i = bisect.bisect_left(starts, a)
        yield e, terms, ((near ^ np.uint64(_hash(line[max(0, i - AROUND) : i + AROUND]))) >> np.uint64(1)).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        base, entities = [], []
        for t in b.column(2):
            text = t.as_py() or ""
            spans = base_spans(text)
            by = Counter(k for k, _, _ in spans)
            for i, k in enumerate(KINDS):
                counts[i].append(by[k])
            base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
            entities.append(sorted({_entity(k, text[s:e]) for k, s, e in spans}))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string()))],
            names=["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"],
        )


def _place(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % MAP_BITS


def _in_map(bits: np.ndarray, term: str) -> bool:
    p = _place(term)
    return bool(bits[p >> 3] >> (p & 7) & 1)


class _Terms(dict):
    """Word (UTF-8; bytes.split splits as WORD does) -> its term if that may be in the map, else None; forgets all when full."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, word: bytes) -> str | None:
        if len(self) >= 250_000:
            self.clear()
        t = term_of(word.decode())
        if t is not None and not _in_map(self.bits, t):
            t = None
        self[word] = t
        return t


def _count_terms(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(bits)
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0):
                total.update(set(map(terms.__getitem__, (t.as_py() or "").encode().split())))
            total.pop(None, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return run


def _pairs(bits: np.ndarray):
    """Every term of a document with every entity of it that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, entities, terms, contexts = [], [], [], []

            def rows() -> pa.RecordBatch:
                cols = [pa.array(keys, pa.int64()), pa.array(entities, pa.string()), pa.array(terms, pa.string()), pa.array(contexts, pa.int64())]
                return pa.RecordBatch.from_arrays(cols, names=["key", "entity", "term", "context"])

            for key, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                spans = base_spans(text)
                for entity, found, near in cooccurrences(text, spans, lambda e: _in_map(bits, e)) if spans else ():
                    keys += [key.as_py()] * len(found)
                    entities += [entity] * len(found)
                    terms += found
                    contexts += near.tolist()
                    if len(keys) >= ROWS_AT_ONCE:
                        yield rows()
                        keys, entities, terms, contexts = [], [], [], []
            yield rows()

    return run


def _occurrences(bits: np.ndarray):
    """Every place, in any text, of the terms that may be told; words that touch identifiers left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(bits)
        for b in batches:
            keys, found, starts, stops = [], [], [], []

            def rows() -> pa.RecordBatch:
                cols = [pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
                return pa.RecordBatch.from_arrays(cols, names=["key", "term", "start", "stop"])

            for key, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                held = set(map(terms.__getitem__, text.encode().split()))
                held.discard(None)
                if not held:
                    continue
                for term, s, e in _words(text, base_spans(text)):
                    if term in held:
                        keys.append(key.as_py())
                        found.append(term)
                        starts.append(s)
                        stops.append(e)
                if len(keys) >= ROWS_AT_ONCE:
                    yield rows()
                    keys, found, starts, stops = [], [], [], []
            yield rows()

    return run


def _map_of(df: DataFrame, col: str) -> np.ndarray | None:
    """Bits set at the hashes of a column's values: at most 32 pieces of 4 KB reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_place(t) for t in b.column(0).to_pylist()], pa.int64())], names=["p"])

    rows = df.select(col).distinct().mapInArrow(places, "p long").groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m")).collect()
    if not rows:
        return None
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        start = (r["b"] - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = 3, generalise_bits: float = 1.0, remove_bits: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(scanned, terms): the base findings of each row, and (key, start, stop, action) of revealing terms."""
    src = _source(docs, id_col, text_col)
    scanned = stash(src.mapInArrow(tidied(_scan), FIELDS), "pii")
    none = src.select("key", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("remove").alias("action")).limit(0)
    # No pair has more contexts than its entity has documents.
    mentioned = scanned.select("key", F.explode("entities").alias("entity")).distinct()
    frequent = stash(mentioned.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= min_contexts).select("entity"), "entities")
    bits = _map_of(frequent, "entity")
    if bits is None:
        return scanned, none
    together = src.select("key", "t").mapInArrow(tidied(_pairs(bits)), PAIRS).join(frequent, "entity", "left_semi")
    # Each row gives a pair once, so n(t, e) and n(t) both count rows; contexts count however often a row is repeated once.
    by_context = together.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = stash(by_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_te")).where(F.col("contexts") >= min_contexts), "pairs")
    bits = _map_of(pairs, "term")
    if bits is None:
        return scanned, none
    counts = src.select("t").mapInArrow(tidied(_count_terms(bits)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    missing = F.log2(F.greatest(F.col("n_t"), F.col("n_te")) / F.col("n_te"))  # greatest skips null
    told = pairs.join(counts, "term", "left").withColumn("missing", missing).where(F.col("missing") <= generalise_bits)
    told = stash(told.groupBy("term").agg(F.max(F.when(F.col("missing") <= remove_bits, "remove").otherwise("generalise")).alias("action")), "told")
    bits = _map_of(told, "term")
    if bits is None:
        return scanned, none
    places = src.select("key", "t").mapInArrow(tidied(_occurrences(bits)), PLACES)
    return scanned, places.join(told, "term").groupBy("key", "start", "stop").agg(F.max("action").alias("action"))


def _rewrite(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """text with identifiers named by kind, revealing terms generalised to their shape or removed; the first of overlapping spans wins."""
    marks = [(s, e, f"[{k.upper()}]") for k, s, e in base]
    for s, e, action in terms:
        word = text[s:e]
        marks.append((s, e, "" if action == "remove" else "[NAME]" if word[:1].isupper() else "[TERM]"))
    out, at = [], 0
    for s, e, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with the text sanitised (null stays null); columns as they were."""
    _, terms = find(docs, id_col, text_col, **params)
    by_doc = terms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "action"))).alias("_terms"))
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            out = []
            for t, x in zip(texts, found):
                spans = base_spans(t) if t else []
                known = [] if x is None else [(r["start"], r["stop"], r["action"]) for r in x]
                out.append(_rewrite(t, spans, known) if spans or known else t)
            yield pd.Series(out, dtype=object)
            del texts, found, out
        give_back()

    marked = docs.withColumn("_key", key).join(by_doc.withColumnRenamed("key", "_key"), "_key", "left")
    return marked.withColumn("_clean", clean(F.col(text_col), F.col("_terms"))).select(*[F.col("_clean").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8_personal_data(docs: DataFrame) -> DataFrame:
    scanned, terms = find(docs)
    by_doc = terms.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "stop"))), lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["stop"])), ",").alias("added"), F.count("*").alias("n_term"))
    out = scanned.join(by_doc, "key", "left")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "added").alias("spans"),
    )
