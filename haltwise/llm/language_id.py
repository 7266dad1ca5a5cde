"""Language of words and documents by a linear-chain conditional random field.

Words are labelled: each has features (itself as a lexicon entry, its prefixes
and suffixes, its character 2- and 3-grams), hashed to weights for each
language, and neighbouring labels have learned transition weights, so a word
that could be of several languages follows its neighbours and a text may switch.
A word of more than 40 characters is labelled piece by piece, so all of it counts.
Forward-backward gives each word's label probabilities; a document's language is
the one with the largest mean probability over its words with a letter, which is
the score too. Letters are characters of the letter categories.

The field is fitted on a bounded sample: about `per_language` whole texts of
each label (at most `sample_chars` characters each), chosen by a hash of the id.
Every document is then labelled whole, in one pass without a shuffle; the
weights (a fixed size) go with the tasks.

Defined results: `und` with score 0 for a null text, one without a letter, or
when there is no labelled text at all; ties go to the first label by name;
repeated rows are labelled alike; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import crc_mod

DIM = 1 << 16
EDGE = ".,;:!?()[]{}\"'|#*$%&<>-_…«»„“”"
REMEMBERED_WORDS = 300_000
#: Characters of a chain item at most (scripts without spaces have whole texts as words).
PIECE = 40
#: Labels at most: weights take 256 KB each.
MAX_LABELS = 400
#: Words for which forward-backward runs at a time.
WORDS_AT_ONCE = 600_000


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category (numbers such as ½ or ② are not)."""
    return text.isalpha() or any(map(str.isalpha, text))


def items(text: str) -> list[str]:
    """The chain of a text: its words in lower case, those longer than PIECE as consecutive pieces."""
    words = text.lower().split()
    if not words or max(map(len, words)) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) > PIECE and len(w := word.strip(EDGE)) > PIECE:
            out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
        else:
            out.append(word)
    return out


def features(word: str) -> list[int]:
    """Hashed lexicon, affix and n-gram features of a word (lower case)."""
    w = word.strip(EDGE)
    if not has_letter(w):
        return []
    p = f"^{w}$"
    names = [f"w{w}", *(f"p{w[:k]}" for k in (1, 2, 3) if k < len(w)), *(f"s{w[-k:]}" for k in (1, 2, 3) if k < len(w))]
    names += [p[i : i + 2] for i in range(len(p) - 1)]
    names += [p[i : i + 3] for i in range(len(p) - 2)]
    crc = zlib.crc32
    return [crc(n.encode()) & (DIM - 1) for n in names]


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the feature weights of each word."""
    each = [features(w) for w in words]
    out = np.zeros((len(words), weights.shape[1]), dtype=np.float32)
    some = [i for i, x in enumerate(each) if x]
    if some:
        flat = np.fromiter((k for i in some for k in each[i]), dtype=np.int64)
        starts = np.cumsum([0, *(len(each[i]) for i in some[:-1])])
        out[some] = np.add.reduceat(weights[flat], starts, axis=0)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values, emissions and transition factors, over chains laid end to end, longest first."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max()).astype(e.dtype)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    steps = int(lengths[0]) if len(lengths) else 0
    on = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than t
    alpha = np.empty_like(e)
    for t in range(steps):
        at = starts[: on[t]] + t
        now = e[at] if t == 0 else e[at] * (alpha[at - 1] @ a)
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    beta = np.ones_like(e)
    back = np.ascontiguousarray(a.T)
    for t in range(steps - 2, -1, -1):
        at = starts[: on[t + 1]] + t
        now = (e[at + 1] * beta[at + 1]) @ back
        beta[at] = now / now.sum(axis=1, keepdims=True)
    return alpha, beta, e, a


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word."""
    alpha, beta, _, _ = forward_backward(scores, lengths, transitions)
    alpha *= beta
    return alpha / alpha.sum(axis=1, keepdims=True)


@dataclass
class Field:
    """A fitted field; as a labeller it remembers scores of words."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    rows: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def _indices(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        new = [w for w in set(words) if w not in rows]
        if len(rows) + len(new) > REMEMBERED_WORDS and rows:
            rows.clear()
            self.table = None
            new = list(set(words))
        if new:
            scores = np.concatenate([word_scores(new[i : i + 20_000], self.weights) for i in range(0, len(new), 20_000)])
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.table = scores if self.table is None else np.concatenate([self.table, scores])
        return np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))

    def label_words(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all words of non-empty texts, in order of decreasing length, and that order."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = self._indices([w for i in order for w in texts[i]])
        return marginals(self.table[at], lengths[order], self.transitions), order

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        if not self.labels:
            return out
        known = [(i, w) for i, t in enumerate(texts) if t and has_letter(t) and (w := items(t))]
        known.sort(key=lambda x: -len(x[1]))
        while known:
            held, n = 0, 0
            while n < len(known) and (n == 0 or held + len(known[n][1]) <= WORDS_AT_ONCE):
                held += len(known[n][1])
                n += 1
            part, known = known[:n], known[n:]
            words = [w for _, ws in part for w in ws]
            p, _ = self.label_words([w for _, w in part])
            spoken = np.fromiter((has_letter(w) for w in words), dtype=bool, count=len(words))
            starts = np.concatenate([[0], np.cumsum([len(w) for _, w in part])[:-1]])
            total = np.add.reduceat(p * spoken[:, None], starts, axis=0, dtype=np.float64)
            number = np.maximum(1, np.add.reduceat(spoken.astype(np.int64), starts))
            mean = total / number[:, None]
            best = mean.argmax(axis=1)
            for (i, _), b, m in zip(part, best, mean):
                out[i] = (self.labels[b], float(min(1.0, max(0.0, m[b]))))
        return out


def fit(texts: list[tuple[str, str]], rounds: int = 30, rate: float = 0.15, segment: int = 50, ridge: float = 1e-4, mix_every: int = 4) -> Field:
    """Fits by full-batch Adam on the log-likelihood of the labelled chains, cut into segments; some go on in another label."""
    labels = sorted({y for y, _ in texts})
    n = len(labels)
    if not n:
        return Field([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32))
    chains = []
    for y, t in texts:
        w = items(t)
        chains += [([labels.index(y)] * len(w[i : i + segment]), w[i : i + segment]) for i in range(0, len(w), segment)]
    # Texts have one label each. So that transitions between labels are learned too, every mix_every-th chain goes on with
    # the second half of another one, half the sample away, whatever its label.
    far = len(chains) // 2
    for i in range(0, far, mix_every):
        (y, w), (z, x) = chains[i], chains[i + far]
        chains[i] = (y[: len(w) // 2] + z[len(x) // 2 :], w[: len(w) // 2] + x[len(x) // 2 :])
    chains.sort(key=lambda c: -len(c[1]))
    lengths = np.array([len(w) for _, w in chains], dtype=np.int64)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in chains for w in ws}))}
    at = np.fromiter((vocabulary[w] for _, ws in chains for w in ws), dtype=np.int64)
    gold = np.fromiter((y for ys, _ in chains for y in ys), dtype=np.int64)
    each = [features(w) for w in vocabulary]
    flat = np.fromiter((k for x in each for k in x), dtype=np.int64)
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    inside = np.ones(len(at), dtype=bool)
    inside[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False  # words with a predecessor in their chain
    pairs = np.flatnonzero(inside)
    weights, trans = np.zeros((DIM, n)), np.zeros((n, n))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    seen = np.bincount(gold[pairs - 1] * n + gold[pairs], minlength=n * n).reshape(n, n)

    def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, c], size) for c in range(n)], axis=1)

    for step in range(1, rounds + 1):
        scores = summed(owner, weights[flat], len(each))[at]
        alpha, beta, e, a = forward_backward(scores, lengths, trans)
        p = alpha * beta
        g = -p / p.sum(axis=1, keepdims=True)
        g[np.arange(len(at)), gold] += 1
        q = alpha[pairs - 1][:, :, None] * a * (e[pairs] * beta[pairs])[:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        grads = (summed(flat, summed(at, g, len(each))[owner], DIM) / len(at) - ridge * weights, (seen - q.sum(axis=0)) / max(1, len(pairs)) - 1e-3 * trans)
        for k, (x, d) in enumerate(zip((weights, trans), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(labels, weights.astype(np.float32), trans.astype(np.float32))


def learn(docs: DataFrame, per_language: int = 150, sample_chars: int = 8_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fits on a bounded sample of the rows given: expected per_language texts of each label, twice that at most.

    Of a text longer than sample_chars the sample has a window of that length, at a place that its id decides.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    place = F.pmod(F.xxhash64(F.lit("window"), F.col(id_col)), F.greatest(F.length(F.col(text_col)) - sample_chars, F.lit(0)) + 1)
    rows = rows.select(F.col(id_col).alias("i"), F.substr(F.col(text_col), place.cast("int") + 1, F.lit(sample_chars)).alias("t"), F.col(lang_col).alias("l"))
    counts = sorted((r["l"], r["count"]) for r in rows.groupBy("l").count().collect())  # one row for each label
    if len(counts) > MAX_LABELS:
        raise ValueError(f"{len(counts)} labels: the weights go to every task and are bounded by {MAX_LABELS} labels")
    texts: list[tuple[str, str]] = []
    if counts:
        share = F.lit(0.0)
        for lang, n in counts:
            share = F.when(F.col("l") == lang, F.lit(per_language / n)).otherwise(share)
        picked = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * per_language * len(counts))
        texts = sorted((r["l"], r["t"]) for r in picked.collect())
    return fit(texts)


def identify(docs: DataFrame, fitted: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    labels, weights, transitions = fitted.labels, fitted.weights, fitted.transitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(labels, weights, transitions)
        for b in batches:
            for at in range(0, b.num_rows, 4_000):
                part = b.slice(at, 4_000)
                got = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    fitted = learn(docs.where(~held_out))
    return identify(docs, fitted).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
