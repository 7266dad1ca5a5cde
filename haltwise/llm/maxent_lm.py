"""A hashed maximum-entropy language model with a class-factored softmax.

    P(word | history) = P(class | features of the history) * P(word | class)

Classes are the text's end and hashes of word endings. The first factor is a
softmax over classes of summed weights of hashed features: the word before (n-gram),
the one before that (skip) and both together. It is trained by distributed
gradient updates over walks. A walk is a share of the training documents, about
`walk_bytes` of text, dealt by a hash of id and text and taken in that hash's
order, so walks and their minibatches follow from the rows alone, however the table is cut into
files and partitions. A step takes some of the walks: each starts from the common
weights, goes through its minibatches with adaptive steps, and the walks' weights
are averaged by the tokens behind them. A round has two steps, an eighth of the walks
first and then the others from what these learned, so it goes through every text
once. The second factor is a softmax of counts
alone with half a count added, so its sum over a class is known exactly.

Counts cover all training tokens. Scoring needs each token's count: tokens above
a share `head_share` of all (fewer than 1 / head_share, so their number has a
fixed bound) go with the tasks; occurrences of the others are joined with the
counts by token, and the logs summed per row.

Defined results: a null or empty text is its end token alone; without training
documents every count is 0; repeated rows are scored each; ids may repeat, and
rows of one id and one text meet in one walk, which holds no more of them at once
than a batch. Weights are summed in doubles, so scores of two runs agree to about
six digits, not to the last bit.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import crc_mod, stash, text_bytes
from haltwise.llm.shingles import mix

CLASSES = 16
#: Rows of weights: one bias, then BUCKETS for each of the three features.
BUCKETS = 1 << 13
ROWS = 1 + 3 * BUCKETS
#: The end of a text as a token; no word holds a space.
END = b" "
START = np.uint64(0x5157A27)
TOKENS_AT_ONCE = 100_000
BATCH = 10_000
#: Tokens in a minibatch of the training.
MINIBATCH = 2_000
#: Bytes of text in a walk, on average.
WALK_BYTES = 1 << 24
#: One in so many walks is taken in the first step of a round.
FIRST_SHARE = 8
#: Tasks of a step; beyond, a task takes several walks one after the other, with the same result.
MOST_TASKS = 20_000
HEAD_SHARE = 1e-6


def class_of(word: bytes) -> int:
    return 0 if word == END else 1 + zlib.crc32(word.strip(b".,;:!?")[-3:]) % (CLASSES - 1)


class _Codes(dict):
    """Word -> 64-bit hash whose low four bits are its class; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        c = self[word] = xxhash.xxh3_64_intdigest(word) & ~15 | class_of(word)
        return c


_codes = _Codes()


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def inputs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (tokens x 3) and classes of the tokens of some texts; a text opens with two start marks."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.fromiter(map(_codes.__getitem__, (w for t in texts for w in t)), dtype=np.uint64, count=int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one, two = np.empty_like(code), np.empty_like(code)
    one[1:], two[2:] = code[:-1], code[:-2]
    one[starts] = START
    two[starts] = START
    second = starts[lengths > 1] + 1
    two[second] = START
    n = np.uint64(BUCKETS)
    both = mix(two * np.uint64(0x9E3779B97F4A7C15) + one)
    feats = np.stack([1 + (one >> np.uint64(8)) % n, 1 + n + (two >> np.uint64(12)) % n, 1 + n + n + both % n], axis=1).astype(np.int64)
    return feats, (code & np.uint64(15)).astype(np.int64)


def class_logs(feats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural logs of the class probabilities of each token."""
    z = weights[feats[:, 0]] + weights[feats[:, 1]] + weights[feats[:, 2]] + weights[0]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def update(weights: np.ndarray, squares: np.ndarray, feats: np.ndarray, gold: np.ndarray, rate: float) -> None:
    """One gradient step on a minibatch, with a step size of its own for every weight."""
    g = -np.exp(class_logs(feats, weights))
    g[np.arange(len(gold)), gold] += 1
    flat = feats.T.ravel().astype(np.uint16)  # ROWS fits; sorted by digits
    order = np.argsort(flat, kind="stable")
    index = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    rows = np.concatenate([[0], index[starts]]).astype(np.int64)
    grads = np.concatenate([g.sum(axis=0, keepdims=True), np.add.reduceat(g[order % len(gold)], starts, axis=0)])
    squares[rows] += grads * grads
    weights[rows] += rate * grads / np.sqrt(squares[rows] + 1.0)


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Tokens of a batch's texts in groups of a bounded number of tokens, with the first row of each."""
    first, held, texts = 0, 0, []
    for i, t in enumerate(batch.column(column)):
        texts.append(tokens_of(t.as_py()))
        held += len(texts[-1])
        if held >= TOKENS_AT_ONCE:
            yield first, texts
            first, held, texts = i + 1, 0, []
    if texts:
        yield first, texts


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, k, c): occurrences of every token in the texts (column t) and its class; sums per batch go to the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                total: Counter = Counter()
                for t in b.column(0).slice(at, 5_000):
                    total.update(tokens_of(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array([class_of(w) for w in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["token", "k", "c"])

    return texts.select("t").mapInArrow(run, "token binary, k int, c long").groupBy("token", "k").agg(F.sum("c").alias("c"))


def class_stats(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """Occurrences and distinct tokens of each class: at most CLASSES rows."""
    return {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}


def deal(texts: DataFrame, id_col: str = "doc_id", walk_bytes: int = WALK_BYTES) -> tuple[DataFrame, int]:
    """(walk, h, t) of texts (column t) and the number of walks, which grows with the bytes."""
    total = texts.agg(F.sum(F.octet_length("t") + F.lit(1).cast("long"))).first()[0] or 0
    walks = max(1, -(-total // walk_bytes))
    h = F.xxhash64(id_col, "t")
    return texts.select(F.pmod(h, F.lit(walks).cast("long")).alias("walk"), h.alias("h"), "t"), walks


def _walk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Tokens of each walk's texts in groups of a bounded number, cut by the walk alone and not by batches."""
    walk, held, texts = None, 0, []
    for b in batches:
        for w, t in zip(b.column(0).to_pylist(), b.column(1)):
            if texts and (w != walk or held >= TOKENS_AT_ONCE):
                yield walk, texts
                held, texts = 0, []
            walk = w
            texts.append(tokens_of(t.as_py()))
            held += len(texts[-1])
    if texts:
        yield walk, texts


def _moves(moved: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(seen[rows], pa.float64()), *(pa.array(moved[rows, j]) for j in range(CLASSES))], names=["row", "n", *(f"g{j}" for j in range(CLASSES))])


def step(dealt: DataFrame, walks: int, weights: np.ndarray, rate: float) -> np.ndarray:
    """Weights after some walks (`walks` of them) that all start from the given ones.

    Tasks add up what their walks moved, in the fixed size of the weights; so has what the driver gets.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, walk = shared.value, None
        moved, all_seen = np.zeros((ROWS, CLASSES)), np.zeros(ROWS)
        w = squares = seen = None
        for now, group in _walk_groups(batches):
            if now != walk:
                if walk is not None:
                    moved += (w - start) * seen[:, None]
                    all_seen += seen
                walk, w, squares, seen = now, start.copy(), np.zeros_like(start), np.zeros(ROWS)
            feats, gold = inputs(group)
            seen += np.bincount(feats.ravel(), minlength=ROWS)
            seen[0] += len(gold)
            for i in range(0, len(gold), MINIBATCH):
                update(w, squares, feats[i : i + MINIBATCH], gold[i : i + MINIBATCH], rate)
        if walk is not None:
            moved += (w - start) * seen[:, None]
            yield _moves(moved, all_seen + seen)

    kinds = ", ".join(f"g{j} double" for j in range(CLASSES))
    tasks = min(walks, MOST_TASKS)
    ordered = dealt.repartitionById(tasks, F.pmod("walk", F.lit(tasks)).cast("int")).sortWithinPartitions("walk", "h", "t").select("walk", "t")
    out = ordered.mapInArrow(run, f"row int, n double, {kinds}").groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"g{j}").alias(f"g{j}") for j in range(CLASSES)]).toPandas()
    weights = weights.copy()
    if len(out):
        moved = out[[f"g{j}" for j in range(CLASSES)]].to_numpy() / out["n"].to_numpy()[:, None]
        weights[out["row"].to_numpy()] += moved.astype(np.float32)
    shared.unpersist()
    return weights


def train(texts: DataFrame, stats: dict[int, tuple[int, int]], rounds: int = 1, rate: float = 0.2, id_col: str = "doc_id", walk_bytes: int = WALK_BYTES) -> np.ndarray:
    """Weights after `rounds` passes over all texts (columns id_col and t), from the classes' shares on."""
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    weights[0] = np.log([stats.get(k, (0, 0))[0] + 0.5 for k in range(CLASSES)])
    weights[0] -= weights[0].mean()
    dealt, walks = deal(texts, id_col, walk_bytes)
    early = -(-walks // FIRST_SHARE)
    for _ in range(rounds):
        weights = step(dealt.where(F.col("walk") < early), early, weights, rate)
        if early < walks:
            weights = step(dealt.where(F.col("walk") >= early), walks - early, weights, rate)
    return weights


def score(rows: DataFrame, counts: DataFrame, stats: dict[int, tuple[int, int]], weights: np.ndarray, head_share: float = HEAD_SHARE) -> DataFrame:
    """rows (doc_id, held_out, t) to one scored row each."""
    spark = rows.sparkSession
    total, distinct = sum(n for n, _ in stats.values()), sum(v for _, v in stats.values())
    within = np.array([np.log10(stats.get(k, (0, 0))[0] + 0.5 * (stats.get(k, (0, 0))[1] + 1)) for k in range(CLASSES)])
    head = counts.where(F.col("c") > head_share * total).select("token", F.log10(F.col("c") + 0.5).alias("x")).toPandas()  # fewer than 1 / head_share rows
    shared = spark.sparkContext.broadcast((dict(zip(map(bytes, head["token"]), head["x"])), weights))
    fields = "row long, doc_id long, held_out boolean, token binary, tf long, n long, known long, logs double, model double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = shared.value
        get, nan = table.get, float("nan")
        for b in batches:
            ids, docs, out = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for first, texts in _grouped(b, 3):
                feats, gold = inputs(texts)
                lengths = [len(t) for t in texts]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                words = [x for t in texts for x in t]
                logs = np.fromiter(map(get, words, repeat(nan)), dtype=np.float64, count=len(words))
                tail = np.isnan(logs)
                logs[tail] = 0
                pick = np.concatenate([class_logs(feats[i : i + BATCH], w)[np.arange(len(gold[i : i + BATCH])), gold[i : i + BATCH]] for i in range(0, len(gold), BATCH)]).astype(np.float64) / np.log(10) - within[gold]
                sums = [np.add.reduceat(x, starts) for x in (logs, pick, (~tail).astype(np.int64))]
                at = np.flatnonzero(tail)
                owner = np.repeat(np.arange(len(texts)), lengths)[at]
                rare = Counter(zip(owner.tolist(), map(words.__getitem__, at.tolist())))
                own = range(first, first + len(texts))
                of = [first + d for d, _ in rare]
                n = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own] + [ids[i] for i in of], pa.int64()),
                        pa.array([docs[i] for i in own] + [docs[i] for i in of], pa.int64()),
                        pa.array([out[i] for i in own] + [out[i] for i in of], pa.bool_()),
                        # A row's own sums carry a key that is no token and no other row's.
                        pa.array([b" %d" % ids[i] for i in own] + [t for _, t in rare], pa.binary()),
                        pa.array([0] * len(texts) + list(rare.values()), pa.int64()),
                        pa.array(lengths + [0] * n, pa.int64()),
                        pa.array(np.concatenate([sums[2], np.zeros(n, np.int64)])),
                        pa.array(np.concatenate([sums[0], np.zeros(n)])),
                        pa.array(np.concatenate([sums[1], np.zeros(n)])),
                    ],
                    names=["row", "doc_id", "held_out", "token", "tf", "n", "known", "logs", "model"],
                )

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "t").mapInArrow(run, fields)
    joined = parts.join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    done = joined.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("logs") + F.sum(F.col("tf") * F.log10(c + 0.5))).alias("logs"),
        F.sum("model").alias("model"),
    )
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, head_share: float = HEAD_SHARE, walk_bytes: int = WALK_BYTES) -> DataFrame:
    """Learns from the rows that are not held out and scores all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes(text_col).alias("t"))
    learn = rows.where(~F.col("held_out"))
    counts = stash(count_tokens(learn), "counts")
    stats = class_stats(counts)
    return score(rows, counts, stats, train(learn, stats, rounds, walk_bytes=walk_bytes), head_share)


def op9_maxent_lm(docs: DataFrame) -> DataFrame:
    return score_documents(docs, F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
