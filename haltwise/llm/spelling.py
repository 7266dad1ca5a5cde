"""Spelling variants: words that one inserted, deleted or replaced letter makes of another, by asymmetric q-chunks.

Of a pair the shorter word x (of equal length, the smaller one) is cut into two disjoint
chunks, its halves; the other contributes its positional grams of those lengths. One
edit falls into one half and leaves the other as it was, at its place or, behind an insertion, one
place further on. So candidates are the pairs in which a gram equals a chunk of
the same number within a shift of one; grams at other places can't be met and aren't made.

Chunk and gram are keyed by x's length, the chunk's number and the letters, which are half of a
word, so a key holds few words. Before candidates are verified by their edit distance, two
longs turn most of them away: a replaced letter changes at most two bits of a sum of bits by
(place, letter), an inserted one at most one bit of a sum by letter alone. Tests and
verification stand in the join's condition, so no candidate becomes a row. Keys that hold many words are split by Spark's
adaptive join, as either side holds rows of its own.

Counting: runs of letters are counted by task in bounded tables, then by word.

Defined results: a null text has no words; a null id counts as the empty text in the
hash; repeated rows count again; ties between forms go to the smallest word; no
words, no rows. Other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import Tables, settings, stash, text_bytes
from haltwise.llm.prefix_trie import CRC_TABLE, crc_sql

#: Letters of a word at least, its occurrences at least, and how many times as often a form must occur.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: A run loses a letter if this divides its hash.
SLIP = 199
#: Distinct words that a task counts before it hands the counts on.
COUNTED_AT_ONCE = 200_000
TEXTS_AT_ONCE = "2000"


def _counts(letters: int, slip: int | None):
    run_of = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(run_of.findall(text.as_py().lower().decode())).items():
                    if slip and (h := zlib.crc32(word.encode(), start)) % slip == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < letters:
                            continue
                    counts[word] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    return run


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, A-Z lowered, that are long and frequent enough; with `slip`, some runs lose a letter first."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), text_bytes(text_col).alias("t"))
    found = src.mapInArrow(_counts(letters, slip), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _with_tests(words: DataFrame) -> DataFrame:
    """words with their length, and the bits of their letters with (by_place) and without places (by_letter)."""
    fold = lambda key: F.expr(f"aggregate(sequence(1, length(word)), 0L, (s, i) -> s ^ shiftleft(1L, cast(pmod(xxhash64({key}), 64) AS int)))")
    return words.select("word", "n", F.length("word").alias("len"), fold("i, substr(word, i, 1)").alias("by_place"), fold("substr(word, i, 1)").alias("by_letter"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(x, nx, y, ny): each pair of words that differ by exactly one inserted, deleted or replaced letter, once. words: word, n."""
    w = _with_tests(words)
    half = lambda length: F.floor(length / 2).cast("int")
    cut = lambda start, length: F.substring(F.col("word"), start, length)

    def pieces(length: Column, shift: int) -> list[Column]:
        """The two chunks of a word of some length, the second one `shift` places further on."""
        q = half(length)
        two = [(1, cut(F.lit(1), q)), (2, cut(q + 1 + shift, length - q))]
        return [F.struct(length.alias("of"), F.lit(i).alias("no"), c.alias("chunk"), F.lit(shift).alias("shift")) for i, c in two]

    row = F.struct("word", "n", "len", "by_place", "by_letter")
    own = F.col("len")
    chunks = w.select(row.alias("x"), F.explode(F.array(*pieces(own, 0))).alias("e")).select("x", "e.of", "e.no", "e.chunk")
    grams = w.select(row.alias("y"), F.explode(F.array(*pieces(own, 0), *pieces(own - 1, 1))).alias("e")).select("y", "e.of", "e.no", "e.chunk", "e.shift")

    x, y = F.col("x"), F.col("y")
    bits = lambda c: F.bit_count(x[c].bitwiseXOR(y[c]))
    replaced = (F.col("r.shift") == 0) & (x["word"] < y["word"]) & (bits("by_place") <= 2)
    # Both chunks are left by an insertion between them: the first one gives the pair.
    first = F.substring(x["word"], F.lit(1), half(x["len"])) != F.substring(y["word"], F.lit(1), half(x["len"]))
    inserted = (F.col("r.shift") == 1) & (bits("by_letter") <= 1) & ((F.col("l.no") == 1) | first)
    same = (F.col("l.of") == F.col("r.of")) & (F.col("l.no") == F.col("r.no")) & (F.col("l.chunk") == F.col("r.chunk"))
    met = chunks.alias("l").join(grams.alias("r"), same & (replaced | inserted) & (F.levenshtein(x["word"], y["word"], 1) == 1))
    return met.select(x["word"].alias("x"), x["n"].alias("nx"), y["word"].alias("y"), y["n"].alias("ny"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n (ties: the smallest) where it occurs `ratio` times as often."""
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("near_n")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    often = -F.col("b.m") >= ratio * F.col("n")
    joined = words.join(best, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("b.near")).alias("form"), F.when(often, -F.col("b.m")).alias("form_n"))


def with_roots(formed: DataFrame, tables: Tables) -> DataFrame:
    """formed with the last word that forms lead to: each step occurs more often, so there is an end; steps double by round."""
    steps = tables.write(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = tables.write(steps.join(further, "root", "left"), "met")
        if met.where("next IS NOT NULL").isEmpty():
            break
        tables.drop(steps)
        steps = tables.write(met.select("word", F.coalesce("next", "root").alias("root")), "steps")
        tables.drop(met)
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every long and frequent word (see the module)."""
    spark = docs.sparkSession
    with Tables(spark) as tables:
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_AT_ONCE):
            words = tables.write(word_counts(docs, letters, occurrences, slip, id_col, text_col), "words")
        pairs = tables.write(near_pairs(words), "pairs")
        formed = tables.write(forms(words, pairs, ratio), "forms")
        return stash(with_roots(formed, tables).select("word", "form", "root", "n", "n_near", "form_n"), "variants")


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs, slip=SLIP)


#: Near words by their shared deletions: a method of its own, which a table of all deletions allows on few words.
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)),
hashed AS (SELECT w, c, {crc_sql("k || ':' || w")} AS h FROM (SELECT k, w, count(*) AS c FROM runs WHERE length(w) >= {LETTERS} GROUP BY ALL), crc),
words AS (SELECT w, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM hashed) WHERE length(w) >= {LETTERS} GROUP BY w HAVING sum(c) >= {OCCURRENCES}),
cut AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS s FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.w, b.w AS v, b.n AS m FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN words b ON a.s = b.w UNION SELECT b.w, a.w, a.n FROM cut a JOIN words b ON a.s = b.w),
best AS (SELECT w, count(*) AS n_near, max(m) AS m FROM near GROUP BY w),
formed AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * words.n THEN m END AS form_n, CASE WHEN m >= {RATIO} * words.n THEN (SELECT min(v) FROM near x WHERE x.w = words.w AND x.m = best.m) END AS form FROM words LEFT JOIN best ON best.w = words.w),
roots AS (SELECT w, w AS root FROM formed WHERE form IS NULL UNION ALL SELECT f.w, r.root FROM formed f JOIN roots r ON f.form = r.w)
SELECT f.w AS word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed f JOIN roots r ON r.w = f.w"""
