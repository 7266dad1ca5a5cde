"""Quality rules whose thresholds adapt to each language and source.

Every document gets a few rates (symbols and repeated words per word, shouted
words, repeated lines, mean word length). Mergeable KLL quantile sketches of
each rate are built per (language, source) and merged upwards to languages and
to the corpus; a group with fewer than `min_rows` documents takes the quantiles
of its language, and a small language those of the corpus. A document is
rejected when a rate lies beyond its group's fence,

    q75 + reach * (q75 - q25) + slack

(for the mean word length also below the mirrored lower fence), or when it
fails the base rule. Only DataFrame functions are used.

Defined results: a null or empty text has no words and fails the base rule;
null language or source is a group of its own; ties and repeated rows are
judged alike; input columns of the names added here are replaced.
Sketches are exact up to `k` documents a group, approximate beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import stash

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The least distance of a fence from the upper (or lower) quartile, by rate.
SLACK = {"r_symbols": 0.05, "r_shout": 0.10, "r_dup_lines": 0.30, "r_repeat": 0.15, "r_length": 2.0}
REACH = 3.0
#: Groups whose fences are broadcast at most: about 20 MB.
BROADCAST_GROUPS = 100_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five that the text has twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Most texts
    repeat none, which one hash set shows; only the others are sorted.
    """

    def marked(windows: Column) -> Column:
        in_order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            )
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(
                starts,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                    F.lit(0).cast("long"),
                    lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(in_order, count))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), marked))
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus the base counts, base_failed and the rates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))).alias("n_shout"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    named = [*BASE, "base_failed", *SLACK, "_w", "_l"]
    kept = [c for c in docs.columns if c not in named]
    out = docs.select(
        *kept,
        let(words, of_words).alias("_w"),
        let(lines, of_lines).alias("_l"),
        F.length(_without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n = F.greatest(F.col("_w.n_words"), F.lit(1)).cast("double")
    return out.select(
        *kept,
        F.col("_w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        ((F.col("_w.n_words") < 10) | (100 * F.col("_w.n_repeat_words") > 20 * F.col("_w.n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("r_symbols"),
        (F.col("_w.n_shout") / n).alias("r_shout"),
        (F.col("_l.n_dup_lines") / F.greatest(F.col("_l.n_lines"), F.lit(1)).cast("double")).alias("r_dup_lines"),
        (F.col("_w.n_repeat_words") / n).alias("r_repeat"),
        (F.col("word_chars") / n).alias("r_length"),
    )


def thresholds(measured: DataFrame, min_rows: int = 200, k: int = 2048, reach: float = REACH, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source): hi_<rate> for each rate and lo_r_length.

    The small groups' fallback merges the same sketches; the texts are read once.
    """
    rates = list(SLACK)
    enough = measured.filter(~F.col("base_failed"))
    groups = enough.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(f"s_{r}") for r in rates]
    )
    # A group in which all fail the base rule still needs a row.
    every = measured.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(F.count("*").alias("n_all"))
    merged = [F.kll_merge_agg_double(f"s_{r}", F.lit(k)).alias(f"s_{r}") for r in rates]
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    whole = groups.agg(F.sum("n").alias("n"), *merged)
    g, l, w = groups.alias("g"), langs.alias("l"), whole.alias("w")
    wide = (
        every.alias("e")
        .join(g, F.col("e.lang").eqNullSafe(F.col("g.lang")) & F.col("e.source").eqNullSafe(F.col("g.source")), "left")
        .join(l, F.col("e.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(F.broadcast(w), F.lit(True), "left")  # one row
    )
    use_g, use_l = F.col("g.n") >= min_rows, F.col("l.n") >= min_rows

    def quantile(r: str, q: float) -> Column:
        s = F.when(use_g, F.col(f"g.s_{r}")).when(use_l, F.col(f"l.s_{r}")).otherwise(F.col(f"w.s_{r}"))
        return F.kll_sketch_get_quantile_double(s, F.lit(q))

    cols = [F.col("e.lang").alias("t_lang"), F.col("e.source").alias("t_source")]
    for r in rates:
        cols += [quantile(r, 0.25).alias(f"_a_{r}"), quantile(r, 0.75).alias(f"_b_{r}")]
    spread = wide.select(*cols)
    fences = [(F.col(f"_b_{r}") + reach * (F.col(f"_b_{r}") - F.col(f"_a_{r}")) + SLACK[r]).alias(f"hi_{r}") for r in rates]
    low = (F.col("_a_r_length") - reach * (F.col("_b_r_length") - F.col("_a_r_length")) - SLACK["r_length"]).alias("lo_r_length")
    return spread.select("t_lang", "t_source", *fences, low)


def _known(measured: DataFrame, **params) -> DataFrame:
    """The fences as a written table; marked for broadcast if its rows, which are counted, are few."""
    t = stash(thresholds(measured, **params), "fences")
    return F.broadcast(t) if t.count() <= BROADCAST_GROUPS else t


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """measured plus the fences of each row's group and `kept`."""
    same = measured["lang"].eqNullSafe(fences["t_lang"]) & measured["source"].eqNullSafe(fences["t_source"])
    joined = measured.join(fences, same, "left").drop("t_lang", "t_source")
    beyond = F.lit(False)
    for r in SLACK:
        beyond |= F.coalesce(F.col(r) > F.col(f"hi_{r}"), F.lit(False))
    beyond |= F.coalesce(F.col("r_length") < F.col("lo_r_length"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)


def assess(docs: DataFrame, keep: list[str], **params) -> DataFrame:
    """Columns `keep` of docs plus counts, rates, the group's fences and `kept`.

    Measured rows, with the columns `keep` only, are written once to the shared
    folder: the sketches and the joined filter both read them, and texts are
    read once.
    """
    m = measure(docs)
    m = stash(m.select(*dict.fromkeys([*keep, "lang", "source", *BASE, "base_failed", *SLACK])), "quality")
    return judge(m, _known(m, **params))


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Rows are written once with their rates, so the costly measuring is done once:
    the sketches read the rates only, the filter reads all. Texts are not shuffled
    as long as the fences are few enough to go with the tasks.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "lang", "source")
    return assess(packed, keep=["_doc"], **params).where("kept").select("_doc.*")


def op2_quality(docs: DataFrame) -> DataFrame:
    return assess(docs.select("doc_id", "text", "lang", "source"), keep=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")


#: The same rows in SQL, as long as groups have no more rows than a sketch holds exactly.
ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS shout, greatest(coalesce(lin.n, 0), 1) AS n_lines, greatest(len(w), 1) AS m
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / m AS r1, shout / m AS r2, n_dup_lines / n_lines AS r3, n_repeat_words / m AS r4, word_chars / m AS r5 FROM b),
v AS (SELECT doc_id, lang, source, unnest([1, 2, 3, 4, 5]) AS k, unnest([r1, r2, r3, r4, r5]) AS x FROM r WHERE NOT base_failed),
g AS (SELECT lang, source, k, count(*) AS n, quantile_disc(x, 0.25) AS a, quantile_disc(x, 0.75) AS z FROM v GROUP BY ALL), l AS (SELECT lang, k, count(*) AS n, quantile_disc(x, 0.25) AS a, quantile_disc(x, 0.75) AS z FROM v GROUP BY ALL),
w AS (SELECT k, quantile_disc(x, 0.25) AS a, quantile_disc(x, 0.75) AS z FROM v GROUP BY ALL),
q AS (SELECT r.doc_id, unnest([1, 2, 3, 4, 5]) AS k, unnest([r1, r2, r3, r4, r5]) AS x, unnest([0.05, 0.1, 0.3, 0.15, 2.0]) AS slack, lang, source FROM r),
f AS (SELECT q.doc_id, k, x, slack, CASE WHEN g.n >= 200 THEN g.a WHEN l.n >= 200 THEN l.a ELSE w.a END AS a, CASE WHEN g.n >= 200 THEN g.z WHEN l.n >= 200 THEN l.z ELSE w.z END AS z
  FROM q JOIN w USING (k) LEFT JOIN g ON g.k = q.k AND g.lang IS NOT DISTINCT FROM q.lang AND g.source IS NOT DISTINCT FROM q.source LEFT JOIN l ON l.k = q.k AND l.lang IS NOT DISTINCT FROM q.lang),
o AS (SELECT doc_id, bool_or(x > z + 3 * (z - a) + slack OR (k = 5 AND x < a - 3 * (z - a) - slack)) AS beyond FROM f GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM r LEFT JOIN o USING (doc_id)
"""
