"""The methods' own results against second computations: terms, allocations, fences, recall, layouts, repeated ids."""

import collections
import json
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from haltwise.llm import chat_format, language_id, near_duplicates, personal_data, quality, shingles, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 2


def test_fences_of_groups_above_the_sketch(spark):
    """The quartiles behind a fence lie within 1 % of the ranks of the exact ones where a group has 30,000 rows."""
    rnd = random.Random(3)
    rates = [rnd.gauss(5, 1) for _ in range(30_000)]
    df = spark.createDataFrame([(r, 0.0) for r in rates], "r_length double, z double")
    for r in quality.SLACK:
        if r != "r_length":
            df = df.withColumn(r, F.col("z"))
    df = df.withColumns({"base_failed": F.lit(False), "lang": F.lit("en"), "source": F.lit("a")}).repartition(7)
    t = quality.thresholds(df).first()
    reach, slack = quality.REACH, quality.SLACK["r_length"]
    # hi + lo = q25 + q75 and hi - lo = (1 + 2 reach) (q75 - q25) + 2 slack.
    total, spread = t.hi_r_length + t.lo_r_length, (t.hi_r_length - t.lo_r_length - 2 * slack) / (1 + 2 * reach)
    ordered = np.sort(rates)
    for q, value in ((0.25, (total - spread) / 2), (0.75, (total + spread) / 2)):
        assert abs(np.searchsorted(ordered, value) / len(ordered) - q) < 0.01


# 3


def pair_at(rnd, union, percent):
    a = rnd.integers(0, 2**63, union, dtype=np.uint64)
    both = union * percent // 100
    rest = (union - both) // 2
    return np.unique(a[: both + rest]), np.unique(np.concatenate([a[:both], a[both + rest :]]))


def test_recall_of_bands_and_packed_signatures():
    """Of 4,000 pairs at exactly 0.8 none may share no band, and the packed signatures let all pass."""
    rnd = np.random.default_rng(8)
    sets = [s for _ in range(4_000) for s in pair_at(rnd, int(rnd.integers(2, 12)) * 20, 80)]
    missed = 0
    for at in range(0, len(sets), 400):
        sig = near_duplicates.sign(sets[at : at + 400])
        bands, packed = near_duplicates.bands_of(sig), near_duplicates.packed_of(sig)
        shared = (bands[0::2] == bands[1::2]).any(axis=1)
        x = packed[0::2] ^ packed[1::2]
        differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(near_duplicates.MASK)).sum(axis=1)
        missed += int((~(shared & (differ <= near_duplicates.most_differing(0.8)))).sum())
    assert missed == 0


def test_rows_of_one_id_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (1, a), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x")).withColumn("_key", F.lit(1))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df, shingle=4).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    left = near_duplicates.drop_near_duplicates(df, shingle=4)
    assert left.columns == df.columns and sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, a), (1, b), (4, ""), (4, "")]


def test_components_of_long_paths_and_stars(spark):
    rnd = random.Random(6)
    path = [(i, i + 1) for i in range(300)]
    star = [(5000, 1000 + i) for i in range(300)]
    odd = [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(300)]
    edges = [(max(e), min(e)) for e in path + star + odd if e[0] != e[1]]
    rnd.shuffle(edges)
    from haltwise.llm.common import Tables

    with Tables(spark) as tables:
        df = near_duplicates.components(spark.createDataFrame(edges, "u long, v long").repartition(37), tables)
        got = {r.node: r.comp for r in df.collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


# 5


def test_numerals_are_no_letters(spark):
    f = language_id.fit([("de", "der die und nicht ein " * 30), ("es", "el la y no una " * 30)])
    assert f.predict(["½ ② ²", "Ⅷ 12", "__ --", "ª"])[:3] == [("und", 0.0)] * 3 and f.predict(["ª"])[0][0] != "und"
    assert not language_id.has_letter("½²") and language_id.has_letter("1é")


def test_transitions_follow_switches():
    """In a text of two halves the marginals switch once, and words of both languages follow their neighbours."""
    rnd = random.Random(2)
    de, en = "der die und nicht ein schön haus".split(), "the of this house is nice from".split()
    text = lambda ws, n: " ".join(rnd.choice([*ws, "taxi", "radio"]) for _ in range(n))
    f = language_id.fit([(y, text(ws, 60)) for _ in range(30) for y, ws in (("de", de), ("en", en))])
    assert f.transitions[0, 0] > f.transitions[0, 1] and f.transitions[1, 1] > f.transitions[1, 0]
    words = "der haus und taxi radio nicht haus the house of radio taxi is nice".split()
    p, _ = f.label_words([words])
    assert ["de" if x[0] > x[1] else "en" for x in p] == ["de"] * 7 + ["en"] * 7


# 6


def test_allocation_against_brute_force(docs):
    """Every token of real texts goes to the line it shares most characters with."""
    e = token_counts.Encoder(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    some = docs.where(F.length("text") < 4_000)
    want = collections.Counter()
    for i, t in rows_of(some):
        lines = token_counts.line_sections(t)
        at, raw = 0, t.encode()
        place = [k for k, c in enumerate(t) for _ in c.encode()]
        for token in e.encode(t):
            size = int(e.sizes[token])
            chars = sorted(set(place[at : at + size]))
            at += size
            shared = [sum(a <= c < b for c in chars) for _, a, b in lines]
            want[i, shared.index(max(shared))] += 1
        assert at == len(raw)
    got = collections.Counter()
    for r in token_counts.op6_token_counts(some, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        if r.n_tokens:
            got[r.doc_id, r.section] += r.n_tokens
    assert got == want


# 7


def test_layouts_with_unknown_fields_and_rejected_records(spark):
    rows = [
        (1, '{"id":7,"messages":[{"role":"user","content":"hi","name":"n"},{"role":"assistant","content":"yo","name":"m"}]}', [("messages", "user", "hi"), ("messages", "assistant", "yo")]),
        (2, '{"prompt":"a","response":"b","score":0.5}', [("prompt_response", "user", "a"), ("prompt_response", "assistant", "b")]),
        (3, '{"other":1}', [(None, None, None)]),
        (4, "no json", [(None, None, None)]),
        (5, '{"messages":[]}', []),
    ]
    df = spark.createDataFrame([(i, 0, j) for i, j, _ in rows], "conv_id long, turn long, record string")
    turns = chat_format.canonical_turns(df)
    got = collections.defaultdict(list)
    for r in turns.orderBy("conv_id", "seq").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    assert {i: got[i] for i, _, _ in rows} == {i: w for i, _, w in rows}
    assert sorted(tuple(r) for r in chat_format.rejected(turns).collect()) == [(3, 1), (4, 1)]
    assert {r.conv_id for r in chat_format.format_conversations(turns).collect()} == {1, 2}


def test_very_long_records_keep_their_layout(spark):
    long = "word " * 3_600_000
    record = json.dumps({"messages": [{"role": "user", "content": long}, {"role": "assistant", "content": "ok"}]})
    df = spark.createDataFrame([(1, 0, record)], "conv_id long, turn long, record string")
    got = chat_format.canonical_turns(df).select("layout", "role", F.length("text")).collect()
    assert sorted(map(tuple, got)) == [("messages", "assistant", 2), ("messages", "user", len(long))]


# 8


def brute_terms(rows, min_contexts=3, generalise=1.0, remove=0.25):
    """{row: [(start, stop)]} of revealing terms, from the definitions, row by row."""
    spans = [[(k, s, e) for k, s, e in personal_data.base_spans(t or "")] for _, t in rows]
    words = []
    for (_, t), sp in zip(rows, spans):
        mine = []
        for m in WORD.finditer(t or ""):
            w, s = m.group(), m.start()
            if any(a < m.end() and s < b for _, a, b in sp):
                continue
            core = w.strip(personal_data.EDGE)
            s += len(w) - len(w.lstrip(personal_data.EDGE))
            if len(core.lower()) >= 3 and any(c.isalpha() for c in core.lower()):
                mine.append((core.lower(), s, s + len(core)))
        words.append(mine)
    n_t = collections.Counter()
    n_te, contexts = collections.Counter(), collections.defaultdict(set)
    for (_, t), sp, ws in zip(rows, spans, words):
        line = [w for w, _, _ in ws]
        for w in {personal_data.term_of(x) for x in WORD.findall(t or "")} - {None}:
            n_t[w] += 1
        first = {}
        for k, a, b in sp:
            s = t[a:b]
            e = (k, s.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", s))
            first[e] = min(a, first.get(e, a))
        for e, a in first.items():
            i = sum(s < a for _, s, _ in ws)
            here = tuple(line[max(0, i - 5) : i + 5])
            for w in set(line):
                j = line.index(w)
                n_te[w, e] += 1
                contexts[w, e].add((here, tuple(line[max(0, j - 5) : j + 6])))
    told = {w for (w, e), n in n_te.items() if len(contexts[w, e]) >= min_contexts and math.log2(max(n_t[w], n) / n) <= generalise}
    return [sorted((s, x) for w, s, x in ws if w in told) for ws in words]


def term_spans(df):
    out = collections.Counter()
    for r in personal_data.op8_personal_data(df).collect():
        mine = tuple(sorted((int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"))
        out[r.doc_id, mine] += 1
    return out


@pytest.mark.parametrize("times", [1, 4])
def test_terms_against_brute_force(spark, docs, times):
    rnd = random.Random(7)
    word = lambda i: rnd.choice(["zorblax" if i < 20 else "plover", "Quimby", "news", f"w{i}", f"v{rnd.randint(0, 9)}", "today", "from"])
    said = [(900 + i, " ".join(word(i) for _ in range(12)) + f" p{i // 20}@far.org, x{i} end") for i in range(30)]
    rows = (said + [(i, t) for i, t in rows_of(docs.where(F.length("text") < 3_000))]) * times
    want = collections.Counter((i, tuple(s)) for (i, _), s in zip(rows, brute_terms(rows)))
    got = term_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want and any(s for _, s in got)


def test_no_record_is_lost(spark):
    """Nulls beside unknown fields, records of two layouts, lists as content, mixed elements, empty lists: read, or rejected."""
    read = [
        ('{"messages":[],"prompt":"x","response":"y"}', [("user", "x"), ("assistant", "y")]),
        ('{"id":1,"prompt":"x","response":null}', [("user", "x"), ("assistant", "")]),
        ('{"id":3,"role":"user","text":null}', [("user", "")]),
        ('{"id":4,"messages":[{"role":"user","content":null,"name":"n"}]}', [("user", "")]),
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":5}]}', [("user", "a"), ("assistant", "5")]),
        ('{"messages":[{"role":"user","content":"a","tool":{"deep":[{"er":1}]}},{"content":"b","role":"assistant"}],"meta":{"a":{"b":[1]}}}', [("user", "a"), ("assistant", "b")]),
        ('{"text":"t","role":"user","prompt":"p","response":"r","system":"s"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"system":null,"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"instruction":"do","input":null,"output":"done","score":1}', [("user", "do"), ("assistant", "done")]),
    ]
    lost = [
        '{"messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}]}',
        '{"messages":[{"role":"user","content":"x"},{"role":"user","content":[{"type":"text"}]}]}',
        '{"messages":[{"from":"human","value":"x"}]}',
        '{"messages":[],"id":1}',
        '{"messages":null,"id":1}',
        '{"messages":["a"],"id":1}',
        '{"role":{"a":1},"text":"x"}',
        '{"id":1}',
        "[]",
        "no json",
        None,
    ]
    rows = [(k, 0, j) for k, (j, _) in enumerate(read)] + [(100 + k, 0, j) for k, j in enumerate(lost)]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    got = {}
    for r in turns.where("layout IS NOT NULL").orderBy("conv_id", "seq").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: t for k, (_, t) in enumerate(read)}
    assert {tuple(r) for r in chat_format.rejected(turns).collect()} == {(100 + k, 1) for k in range(len(lost))}


def test_languages_with_long_texts_only_are_learned(spark):
    """A label is learned from windows of its texts if they are all longer than the sample's."""
    rnd = __import__("random").Random(4)
    words = {"en": "the and of that which with from have this water bridge".split(), "fr": "les des que dans pour avec une sur pont rivière été".split()}
    rows = [(k, " ".join(rnd.choice(words[lang]) for _ in range(n)), lang) for k, (lang, n) in enumerate([("en", 30)] * 40 + [("en", 3000)] * 20 + [("fr", 3000)] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.learn(df, sample_chars=2_000)).collect()}
    assert got == {k: lang for k, _, lang in rows}
