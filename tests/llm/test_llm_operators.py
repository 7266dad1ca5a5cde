"""The text operators against brute force, and on odd and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from haltwise.llm import chat_format, decontamination, language_id, maxent_lm, near_duplicates, personal_data, piece_codec, quality, sharding, shingles, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = P.path("piece_bpe_32k.model")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def test_pieces_as_the_library_has_them():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = piece_codec.PrefixTable(open(MODEL, "rb").read())
    rnd = random.Random(5)
    parts = ["a", "the", "in", " ", "  ", "\n", "▁", "é", "\x00", "\x01\n", "\x02", "日本", "🙂", "er", "<s>", "<0x41>", "1", "\t", "    "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [" " * k + "a" for k in range(40)]
    for t in texts:
        ids = table.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t), t
        assert table.decode(ids) == sp.decode(sp.encode(t)), t


def test_op1(docs, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (docs, odd):
        got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.op1_sentencepiece(df, MODEL).collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
            want.append((r.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
        assert got == sorted(want)
    assert piece_codec.op1_sentencepiece(empty, MODEL).count() == 0


def test_long_texts_leave_in_portions(spark):
    """A batch's rows are encoded and handed on a few million characters at a time, in order, with the ids of the library."""
    texts = [None, "", "a b " * 300_000, "ä" * 900_000, "x", None, "the end " * 200_000, "y"]
    parts = list(piece_codec.portions(texts))
    assert [x for p in parts for x in p] == [t or "" for t in texts] and [len(p) for p in parts] == [4, 4]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = piece_codec.encode_documents(df, MODEL).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(k, len(sp.encode(t or "", add_bos=True, add_eos=True))) for k, t in enumerate(texts)]


# 2


def base_counts(t):
    w = WORD.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op2_counts(which, docs, odd):
    df = {"docs": docs, "odd": odd}[which]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.op2_quality(df).collect())
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *base_counts(r.text)) for r in df.select("doc_id", "text").collect())


def test_op2_keeps_clean_and_drops_junk(spark):
    base = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in quality.op2_quality(spark.read.parquet(f"{base}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{base}/labels.parquet").collect()
    counts = {r.doc_id: base_counts(r.text)[5] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and not counts[r.doc_id]]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1


def test_op2_empty_and_columns(empty, odd):
    assert quality.op2_quality(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


# 3


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            s, o = sets[a], sets[b]
            if s and o and 100 * len(s & o) >= 80 * len(s | o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_groups(df, rows, k=4):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, shingle=k).collect()}
    assert got == brute_components(rows, k)


def test_op3(docs):
    check_groups(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_op3_chains_of_edits(spark):
    rnd = random.Random(2)
    rows, n = [], 0
    for _ in range(6):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(60)]
        for _ in range(25):
            rows.append((n, " ".join(w)))
            n += 1
            base = list(w)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                base[rnd.randrange(60)] = f"v{rnd.randint(0, 999)}"
            w = base if rnd.random() < 0.5 else w
            rows.append((n, " ".join(base)))
            n += 1
    rows += [(n, "short one"), (n + 1, "Short ONE"), (n + 2, "one short"), (n + 3, None), (n + 4, ""), (n + 5, " ")]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_op3_odd_rows(odd, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.kept) for r in near_duplicates.op3_near_duplicates(odd).collect())
    assert got == [(-1, True), (0, True), (1, True), (2, True), (3, True), (4, False), (5, True), (6, True), (7, True), (8, True), (8, True)]
    left = near_duplicates.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1, 0, 1, 2, 3, 5, 6, 7, 8]
    assert near_duplicates.op3_near_duplicates(empty).count() == 0 and near_duplicates.drop_near_duplicates(empty).count() == 0


def test_signature_is_a_superminhash():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, 400, dtype=np.uint64), rnd.integers(0, 2**63, 400, dtype=np.uint64)
    b[:300] = a[:300]
    s = near_duplicates.sign([np.unique(a), np.unique(b), np.unique(a[:3])])
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.08
    key = shingles.mix(a[:1])
    assert len({int(near_duplicates._positions(key, j)[0]) for j in range(near_duplicates.M)}) == near_duplicates.M


# 4


def test_op4(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = {r.item_id: grams(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for g in [grams(r.text)] for i, s in items.items() if s and 100 * len(s & g) >= 80 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontamination.op4_decontamination(docs, bench).collect()} == want and want
    small = decontamination.find_contaminated(docs, bench, block_shingles=200)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "The QUICK brown fox jumps over the lazy dog and"), (3, "un été"), (4, "alpha beta gamma delta alpha beta")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.op4_decontamination(odd, odd_items).collect()) == [(0, 3), (4, 3), (5, 4)]
    assert decontamination.drop_contaminated(odd, odd_items).count() == odd.count() - 3
    assert decontamination.op4_decontamination(docs, odd_items.limit(0)).count() == 0 and decontamination.op4_decontamination(empty, bench).count() == 0


# 5


def test_op5(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op5_language_id(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    f = language_id.learn(df)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, f).collect()}
    assert [rows[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and rows[6][0] == "fr"
    assert language_id.op5_language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit([])).collect()} == {"und"}


def test_op5_labels_switching_words():
    f = language_id.fit([("de", "der die und nicht ein schön haus " * 30), ("en", "the and of this house is nice " * 30)])
    p, _ = f.label_words([("the house is nice " * 5 + "und das haus nicht schön " * 5).split()])
    assert f.labels == ["de", "en"] and (p[:15, 1] > 0.5).all() and (p[-15:, 0] > 0.5).all()


def test_op5_reads_all_of_a_long_word():
    """Without spaces, too, a text is judged from all of its characters."""
    rnd = random.Random(3)
    joined = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    fitted = language_id.fit([("aa", joined("abcde", 400)) for _ in range(20)] + [("zz", joined("vwxyz", 400)) for _ in range(20)])
    ends = joined("abcde", 40), joined("abcde", 40)
    (label, score), (other, _) = fitted.predict([ends[0] + joined("vwxyz", 4000) + ends[1], ends[0] + ends[1]])
    assert label == "zz" and 0.9 < score < 1 and other == "aa"
    assert language_id.items("Short " + "x" * 95 + ".") == ["short", "x" * 40, "x" * 40, "x" * 15]


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(3)
    s, t = rnd.normal(size=(5, 3)), rnd.normal(size=(3, 3))
    import itertools

    z, want = 0.0, np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        w = math.exp(sum(s[i, y[i]] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4)))
        z += w
        for i in range(5):
            want[i, y[i]] += w
    assert np.allclose(language_id.marginals(s, np.array([5]), t), want / z)


# 6


def test_op6(docs, odd, empty):
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    e = token_counts.Encoder(open(args[0], "rb").read(), args[1])
    for df in (docs, odd):
        rows = token_counts.op6_token_counts(df, *args).collect()
        total = collections.Counter()
        for r in rows:
            total[r.doc_id] += r.n_tokens
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            want[r.doc_id] += len(e.encode(r.text or ""))
        assert total == want
    assert token_counts.op6_token_counts(empty, *args).count() == 0


def test_op6_rule():
    one = lambda *x: np.array(x)
    # Tokens [0,4) [4,6) [6,10); sections [0,5) [5,7) [8,9).
    assert token_counts.allocate(one(0, 4, 6), one(4, 6, 10), one(0, 5, 8), one(5, 7, 9)).tolist() == [0, 0, 1]
    assert token_counts.allocate(one(0, 2), one(2, 3), one(5), one(9)).tolist() == [-1, -1]
    e = token_counts.Encoder(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    a, b = e.spans("é🙂 x")
    assert a[0] == 0 and b[-1] == 4 and (b > a).all()


# 7


def test_op7(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = {tuple(r) for r in c.sql(chat_format.ORACLE).fetchall()}
    got = {tuple(r) for r in chat_format.op7_chat_format(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    assert got == want


def test_op7_odd_rows(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\n<|"), (1, 1, "assistant", None), (1, 1, None, "tie"), (None, None, "assistant", "<\\|x\\\\"), (2, 0, "ro\nle\\n", "t"), (2, 0, "ro\nle\\n", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.op7_chat_format(df).collect()}
    say = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == say(("user", "a\\<|im_end|>\n<|"), ("", "tie"), ("assistant", "")) and got[2].n_turns == 2
    assert got[2].turns_sha256 == say(*[("ro\nle\\n", "t")] * 2) and got[None].loss_chars == len("<\\|x\\\\") and got[-1].n_turns == 2
    assert chat_format.op7_chat_format(df.limit(0)).count() == 1


def test_op7_layouts(spark):
    rows = [
        (1, '{"prompt":"a","response":"b"}', "user:a assistant:b"),
        (2, '{"system":"s","prompt":"a","response":"b"}', "system:s user:a assistant:b"),
        (3, '{"instruction":"i","input":"x","output":"o"}', "user:i\n\nx assistant:o"),
        (4, '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null}]}', "user:x assistant:"),
        (5, '{"messages":[{"role":"user","content":"hi"}]}', "user:hi"),
        (6, '{"completion":"c","prompt":"p"}', "user:p assistant:c"),
        (7, '{"other":1}', ""),
        (8, None, ""),
        (9, "not json", ""),
    ]
    df = spark.createDataFrame([(i, 0, j) for i, j, _ in rows], "conv_id long, turn long, record string")
    got = collections.defaultdict(list)
    for r in chat_format.canonical_turns(df).where("layout IS NOT NULL").orderBy("conv_id", "seq").collect():
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert {i: " ".join(got[i]) for i, _, _ in rows} == {i: w for i, _, w in rows}


# 8

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def slow_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(int(c) * 2))) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_patterns():
    rnd = random.Random(9)
    parts = ["a", "@", ".", "-", "1", "25", "4111111111111111", " ", "+", "(", ")", "b.c", "x@y.z", "\n", "%", "300", "0.0", "é", "1.2.3.4"]
    for _ in range(20000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert personal_data.base_spans(t) == slow_spans(t), t


def test_op8(docs, odd, empty):
    for df in (docs, odd):
        want = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in slow_spans(r.text or "")).encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256) for r in personal_data.op8_personal_data(df).collect()) == want
    assert personal_data.op8_personal_data(empty).count() == 0
    clean = personal_data.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    said = {r.doc_id: r.text for r in clean.collect()}
    assert said[1] is None and said[0] == odd.where("doc_id = 0").first().text
    assert said[8] == "mail [EMAIL], call [PHONE], card [CARD], host [IP] or 999.1.1.1"


def test_op8_removes_what_reveals_an_entity(spark):
    rows = [(i, f"filler{i} words{i} then zorblax wrote from z@x.org some news{i} today") for i in range(5)]
    rows += [(10 + i, f"some plain text number{i} about news and words wrote from today") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.op8_personal_data(df).collect()}
    for i in range(5):
        named = [rows[i][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert "zorblax" in named and "wrote" not in named and f"words{i}" not in named
    assert all(got[10 + i].spans == "" for i in range(30))
    assert "zorblax" not in personal_data.sanitise(df).where("doc_id = 0").first().text


def test_op8_takes_told_terms_out_of_whole_texts(spark):
    """Terms far from the identifier are counted, and taken out wherever they stand, without the identifier too."""
    gap = [" ".join(f"{c}{i}word" for i in range(12)) for c in "abcdefgh"]
    told = [(i, f"Quimby {gap[i]} q@far.org {gap[i]} (Quimby) {gap[i]}") for i in range(4)]
    rest = [(4, f"{gap[4]} quimby, {gap[4]}"), (5, f"nothing {gap[5]}"), (6, f"quimbyx {gap[6]}")]
    df = spark.createDataFrame(told + rest, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in personal_data.sanitise(df).collect()}
    for i in range(4):
        assert clean[i] == f"[NAME] {gap[i]} [EMAIL] {gap[i]} ([NAME]) {gap[i]}"
    assert clean[4] == f"{gap[4]} [TERM], {gap[4]}"
    assert clean[5] == rest[1][1] and clean[6] == rest[2][1]
    n = {r.doc_id: r.n_term for r in personal_data.op8_personal_data(df).collect()}
    assert n == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 0, 6: 0}


def test_op8_counts_terms_with_other_spaces(spark):
    """Only ASCII spaces part words, in the corpus counts too."""
    seps = ["\xa0", "\u3000", "\u2009", "\x85", "\x1c", "\x1f"]
    for rows in (
        [(i, f"filler{i} M.\xa0Quimby q@far.org words{i} Quimby\xa0: more{i}") for i in range(4)],
        [(i, " ".join([f"filler{i}", *(f"zor{s}blax{k}" for k, s in enumerate(seps)), "q@far.org", f"words{i}"])) for i in range(4)],
    ):
        # Their parts as words of their own are other terms.
        rest = [(10 + i, f"m. quimby zor blax0 blax1 blax2 blax3 blax4 blax5 plain{i}") for i in range(30)]
        df = spark.createDataFrame(rows + rest, "doc_id long, text string")
        clean = {r.doc_id: r.text for r in personal_data.sanitise(df).collect()}
        for i in range(4):
            assert "quimby" not in clean[i].lower() and "blax" not in clean[i]
        assert all(clean[i] == t for i, t in rest)


# 9


def test_op9(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, words(r.text)) for r in df.select("doc_id", "text").collect()]
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = collections.Counter(w for i, ws in rows if not out(i) for w in [*ws, None])
        n, v = sum(c.values()), len(c)
        want = sorted((-1 if i is None else i, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 5)) for i, ws in rows)
        scored = maxent_lm.op9_maxent_lm(df).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scored)
        assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
        assert all(r.score < 0 for r in scored)
    assert maxent_lm.op9_maxent_lm(empty).count() == 0


def test_op9_rare_tokens_are_joined(docs):
    rows = docs.select("doc_id", "text")
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6))
    held = F.col("doc_id") % 5 == 0
    a = maxent_lm.score_documents(rows, held, head_share=0.5)
    b = maxent_lm.score_documents(rows, held, head_share=0.0)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_op9_learns_from_the_history(spark):
    rnd = random.Random(1)
    sides = (["uno", "dos", "tres", "gato"], ["one", "two", "three", "cat"])
    rows = [(i, " ".join(rnd.choice(sides[i % 2]) for _ in range(40))) for i in range(400)]
    got = maxent_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 1, rounds=4).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 20


def walked_weights(rows, counts, walk_bytes, rate=0.2):
    """One pass of the training in plain loops, from walks of rows (hash, text)."""
    m = maxent_lm
    bias = np.log([sum(c for w, c in counts.items() if m.class_of(w) == k) + 0.5 for k in range(m.CLASSES)])
    weights = collections.defaultdict(lambda: np.zeros(m.CLASSES), {0: bias - bias.mean()})
    walks = -(-sum(len(t) + 1 for _, t in rows) // walk_bytes)
    early = -(-walks // 8)
    for which in (range(early), range(early, walks)):
        moved, total = collections.defaultdict(lambda: np.zeros(m.CLASSES)), collections.Counter()
        for walk in which:
            texts = [m.tokens_of(t) for h, t in sorted(rows) if h % walks == walk]
            if not texts:
                continue
            feats, gold = m.inputs(texts)
            feats = [[0, *f] for f in feats.tolist()]
            w, squares = {k: v.copy() for k, v in weights.items()}, {}
            for at in range(0, len(gold), m.MINIBATCH):
                grads = collections.defaultdict(lambda: np.zeros(m.CLASSES))
                for fs, k in zip(feats[at : at + m.MINIBATCH], gold[at : at + m.MINIBATCH]):
                    e = np.exp(sum(w.get(f, 0) for f in fs) + np.zeros(m.CLASSES))
                    for f in fs:
                        grads[f] += (np.arange(m.CLASSES) == k) - e / e.sum()
                for f, g in grads.items():
                    squares[f] = squares.get(f, 0) + g * g
                    w[f] = w.get(f, 0) + rate * g / np.sqrt(squares[f] + 1)
            seen = collections.Counter(f for fs in feats for f in fs)
            total.update(seen)
            for f, n in seen.items():
                moved[f] += (w[f] - weights[f]) * n
        for f, n in total.items():
            weights[f] = weights[f] + moved[f] / n
    return weights


def test_op9_score_is_that_of_plain_loops_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "MINIBATCH", 150)
    rnd = random.Random(5)
    said = ["der", "hund", "bellt", "laut.", "one", "two", "cats", "sleeping", "Now", "là"]
    rows = [(i, " ".join(rnd.choice(said[i % 2 * 5 :][:5]) for _ in range(rnd.randrange(60)))) for i in range(200)] + [(7, None), (7, ""), (None, "two cats"), (3, "one one"), (3, "one one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    hashes = df.where(~held).select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.coalesce("text", F.lit("")).alias("t")).collect()
    learn = [(r.h, r.t.encode()) for r in hashes]
    counts = collections.Counter(w for _, t in learn for w in maxent_lm.tokens_of(t))
    weights = walked_weights(learn, counts, 2_000)
    size = [[f(c for w, c in counts.items() if maxent_lm.class_of(w) == k) for k in range(maxent_lm.CLASSES)] for f in (sum, lambda x: len(list(x)))]

    def score(text):
        tokens = maxent_lm.tokens_of((text or "").encode())
        feats, gold = maxent_lm.inputs([tokens])
        out = 0.0
        for fs, k, w in zip(feats.tolist(), gold.tolist(), tokens):
            z = sum(weights[f] for f in [0, *fs])
            out += (z[k] - np.log(np.exp(z).sum())) / math.log(10) + math.log10((counts[w] + 0.5) / (size[0][k] + 0.5 * (size[1][k] + 1)))
        return out

    want = sorted((-1 if i is None else i, score(t)) for i, t in rows)
    for n in (1, 4, 64):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in maxent_lm.score_documents(df.repartition(n), held, walk_bytes=2_000).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=1e-3)


def test_op9_classes_sum_to_one():
    rnd = np.random.default_rng(0)
    w = rnd.normal(size=(maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    feats, gold = maxent_lm.inputs([maxent_lm.tokens_of(b"a b c"), maxent_lm.tokens_of(b"")])
    assert np.allclose(np.exp(maxent_lm.class_logs(feats, w)).sum(axis=1), 1, atol=1e-5) and gold.tolist()[-1] == 0


# 10


def smallest_capacity(sizes, k):
    def fits(c):
        n, used = 1, 0
        for x in sizes:
            if used + x > c:
                n, used = n + 1, 0
            used += x
        return n <= k

    lo, hi = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def check_shards(df):
    rows = df.select("doc_id", "text").collect()
    got = sharding.op10_sharding(df).collect()
    sizes = collections.Counter()
    for r in rows:
        raw = (r.text or "").encode()
        sizes[hashlib.md5(raw).hexdigest()] += len(raw) + 1
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(load.values()) == smallest_capacity([sizes[k] for k in sorted(sizes)], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(16))
    crc = {(r.doc_id, r.text_crc32) for r in got}
    assert crc == {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows}
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_op10(spark, docs, odd, empty):
    check_shards(docs)
    check_shards(odd)
    rnd = random.Random(4)
    rows = [(i, f"w{rnd.randint(0, 50)} " * rnd.randint(0, 30) if rnd.random() < 0.6 else "hot") for i in range(800)]
    check_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sharding.op10_sharding(empty).count() == 0
