"""Prefix trie, SimHash trees and spelling variants against brute force, and on odd and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haltwise.llm import prefix_trie, simhash_trees, spelling
from haltwise.llm.common import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11


def order(turn, role, text):
    return (turn is not None, turn or 0, role or "", text or "")


def trie_by_hand(rows, rebuild):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role, text))
    convs = {c: [(role or "", text or "") for _, role, text in sorted(ts, key=lambda t: order(*t))] for c, ts in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:]) if rebuild else tuple(own)
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1].encode()) if p else 0
    ends = collections.defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), children[p], leaves[p], saved[p], digest(p)) for p, ms in members.items())


def nodes_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


def test_op11_on_conversations(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in c.collect()]
    assert nodes_of(prefix_trie.op11_prefix_trie(c)) == trie_by_hand(rows, True)


@pytest.mark.parametrize("seed", [1, 2])
def test_tries_of_random_conversations(spark, seed):
    """Few texts, so prefixes are shared; lengths around those of blocks; ids that begin with turns of others or of none."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3, 400), 120):
        n = rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 40])
        rows += [(c, k, rnd.choice(["user", "assistant"]) if k > 12 else "user", rnd.choice(["é", "bb"]) if k in (3, 8, 20, 39) else "a") for k in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    assert nodes_of(prefix_trie.trie_of(df)) == trie_by_hand(rows, False)
    assert nodes_of(prefix_trie.op11_prefix_trie(df)) == trie_by_hand(rows, True)


def test_trie_of_a_ladder(spark):
    """Each conversation leaves the one before a turn earlier: the tree of chains is as high as it gets."""
    rows = [(c, k, "user", "x" if k < 30 - c else f"{c}") for c in range(30) for k in range(32)]
    rows += [(c, k, "user", t) for c in range(100, 120) for k, t in enumerate([str(i) for i in range(c - 100)] + ["end"])]
    df = spark.createDataFrame(rows, TURNS)
    assert nodes_of(prefix_trie.trie_of(df)) == trie_by_hand(rows, False)


def test_trie_of_odd_rows(spark):
    long = "wort " * 50_000
    rows = [(7, None, "user", "a"), (7, 0, None, None), (7, 0, "user", "b"), (7, 0, "user", "b"), (7, 0, "assistant", "z"), (None, 0, "user", "lost"), (8, 5, "user", long), (8, None, None, "a"), (8, None, "b", "a")]
    rows += [(c, 0, "user", "same") for c in range(1000, 1300)] + [(5, 0, "user:", "x"), (6, 0, "user", ":x"), (5, 1, "", "ab"), (6, 1, "a", "b")]
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("x")).withColumn("block", F.lit("x")).withColumn("depth", F.lit(1)).withColumn("t1", F.lit(2))
    assert nodes_of(prefix_trie.trie_of(df)) == trie_by_hand(rows, False)
    assert nodes_of(prefix_trie.op11_prefix_trie(df)) == trie_by_hand(rows, True)
    assert prefix_trie.op11_prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.op11_prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_turns_of_nodes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.node_turns(prefix_trie.trie_of(df), prefix_trie.numbered_turns(df)).collect()
    assert {(r.conv_id, r.depth, r.role, r.text) for r in got} == {(1, 0, None, None), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 2, "assistant", "c")}


# 12


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components_by_hand(prints, radius):
    """Smallest id reachable of each row of (id, print)."""
    n = len(prints)
    p = np.array([x for _, x in prints], dtype=np.uint64)
    seen, out = [False] * n, [None] * n
    for i in range(n):
        if seen[i]:
            continue
        seen[i], part, todo = True, [], [i]
        while todo:
            k = todo.pop()
            part.append(k)
            for j in np.flatnonzero(np.bitwise_count(p ^ p[k]) <= radius).tolist():
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        ids = [prints[k][0] for k in part if prints[k][0] is not None]
        for k in part:
            out[k] = min(ids, default=None)
    return out


def test_op12(docs, odd, empty):
    for df in (docs, odd, odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") - 20))):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        prints = [(i, print_by_hand(t)) for i, t in rows]
        want = collections.Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, components_by_hand(prints, 3)))
        assert collections.Counter(tuple(r) for r in simhash_trees.op12_simhash(df).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash_trees.op12_simhash(empty).count() == 0


@pytest.mark.parametrize("shard", [4096, 7])
def test_links_of_clouds(spark, shard):
    """Dense clouds, walks of single bits, random points; with small shards trees are sent to each other."""
    rnd = random.Random(shard)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = rnd.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(150)}
    walk = rnd.getrandbits(64)
    for _ in range(60):
        walk ^= sum(1 << b for b in rnd.sample(range(64), 3))
        values.add(walk)
    values |= {0, 1, 0b1110, (1 << 64) - 1, (1 << 64) - 1 - (1 << 63)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    with Tables(spark) as tables:
        df = tables.write(spark.createDataFrame([(s,) for s in signed], "fp long"), "fp")
        comp = {r.node: r.comp for r in simhash_trees.components(simhash_trees.links(df, tables, 3, shard), tables).collect()}
    got = [comp.get(s, s) for s in signed]
    assert got == components_by_hand([(s, v) for s, v in zip(signed, values)], 3)


def test_trees_find_all_within_a_radius():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    p = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    rnd.shuffle(p)
    bounds = np.array([0, 1, 100, len(p)])
    forest = simhash_trees.Forest(p, bounds)
    queries, trees = np.concatenate([p, base ^ np.uint64(5)]), np.resize([0, 1, 2, 2], len(p) + 40)
    for radius in (0, 1, 3, 9):
        got = {(q, n) for qs, ns in forest.near(queries, trees, radius) for q, n in zip(qs.tolist(), ns.tolist())}
        want = {(q, n) for q, t in enumerate(trees) for n in range(bounds[t], bounds[t + 1]) if bin(int(queries[q] ^ p[n])).count("1") <= radius}
        assert got == want


# 13


def edits(w):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100))
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def variants_by_hand(rows, slip=199):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: sorted((edits(w) - {w}) & n.keys(), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 5 * n[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def variants_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_op13(spark, docs, odd, empty):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd.unionByName(odd).unionByName(odd)):
        want = variants_by_hand([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert variants_of(spelling.op13_spelling_variants(df)) == want
    assert spelling.op13_spelling_variants(empty).count() == 0


def test_variants_of_made_words(spark):
    """Edits at every place, around the cut between chunks, ties, chains of forms, doubled letters, signs between the letters."""
    rnd = random.Random(9)
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc", "abcxabc", "abxabc", "éàüöñß", "éàüöñßø", "ab×cde", "ab÷cde"]
    for w in ["farbton", "farbtonkarte", "weltall"]:
        words += [w, *rnd.sample(sorted(e for e in edits(w) if len(e) >= 6), 60)]
    rows = [(k, " ".join([w.upper() if k % 3 == 0 and w.isascii() else w] * rnd.choice([1, 4, 5, 25, 130, 700]))) for k, w in enumerate(words)]
    rows += [(1000 + k, "wortlaut" if k < 625 else "wortlauts" if k < 750 else "wortlautes" if k < 775 else "wortlautest") for k in range(780)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants_of(spelling.op13_spelling_variants(df))
    assert got == variants_by_hand(rows)
    assert ("wortlautest", "wortlautes", "wortlaut") in {r[:3] for r in got}
