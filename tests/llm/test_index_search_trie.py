"""Positional index, lexical search and prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexfit.llm import decontamination, lexical_search, prefix_trie

ITEM = "item_id long, text string, doc_id long, terms string, rank int"
TURN = "conv_id long, turn long, role string, text string, depth long, k1 long, low string"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def benchmark_items(spark):
    def build(texts, ids=None):
        return spark.createDataFrame([(i if ids is None else ids[i], t, -1, "x", 0) for i, t in enumerate(texts)], ITEM)

    return build


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "Ärger", "x9"]) if rng.random() < 0.5 else f"t{rng.randint(0, 60)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(awkward):
    rng = random.Random(3)
    items = [None, "", " .,; ", "one", "The of", "x9 x9", sentence(rng, 9), sentence(rng, 10), "the " * 12, "naïve Straße"]
    items += [sentence(rng, rng.randint(11, 40)) for _ in range(12)]
    items.append(items[-1])
    texts = list(awkward)
    for _ in range(60):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items) or "").split(" ")
            a = rng.randint(0, max(0, len(words) - 8))
            parts.append(rng.choice([", ", " ", "\n"]).join(words[a : a + rng.randint(5, 30)]).upper())
        texts.append(rng.choice([" ", ". "]).join(parts))
    return texts + texts[-5:], items


def plain_report(texts, items, ids, size=10):
    windows = defaultdict(set)
    for item, text in zip(ids, items, strict=True):
        w = terms_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for text in texts:
        w, hit, found = terms_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= held
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("windows_a_round", [100_000, 40])
def test_decontamination_equals_brute_force(make, benchmark_items, corpus, windows_a_round):
    texts, items = corpus
    ids = [*range(len(items) - 3), 3, 3, None]
    rows = decontamination.report(make(texts), benchmark_items(items, ids), windows_a_round=windows_a_round)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r[0]: tuple(r[1:]) for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == plain_report(texts, items, ids)


def test_small_blocks_null_ids_and_nothing(spark, make, benchmark_items, corpus):
    texts, items = corpus
    index = decontamination.build_index(make(texts, ids=[None, *range(1, len(texts))]), block_bytes=500)
    assert index.count() > 20
    found = decontamination.find(index, benchmark_items(items))
    want = plain_report(texts, items, range(len(items)))
    assert sorted((r.n_words, len(r["items"])) for r in found.collect()) == sorted((w[0], w[2]) for w in want)
    none = make(["a b"]).limit(0)
    assert decontamination.report(none, benchmark_items(["a"])).count() == 0
    rows = decontamination.report(make(["a b", None]), benchmark_items(["a"]).limit(0)).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == [(0, 0, 0, False), (2, 0, 0, False)]


def test_proximity_equals_brute_force(make, benchmark_items, corpus):
    texts, _ = corpus
    items, within = ["t1 of t2", "the Ärger x9 t5", "t7", "t9 t9 und", "zzz t1"], 6
    found = decontamination.find(decontamination.build_index(make(texts), 3000), benchmark_items(items), within=within)
    got = {r.doc_id: set(r.near_items) for r in found.collect()}
    for i, text in enumerate(texts):
        w = terms_of(text)
        want = {k for k, item in enumerate(items) if any(set(terms_of(item)) <= set(w[a : a + within]) for a in range(len(w)))}
        assert got[i] == want


def plain_search(texts, ids, items, k=10):
    docs = [Counter(terms_of(t)) for t in texts]
    n_docs, n_terms = sum(bool(d) for d in docs), sum(sum(d.values()) for d in docs)
    df = Counter(t for d in docs for t in d)
    out = []
    for q, item in enumerate(items):
        scored = []
        for i, d in enumerate(docs):
            m = 10 + (90 * sum(d.values()) * n_docs) // max(n_terms, 1)
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((10**9 * d[t]) // (1000 * d[t] + 8 * m)) for t in set(terms_of(item)) if d[t])
            if score > 0:
                scored.append((-score, ids[i] is None, ids[i] or 0))
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("terms_a_block", [200_000, 30])
def test_search_equals_brute_force(make, benchmark_items, corpus, terms_a_block):
    texts, items = corpus
    rng = random.Random(9)
    ids = rng.sample(range(1000), len(texts) - 2) + [None, 5]
    rows = lexical_search.search(make(texts, ids=ids), benchmark_items(items), terms_a_block=terms_a_block)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[:2]) == plain_search(texts, ids, items)


def test_search_of_one_long_and_many_equal_documents(make, benchmark_items):
    long = " ".join(f"w{i % 9000}" for i in range(40000))  # more terms than coordinates
    texts = [long, *["alpha beta"] * 30, "beta", "alpha alpha w5", None]
    items = ["alpha w5 w17", "beta", "nowhere"]
    rows = lexical_search.search(make(texts), benchmark_items(items), k=4).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[:2]) == plain_search(texts, list(range(len(texts))), items, 4)


def test_bounds_are_never_below_scores(make, benchmark_items, corpus):
    texts, items = corpus
    rows = lexical_search.build_sketches(make(texts)).where("n > 0").toArrow()
    own = lexical_search.Queries([sorted({int(x) for x in r}) for r in (q["terms"] for q in lexical_search.query_terms(benchmark_items(items)).collect())])
    own.weigh(np.full(len(own.terms), 2), 70)
    batch = rows.combine_chunks().to_batches()[0]
    m = np.full(batch.num_rows, 100)
    until, ends = lexical_search.ends_of(batch.column("coordinates"), 2), lexical_search.ends_of(batch.column("terms"), 8)
    owner = np.repeat(np.arange(len(m)), np.diff(until, prepend=0))
    bounds = lexical_search.upper_bounds(own, lexical_search.values_of(batch.column("coordinates"), "<u2"), lexical_search.values_of(batch.column("maxima"), "<u4"), owner, m)
    terms, counts = lexical_search.values_of(batch.column("terms"), "<u8"), lexical_search.values_of(batch.column("counts"), "<u4")
    for q, bound in enumerate(bounds):
        for d, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            assert bound[d] >= lexical_search.exact(own, q, terms[a:b], counts[a:b], 100)


def test_search_of_nothing(make, benchmark_items):
    assert lexical_search.search(make(["a"]).limit(0), benchmark_items(["a"])).count() == 0
    assert lexical_search.search(make(["a", None]), benchmark_items(["a"]).limit(0)).count() == 0
    assert lexical_search.search(make([None, "."]), benchmark_items(["a"])).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + ts[h:])
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = (len(nodes[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
    out = []
    for s, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], digest))
    return sorted(out, key=str)


def talk(rng):
    rows = [(None, 0, "user", "left out"), (100, None, None, None), (100, 3, "user", "Ünïcode"), (100, 3, "user", "Ünïcode"), (100, 3, "assistant", "b")]
    for c in [*range(0, 60), *range(200, 330), *range(350, 500)]:
        same = c % 3 == 0  # a third are copies
        for t in range(6 if same else rng.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if same or t < 2 else rng.choice(["a", "bb", "ccc", ""])))
    rows += [(700, t, "user", f"{t % 7}") for t in range(400)] + [(701, t, "user", f"{t % 7}") for t in range(390)]
    return [(*r, -1, -1, "x") for r in rows]


@pytest.mark.parametrize(("partitions", "chunk_turns"), [(1, 1 << 18), (1, 7), (23, 50)])
def test_trie_equals_brute_force(spark, monkeypatch, partitions, chunk_turns):
    rows = talk(random.Random(4))
    monkeypatch.setattr(prefix_trie.partial_nodes, "__defaults__", (chunk_turns,))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.trie(spark.createDataFrame(rows, TURN))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_trie([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([(1, 0, "user", "a", -1, -1, "x")], TURN).limit(0)
    assert prefix_trie.trie(none).count() == 0
    ids = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:3]  # no conversation 0: its first turn is lost
    rows = [(c, 0, "user", "a") for c in ids]
    got = prefix_trie.trie(spark.createDataFrame([(*r, -1, -1, "x") for r in rows], TURN)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)
    assert [(r.depth, r.n_convs) for r in got] == [(0, 3)]


def test_extents_and_minima_equal_scans():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        shared = rng.integers(0, 4, n)
        shared[0] = 0
        table = prefix_trie.sparse_table(shared)
        row, depth = np.repeat(np.arange(n), 3), np.tile([1, 2, 3], n)
        left, right = prefix_trie.extents(table, row, depth)
        for i, d, a, b in zip(row, depth, left, right, strict=True):
            assert all(shared[a + 1 : i + 1] >= d) and (a == 0 or shared[a] < d)
            assert all(shared[i + 1 : b] >= d) and (b == n or shared[b] < d)
        assert prefix_trie.range_minimum(table, left, right).tolist() == [shared[a:b].min() for a, b in zip(left, right, strict=True)]
