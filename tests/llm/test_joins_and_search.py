"""Shingle join, repeated strings and Hamming search against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lexfit.llm import graph, hamming_search, jaccard_join, suffix_array, suffix_dedup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def plain_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(make, awkward):
    rng = random.Random(11)
    texts = list(awkward)
    passage = [f"shared{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{g}x{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 160))]
        texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(6)]
        texts.append(" ".join(passage + base[:10]))
    texts += [" ".join(f"c{k}" for k in range(i, i + 60)) for i in range(0, 40, 3)]  # a chain
    rows = {r.doc_id: r for r in jaccard_join.join(make(texts)).collect()}
    want = plain_components(texts)
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == want
    kept = {r.doc_id for r in jaccard_join.keep_first(make(texts)).collect()}
    assert kept == {c for _, c in want}


def test_join_of_nulls_repeats_and_nothing(make):
    text = "a b c d e f g h"
    rows = jaccard_join.join(make([text, text, text, None], ids=[None, 7, 7, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows) == [(-1, 4, None), (7, 4, 7), (7, 4, 7), (9, 0, 9)]
    assert jaccard_join.join(make([])).count() == 0
    assert jaccard_join.keep_first(make([text, None], ids=[None, None])).count() == 2


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: len(base) - int(rng.integers(0, 1 + len(base) // 6))], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(base) // 8)), dtype=np.uint64)])) for _ in range(3)]
    sizes, maps = np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets]
    every = np.arange(len(sets))
    i, j = np.repeat(every, len(every)), np.tile(every, len(every))
    maps = pa.array(maps, pa.binary())
    ok = jaccard_join.near_enough(sizes[i] + sizes[j], jaccard_join.differing_bits(maps, maps, i, j)) & (i != j)
    ok &= 100 * np.minimum(sizes[i], sizes[j]) >= 80 * np.maximum(sizes[i], sizes[j])
    got = set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    links = 0
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                assert (a, b) in got
    assert links > 50 and len(got) < 3 * links


def test_long_lists_meet_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[int(rng.integers(0, 90)) :], rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(120)]
    rows = [(7, 4, i % 50, i, len(s), 1 + i % 3, bytearray(jaccard_join.bitmap(s))) for i, s in enumerate(sets)]
    rows += [(9, 1, 1, 500, 3, 1, bytearray(jaccard_join.bitmap(base[:3])))]
    lists = spark.createDataFrame(rows, "shingle long, times long, component long, node long, n long, l int, bitmap binary")
    whole, cut = (sorted(map(tuple, jaccard_join.list_pairs(lists, block).collect())) for block in (1000, 9))
    assert whole == cut and len(whole) == len(set(whole)) > 100
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if a % 50 != b % 50 and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            assert (a, b, 4, min(1 + a % 3, 1 + b % 3)) in whole


def test_one_row_of_each_group_stays(spark):
    """Clashing column names, rows without an id, repeated rows and ids with several texts."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), edited(rng, base, 1), " ".join(base), "a b c d e f", "a b c d e f", None, "", "other words here", "other words here"]
    ids = [5, 3, None, None, None, 1, 1, 9, 9]
    names = "doc_id long, text string, _gone long, _doubtful string, component_id long, number long, row string, n long, `odd.name` long"
    rows = [(i, t, k, "d", -1, -2, "r", -3, -4) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, names)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=str)
    assert all(r in rows for r in got)
    assert sorted(r[2] for r in got if r[2] not in (3, 4, 7, 8)) == [1, 5, 6]
    assert len([r for r in got if r[2] in (3, 4)]) == 1 and len([r for r in got if r[2] in (7, 8)]) == 1 and len(got) == 5
    assert jaccard_join.keep_first(docs.limit(0)).count() == 0


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 1 << 16).astype(np.uint32)
    for _ in range(200):
        n = int(rng.integers(2, 120))
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            (la, pa), (lb, pb) = jaccard_join.prefix(a, counts, 20.0), jaccard_join.prefix(b, counts, 20.0)
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got) == 41 + 40 + 3
    assert all(c == (0 if n <= 40 else 100 if n < 200 else 200) for n, c in got.items())


def test_suffix_arrays_and_prefixes():
    rng = random.Random(3)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 60))] + [0]
        array = np.array(text)
        up, down = jaccard_join.powers(len(array) + 1)
        hashes = suffix_array.PrefixHash(jaccard_join.mix(array.astype(np.uint64) + np.uint64(1)), up[: len(array)], down)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        sa = suffix_array.suffix_array(array, 12, hashes)
        assert sa.tolist() == want and suffix_array.plain_suffix_array(text, 10) == want
        common = suffix_array.common_prefixes(array, sa, hashes, np.arange(len(array), 0, -1))
        for a, b in zip(want, want[1:], strict=False):
            size = next(k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1])
            assert common[b] == size


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(make, awkward):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(12) for _ in range(5)]
    texts = [t if len(t or "") < 1000 else t[:3000] for t in awkward]
    texts += [f"{text(20)} {rng.choice(passages)} {text(15)} {rng.choice(passages)}" for _ in range(40)]
    texts += ["ab" * 100, "x" * 150, "é" * 90, texts[-1], passages[0]]
    want = plain_removal(texts, 40)
    for group_max in (10_000, 2):
        rows = {r.doc_id: r for r in suffix_dedup.remove(make(texts), 40, 12, group_max).collect()}
        assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))] == want
    assert suffix_dedup.remove(make([])).count() == 0
    assert [r.n_removed for r in suffix_dedup.remove(make(["y" * 399, "z" * 401], ids=[None, None])).orderBy("n_bytes").collect()] == [0, 401]


def test_search_equals_brute_force(spark):
    rng = random.Random(13)
    vectors = [[rng.uniform(-1, 1) for _ in range(20)] for _ in range(150)]
    vectors += [vectors[0]] * 40 + [[v if rng.random() < 0.9 else -v for v in vectors[1]] for _ in range(20)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (901, [1.0], "x"), (None, vectors[3], "x"), (902, [None] * 20, "x"), (5, vectors[5], "x")]
    table = spark.createDataFrame(rows, "id long, vector array<double>, code string")
    found = hamming_search.search(table, table.where("id % 50 = 0"), 7).collect()
    usable = [(i, sum((x is not None and x > 0) << k for k, x in enumerate(v))) for i, v, _ in rows if i is not None and v is not None and len(v) == 20]
    for q, code in usable:
        if q % 50 == 0:
            want = sorted((bin(code ^ c).count("1"), i) for i, c in usable)[:7]
            got = sorted((r["rank"], r.distance, r.neighbour_id) for r in found if r.query_id == q)
            assert [x[1:] for x in got] == want and [x[0] for x in got] == list(range(1, 8))
    few = spark.createDataFrame(rows[:3], table.schema)
    assert hamming_search.search(few, few, 7).count() == 9
    assert hamming_search.search(few.limit(0), few.limit(0), 7).count() == 0


def test_parts_of_large_groups_equal_brute_force(make):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def near(passage):
        changed = passage.split()
        for _ in range(rng.randint(0, 4)):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        return " ".join(changed)

    passages = [text(30) for _ in range(4)]
    texts = [f"{text(rng.randint(0, 30))} {near(rng.choice(passages))} {text(15)} {near(rng.choice(passages))}" for _ in range(100)]
    texts += ["ab" * 300, "x" * 250, "é" * 90, None, "", texts[0], texts[0]]
    for length, gram, group_max in ((40, 12, 1), (100, 25, 6)):
        rows = {r.doc_id: r for r in suffix_dedup.remove(make(texts), length, gram, group_max).collect()}
        assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))] == plain_removal(texts, length)
