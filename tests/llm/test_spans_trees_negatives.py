"""Substring dedup, the Merkle manifest and hard negatives."""
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotlens.llm import hard_negatives as hn
from lotlens.llm import merkle
from lotlens.llm import substring_dedup as sd

# ---- substring dedup


def spans_want(rows, window):
    """(id, n_words, n_removed, sha) by comparing every window with every other."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    places = defaultdict(list)
    for i, words in docs:
        for s in range(len(words) - window + 1):
            places[tuple(words[s:s + window])].append((i is None, i or 0, s))
    out = []
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if (i is None, i or 0, s) > min(places[tuple(words[s:s + window])]):
                gone.update(range(s, s + window))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spans_got(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, "k", 1, "h") for i, t in rows],
                                  "doc_id long, text string, _key string, hits int, sha string")
    out = sd.repeated_spans(frame, **how)
    assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
    got = out.collect()
    assert all(sum(s.b - s.a for s in r.spans) == r.n_removed for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(6, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared)[rng.randrange(4):] if rng.random() < 0.6 else \
                [f"u{rng.randrange(300)}" for _ in range(rng.randint(1, 25))]
            if words and rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed, window, block", [(1, 8, 1024), (2, 5, 16), (3, 20, 40), (4, 3, 1024)])
def test_spans_against_brute_force(spark, seed, window, block):
    rows = passages(seed)
    want = spans_want(rows, window)
    assert sum(w[2] for w in want) > 100
    assert spans_got(spark, rows, window=window, block=block) == want


def test_spans_of_odd_rows(spark):
    long = " ".join(f"w{j % 700}" for j in range(30_000))  # repeats itself
    a = " ".join(f"a{j}" for j in range(30))
    rows = [(1, a), (2, a), (2, a), (2, "x " + a), (None, a), (None, "tail " + a + " tail"), (3, None), (4, ""),
            (5, " \n\t"), (6, long), (7, long + " end"), (8, "same " * 500), (9, "é ü " * 25), (9, a.upper()),
            (10, "b" * 100_000), (11, ("b" * 2000 + " ") * 30), (12, "\x1c\x85 " * 21)]
    assert spans_got(spark, rows) == spans_want(rows, 20)
    assert spans_got(spark, []) == []


def test_every_window_is_checked_though_no_factor_is_long(spark):
    # each window of the last text starts in one text and ends in another
    rng = random.Random(7)
    words = [f"w{j}" for j in range(200)]
    rows = [(i, " ".join(words[s:s + 10])) for i, s in enumerate(rng.sample(range(190), 60))] + [(99, " ".join(words))]
    rows += [(100, " ".join(words[50:150])), (101, "x " + " ".join(words[100:]))]
    assert spans_got(spark, rows, window=10, block=12) == spans_want(rows, 10)


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 12))
@settings(max_examples=80, deadline=None)
def test_anchors_depend_on_the_window_alone(words, window):
    h = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, value = sd.selected(h, window)
    of = {}
    for s in range(len(at)):
        assert of.setdefault(tuple(words[s:s + window]), (at[s] - s, value[s])) == (at[s] - s, value[s])
    places, _, low, high = sd.anchors_of(h, np.array([len(h)]), window)
    assert [p for p, lo, hi in zip(places, low, high) for _ in range(lo, hi + 1)] == list(at)


def test_factors_are_greedy_and_reach_as_far_as_words_agree():
    words, ref = np.array([9, 1, 2, 3, 4, 5, 7, 1, 2], np.uint64), np.array([1, 2, 3, 4, 5, 6], np.uint64)
    at, ref_at = np.array([102, 104, 107]), np.array([11, 13, 10])
    for earlier in (True, False):
        got = sd.factors(words, 100, ref, 10, at, ref_at, at, at + 2, np.full(3, earlier))
        assert list(got) == [(0, 2, 101, 106), (2, 3, 107, 109)]
    # an anchor of another offset whose windows lie inside the last factor is passed over
    at, ref_at = np.array([102, 103, 107]), np.array([11, 15, 10])
    got = [list(sd.factors(words, 100, ref, 10, at, ref_at, at, at + 2, np.full(3, e))) for e in (True, False)]
    assert got == [[(0, 2, 101, 106), (2, 3, 107, 109)], [(0, 1, 101, 106), (1, 2, 103, 103), (2, 3, 107, 109)]]


def test_word_hashes_of_texts_at_once():
    rng = random.Random(3)
    words = [b"a", b"b" * 64, b"c" * 65, "é".encode(), b"\x1c\x85", b"d" * 300_000, b"\xff\xfe", b"x" * 90_000]
    texts = [b"".join(rng.choice(words) + rng.choice([b" ", b"\n", b"\t\r", b"\v \f"]) for _ in range(n)) for n in (0, 1, 9, 40, 0, 3)]
    texts += [b"", b" \n", b" lead", b"e" * 600_000, b" ".join(b"w%d" % i for i in range(90_000))]
    h, counts = sd.hash_texts(texts)
    flat = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    of = dict(zip(flat, h.tolist()))
    assert [of[w] for w in flat] == h.tolist() and len(set(of.values())) == len(of)
    for t, start in zip(texts, np.cumsum(counts) - counts):
        assert sd.hash_texts([t])[0].tolist() == h[start:start + len(t.split())].tolist()


# ---- Merkle manifest

def H(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def field(v):
    return b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()


def tree_levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def manifest_want(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, H(b"".join(map(field, r))), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree_levels([x[2] for x in by[s]], fanout)
    top, out = tree_levels([trees[s][-1][0] for s in order], fanout), []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(by[s]):
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                folded = H(b"".join(map(field, (*r[:4], low))))
            beside = ""
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    first = at // fanout * fanout
                    run = level[first:first + fanout]
                    beside += "".join(x for j, x in enumerate(run) if first + j != at)
                    folded = H("".join(folded if first + j == at else x for j, x in enumerate(run)))
                    at //= fanout
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H(beside), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest_got(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows],
                                  "doc_id long, source string, lang string, n_chars long, text string, tree string, place int")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = merkle.merkle_manifest(merkle.document_leaves(frame, tampered), **how).collect()
    for r in got:
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.witness)).hex() == r.root
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


def manifest_rows(n, sources, seed=1):
    rng = random.Random(seed)
    names = [None, "", "é", "Z", *(f"s{i}" for i in range(sources))]
    rows = [(i, "s0" if rng.random() < 0.4 else rng.choice(names), rng.choice(["en", None]), rng.choice([None, 5]),
             rng.choice(["Some Text", "no capitals", None, "", "ÉA"])) for i in range(n)]
    return rows + [rows[-1], rows[-1], (None, "s0", None, None, None), (None, "s0", "en", 1, "X"), (None, None, None, None, None)]


@pytest.mark.parametrize("n, sources, fanout, height", [(1, 0, 16, 3), (300, 5, 16, 3), (300, 40, 2, 2), (400, 3, 3, 1), (290, 30, 16, 1)])
def test_manifest_against_brute_force(spark, n, sources, fanout, height):
    rows = manifest_rows(n, sources)
    assert manifest_got(spark, rows, fanout=fanout, height=height) == manifest_want(rows, fanout)


def test_manifest_of_few_and_no_rows(spark):
    one = [(5, "s", "en", 1, "Abc")]
    assert manifest_got(spark, one) == manifest_want(one)
    assert manifest_got(spark, one)[0][4] == H("")  # a lone leaf is the root and has no siblings
    assert manifest_got(spark, []) == []


@given(st.integers(1, 90), st.integers(2, 5))
@settings(max_examples=60, deadline=None)
def test_streaming_append_of_a_whole_tree(n, fanout):
    nodes = [bytes([i]) * 32 for i in range(n)]
    tree = merkle.OpenTree(fanout, 9)
    for d in nodes:
        tree.append(d)
    root = tree.finish(True)
    assert [[d.hex() for d in level] for level in tree.levels] == tree_levels([d.hex() for d in nodes], fanout)
    for i, d in enumerate(nodes):
        assert merkle.fold(d, merkle.in_block(tree.levels, i, fanout)) == root


# ---- hard negatives

def negatives_want(rows):
    """rows: (id, vector, label)"""
    ok = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, la, va) in enumerate(ok):
        if a is None or a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, j, lab)
                        for j, (i, lab, v) in enumerate(ok) if j != k and len(v) == len(va))
        for p in [s for s in scored if s[4] == la][:5]:
            hard = [s for s in scored if s[4] != la and -30 * p[0] <= -100 * s[0] <= -90 * p[0]][:10]
            out += [(a, ok[p[3]][0], n + 1, ok[s[3]][0], -p[0], -s[0]) for n, s in enumerate(hard)]
    return sorted(out, key=str)


def negatives_got(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "vec_id long, embedding array<float>, label int, row int, part string")
    out = hn.hard_negatives(frame, F.col("id") % 100 == 0, **how)
    assert dict(out.dtypes)["rank"] == "int"
    return sorted(map(tuple, out.collect()), key=str)


def vectors(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim)) + 0.7
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        out.append((i * 10, [float(np.float32(x)) for x in centres[label] * 0.3 + rng.standard_normal(dim) * 0.2], label))
    return out


@pytest.mark.parametrize("seed, n, dim, row_block, query_block", [(1, 300, 16, 64, 8), (2, 200, 70, 8192, 128), (3, 150, 3, 20, 1)])
def test_negatives_against_brute_force(spark, seed, n, dim, row_block, query_block):
    rows = vectors(seed, n, dim)
    want = negatives_want(rows)
    assert len(want) > 50
    assert negatives_got(spark, rows, row_block=row_block, query_block=query_block) == want


def test_negatives_of_odd_rows(spark):
    base = vectors(5, 40, 4, 2)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [0.5, 0.5, 0.5, 0.5], 0), (None, [0.5, 0.5, 0.5, 0.5], 1), (100, [nan, 1.0, 1.0, 1.0], 0), (200, [inf, 1.0, 1.0, 1.0], 0),
           (300, None, 0), (200, [1.0, 1.0, 1.0, 1.0], None), (400, [None, 1.0, 1.0, 1.0], 0), (500, [], 0), (501, [], 1), (502, [], 0),
           (600, [0.3, 0.3], 1), (601, [0.3, 0.4], 1), (602, [0.2, 0.2], 0), (700, [0.0] * 4, 1), (-100, [0.4, 0.1, 0.2, 0.3], 0)]
    copies = [(k, [0.25, 0.5, 0.25, 0.5], k % 2) for k in range(800, 840)]  # ties
    rows = base + odd + copies + [copies[0], copies[0], base[0]]  # rows that repeat are rows
    assert negatives_got(spark, rows, row_block=16) == negatives_want(rows)
    assert negatives_got(spark, []) == []


@given(st.integers(1, 130), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_intervals_hold_every_score(dim, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-400, 400, (40, dim)) * rng.integers(0, 2, (40, dim))
    rows[0] = 0
    query = rows[int(rng.integers(40))]
    low, high = hn.intervals(query, *hn.encode(rows))
    scores = rows @ query
    assert (low <= scores).all() and (scores <= high).all()


def test_intervals_leave_out_rows_that_cannot_be_near():
    # vectors that are close to their codes have short intervals
    signs = np.random.default_rng(9).choice([-300, 300], (500, 64))
    rows = np.rint(signs @ hn.rotation(64).T).astype(np.int64)
    low, high = hn.intervals(rows[0], *hn.encode(rows))
    assert (high >= hn._kth(low, 1)).sum() == 1
    low, high = hn.intervals(rows[0] + rows[1], *hn.encode(rows))
    assert set(np.flatnonzero(high >= hn._kth(low, 2))) == {0, 1}
