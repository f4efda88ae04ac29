"""Exact dedup, SimHash near-dedup, connected components and line dedup."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lotlens.llm import exact_dedup as ed
from lotlens.llm import line_dedup as ld
from lotlens.llm import simhash as sh
from lotlens.llm.components import components

LONG = "word " * 60_000
DOCS = [(1, "a b c", "x"), (7, "a b c", "y"), (3, "a b c", None), (None, "a b c", "z"), (4, None, "x"), (5, "", "x"),
        (6, "  ", "x"), (8, LONG, "x"), (9, LONG, "x"), (9, LONG, "x"), (None, "alone", "x"), (10, "a b c ", "x"),
        (11, "é\n", "x"), (None, "two nulls", "x"), (None, "two nulls", "x")]


def docs_frame(spark, rows=DOCS):
    # columns that clash with names used inside the operators
    return spark.createDataFrame([(a, b, c, 1, "k", 2) for a, b, c in rows],
                                 "doc_id long, text string, owner string, kept int, _key string, u int")


def union_find(n):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x
    return p, find


# ---- radix trie and exact dedup

@given(st.lists(st.binary(max_size=6), max_size=40))
@settings(max_examples=150, deadline=None)
def test_trie_holds_what_a_dict_holds(keys):
    trie, want = ed.RadixTrie(), {}
    for i, k in enumerate(keys):
        trie.insert(k, i, 1, 0)
        want[k] = [i, want.get(k, [0, 0])[1] + 1]
    assert {k: t[:2] for k, t in trie.items()} == want


@given(st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_spilled_subtrees_and_the_rest_hold_every_key_once(keys):
    trie, out = ed.RadixTrie(), []
    for k in keys:
        trie.insert(k, 1, 1, 0)
    while trie.weight:
        out += [k for k, _ in trie.pop_heaviest()]
    assert sorted(out) == sorted(set(keys)) and trie.bytes == 0 and not list(trie.items())


def exact_want(rows, keep="largest"):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        owner = (max if keep == "largest" else min)(real) if real else None
        left = 1
        for i in ids:
            kept = i == owner and left > 0
            left -= kept
            out.append((i, owner, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("memory", [1, 48 << 20])  # 1 byte: every insertion spills
def test_exact_dedup(spark, keep, memory):
    got = ed.exact_dedup(docs_frame(spark).repartition(5), keep=keep, memory_bytes=memory).collect()
    assert sorted(map(tuple, got), key=str) == exact_want(DOCS, keep)


def test_exact_dedup_of_an_empty_table(spark):
    assert ed.exact_dedup(docs_frame(spark, [])).collect() == []


def test_exact_dedup_of_a_hot_text_over_many_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", "") for i in range(3000)]
    got = ed.exact_dedup(docs_frame(spark, rows).repartition(11)).collect()
    assert sorted(map(tuple, got), key=str) == exact_want(rows)


# ---- components

def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    nodes = sorted({x for e in edges for x in e})
    p, find = union_find(1200)
    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    want = {n: find(n) for n in nodes if find(n) != n}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- SimHash

def naive_fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB \n\t\x0bé\xa0", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == naive_fingerprint(text) == sh.fingerprint(text.encode(), chunk=3)


def test_pivot_table_gives_the_distances_inside_blocks():
    fps = np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64)
    inner = sh.inner_coordinates(sh.distances(fps))
    for n, fp in enumerate(fps):
        for b in range(sh.BLOCKS):
            byte = int(fp) >> (8 * b) & 0xFF
            assert [int(x) for x in inner[n, b]] == [(byte ^ q).bit_count() for q in sh._walsh()]
    assert len({tuple(sh.inner_coordinates(sh.distances(np.array([x], np.uint64)))[0, 0]) for x in range(256)}) == 256


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, bits):
    rng = random.Random(bits)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(12):
            fps.add(seed)
            seed ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
    fps = sorted(fps)
    p, find = union_find(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                p[find(i)] = find(j)
    want = defaultdict(set)
    for i, f in enumerate(fps):
        want[find(i)].add(f)
    rows = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "id long, fp long")
    got = defaultdict(set)
    low = {}
    for r in sh.simhash_components(rows, "id", "fp", bits).collect():
        got[r.component_fp].add(r.fp % 2**64)
        low[r.component_fp] = r.component_id
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(low[root] == min(fps.index(f) for f in members) for root, members in got.items())


def test_simhash_dedup_defined_cases(spark):
    got = [r for r in sh.simhash_dedup(docs_frame(spark)).collect()]
    assert len(got) == len(DOCS)
    want = {t: f"{naive_fingerprint(t):016x}" for _, t, _ in DOCS}
    by_fp = defaultdict(list)
    for i, t, _ in DOCS:
        by_fp[want[t]].append(i)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), want[t]) for i, t, _ in DOCS)
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {4}  # null, empty and blank texts
    alone = [r for r in got if r.fingerprint == want["two nulls"]]
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)] * 2
    assert sh.simhash_dedup(docs_frame(spark, [])).collect() == []


# ---- line dedup

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@given(st.text(alphabet="ab", max_size=9), st.text(alphabet="ab", max_size=9), st.integers(0, 4))
@settings(max_examples=500, deadline=None)
def test_banded_distance(a, b, k):
    assert ld.within(a, b, k) == (distance(a, b) <= k)


@given(st.text(alphabet="ab", min_size=4, max_size=12), st.text(alphabet="ab", min_size=4, max_size=12))
@settings(max_examples=400, deadline=None)
def test_segments_find_every_pair_within_the_threshold(a, b):
    k = 2
    if distance(a, b) > k:
        return
    a, b = sorted((a, b), key=len)
    own = {(len(a), i, a[p:p + n]) for i, (p, n) in enumerate(ld.segments(len(a), k + 1))}
    other = {(n, i, b[p:p + size]) for n, i, p, size in ld.probes(len(b), k)}
    other |= {(len(b), i, b[p:p + n]) for i, (p, n) in enumerate(ld.segments(len(b), k + 1))}
    assert own & other


def lines_want(rows, k, min_chars):
    occ = defaultdict(list)
    for row, (i, t, _) in enumerate(rows):
        for n, line in ld.long_lines(t, min_chars):
            occ[line].append((i is None, i or 0, row, n))
    lines = sorted(occ, key=len)
    p, find = union_find(len(lines))
    links = defaultdict(int)
    for i in range(len(lines)):
        for j in range(i):
            if ld.within(lines[i], lines[j], k):  # itself tested against the plain table above
                p[find(i)] = find(j)
                links[lines[i]] += 1
                links[lines[j]] += 1
    classes = defaultdict(list)
    for i, line in enumerate(lines):
        classes[find(i)] += occ[line]
    drops = defaultdict(list)
    for places in classes.values():
        for _, _, row, n in sorted(places)[1:]:
            drops[row].append(n)
    return [(i, 0 if t is None else t.count("\n") + 1, sum(links[x] for _, x in ld.long_lines(t, min_chars)), sorted(drops[row]))
            for row, (i, t, _) in enumerate(rows)]


def line_docs():
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdeé ", k=rng.randint(8, 40))).strip() for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s))
                s[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(s))
        rows.append((i, "\n".join(lines), ""))
    return rows + [(None, base[0] + "\n" + base[0], ""), (50, None, ""), (51, "", ""), (52, LONG, ""), (53, LONG, "")]


@pytest.mark.parametrize("k", [1, 2])
def test_line_dedup(spark, k):
    rows = line_docs()
    got = ld.line_dedup(docs_frame(spark, rows).coalesce(1), threshold=k, min_chars=8).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_links, r.dropped) for r in got), key=str) == sorted(lines_want(rows, k, 8), key=str)
    assert all(r.n_dropped == len(r.dropped) for r in got)


def short_want(rows, k=2, min_chars=24):
    """(id, n_links, dropped) with every line that is not blank: full edits from
    ``min_chars`` signs on, their share below."""
    occ = defaultdict(list)
    for row, (i, t, *_) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                occ[line.strip()].append((i is None, i or 0, row, n))
    lines = sorted(occ, key=len)
    p, find = union_find(len(lines))
    links = defaultdict(int)
    for i, a in enumerate(lines):
        edits = min(k, k * len(a) // min_chars)  # the later ones are as long or longer
        for j in range(i + 1, len(lines) if edits else 0):
            if len(lines[j]) - len(a) > edits:
                break
            if ld.within(a, lines[j], edits):
                p[find(i)] = find(j)
                links[a] += 1
                links[lines[j]] += 1
    classes = defaultdict(list)
    for i, line in enumerate(lines):
        classes[find(i)] += occ[line]
    drops, n_links = defaultdict(list), defaultdict(int)
    for line, places in occ.items():
        for _, _, row, _ in places:
            n_links[row] += links[line]
    for places in classes.values():
        for _, _, row, n in sorted(places)[1:]:
            drops[row].append(n)
    return [(i, n_links[row], sorted(drops[row])) for row, (i, *_) in enumerate(rows)]


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "All rights reserved.\nOf.\n \na\nHe said.", ""), (2, " All rights reserved.\nOf.\n\na\nShe said.", ""),
            (3, "All rights reserve.\nIf.\n\nb\nAll right reserve.", "")]
    got = {r.doc_id: (r.n_links, r.dropped) for r in ld.line_dedup(docs_frame(spark, rows)).collect()}
    assert got == {1: (1, []), 2: (1, [0, 1, 3]), 3: (3, [0, 4])}


def test_short_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 27))) for _ in range(40)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 8)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s) + 1)
                s[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(s))
        rows.append((i, "\n".join(lines), ""))
    for k, least in ((2, 24), (3, 12), (1, 5)):
        got = ld.line_dedup(docs_frame(spark, rows).coalesce(1), threshold=k, min_chars=least).collect()
        assert sorted((r.doc_id, r.n_links, r.dropped) for r in got) == short_want(rows, k, least)


def test_line_links_lists_each_pair_once(spark):
    lines = ["the quick brown fox jumps", "the quick brown fox jumped", "the quick brown fix jumps", "something else entirely"]
    got = ld.line_links(spark.createDataFrame([(x,) for x in lines * 3], "t string"), 2, 8).collect()
    want = {frozenset(map(ld._line_id, (a, b))) for a in lines for b in lines if a < b and distance(a, b) <= 2}
    assert len(got) == len(want) and {frozenset((bytes(r.u), bytes(r.v))) for r in got} == want


@pytest.mark.parametrize("block", [2, 3, 7])
def test_large_groups_are_compared_block_by_block(spark, block):
    # a template with a serial number: all lines share their first segments
    rng = random.Random(block)
    lines = sorted({f"a line that starts alike for everyone number {rng.randrange(2000):04d}" for _ in range(90)})
    frame = spark.createDataFrame([(x,) for x in lines], "t string").repartition(3)
    got = ld.line_links(frame, 2, 8, block_rows=block).collect()
    want = {frozenset(map(ld._line_id, (a, b))) for a in lines for b in lines if a < b and ld.within(a, b, 2)}
    assert len(want) > 300
    assert len(got) == len(want) and {frozenset((bytes(r.u), bytes(r.v))) for r in got} == want


def test_blocks_of_one_key_across_batches():
    import pyarrow as pa
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 4, 60))
    ids, mark = rng.permutation(60), np.zeros(60, np.int64)
    for size, block in ((1, 4), (7, 4), (60, 4), (13, 100)):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i:i + size]) for x in (keys, ids, mark)], names=["key", "id", "mark"])
                   for i in range(0, 60, size)]
        pairs, blocks = set(), defaultdict(lambda: defaultdict(set))
        for out in ld._candidates(1, block)(iter(batches)):
            for r in out.to_pylist():
                if r["key"] is None:
                    pairs.add((r["a"], r["b"]))
                else:
                    blocks[r["key"]][r["block"]].add(r["id"])
        for parts in blocks.values():
            assert all(len(x) <= block for x in parts.values())
            pairs |= {tuple(sorted((x, y))) for i in parts for j in parts if i < j for x in parts[i] for y in parts[j]}
        want = {tuple(sorted((int(a), int(b)))) for k in range(4) for a in ids[keys == k] for b in ids[keys == k] if a != b}
        assert pairs == want


def test_line_dedup_of_an_empty_table_and_removal(spark):
    assert ld.line_dedup(docs_frame(spark, [])).collect() == []
    from pyspark.sql import functions as F
    row = spark.range(1).select(ld.without_lines(F.lit("a\nb\n\nc"), F.array(F.lit(1), F.lit(3)))).first()
    assert row[0] == "a\n"
