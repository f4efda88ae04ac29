"""Language ID, PII, mixing."""
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotlens.llm import language_id as lid
from lotlens.llm import mixing, pii

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# ---- language ID

@given(st.text(max_size=40), st.integers(1, 7))
@settings(max_examples=100, deadline=None)
def test_grams_do_not_depend_on_chunks(text, chunk):
    assert np.array_equal(lid.gram_counts(text), lid.gram_counts(text, chunk))
    n = len(text.lower())
    assert lid.gram_counts(text).sum() == n + max(0, n - 1) + max(0, n - 2)


def test_document_frequencies_cover_all_rows(spark):
    rows = [(f"text {i % 7}",) for i in range(50)]
    df, n = lid.document_frequencies(spark.createDataFrame(rows, "t string").repartition(4))
    want = sum((lid.gram_counts(t) > 0).astype(int) for t, in rows)
    assert n == 50 and np.array_equal(df, want)


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=row) for row in p])
    assert abs(lid.temperature(3 * z, y) - 3) < 0.3
    assert lid.temperature(z[:0], y[:0]) == 1.0


def test_held_out_accuracy_and_sparsity(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lid.language_id(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert (lid.learn(docs).weights != 0).mean() < 0.2


def test_held_out_rows_and_other_columns_do_not_change_the_model(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(lid.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    other = other.withColumn("source", F.lit("s")).withColumn("score", F.lit("clash"))
    a, b = ({r.doc_id: tuple(r) for r in lid.language_id(d).collect()} for d in (docs, other))
    assert a == b


def plain_grams(text):
    """Hashed grams by their definition, one at a time."""
    found, x, m = {}, [ord(c) for c in text.lower()], 2 ** 32
    for i in range(len(x)):
        h = x[i] * 0x9E3779B1 % m
        for more, factor in ((0, None), (1, 0x85EBCA6B), (2, 0xC2B2AE35)):
            if i + more < len(x):
                h = h if factor is None else (h ^ x[i + more]) * factor % m
                found[h >> 16] = found.get(h >> 16, 0) + 1
    return found


def plain_language_id(rows, p):
    """(model's predict, temperature) of training rows (text, lang) in the order of the
    sample: dictionaries and loops, all grams of all rows."""
    labels = sorted({y for _, y in rows})
    df = {}
    for text, _ in rows:
        for g in plain_grams(text):
            df[g] = df.get(g, 0) + 1

    def features(text):
        x = {g: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df.get(g, 0))) + 1) for g, c in plain_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {**{g: v / norm for g, v in x.items()}, "bias": 1.0}
    z, n = {}, {}

    def weight(g, y):
        s = z.get((g, y), 0.0)
        if abs(s) <= p.l1:
            return 0.0
        return -(s - math.copysign(p.l1, s)) / ((p.beta + math.sqrt(n.get((g, y), 0.0))) / p.alpha + p.l2)

    def logits(x):
        return [sum(v * weight(g, y) for g, v in x.items()) for y in labels]

    def softmax(a):
        e = [math.exp(v - max(a)) for v in a]
        return [v / sum(e) for v in e]
    held = [(features(t), y) for i, (t, y) in enumerate(rows) if i % p.calibration_part == 0]
    for _ in range(p.passes):
        for i, (text, label) in enumerate(rows):
            if i % p.calibration_part:
                x = features(text)
                old = {(g, y): weight(g, y) for g in x for y in labels}
                prob = softmax(logits(x))
                for y, q in zip(labels, prob):
                    for g, v in x.items():
                        grad = v * (q - (y == label))
                        was = n.get((g, y), 0.0)
                        z[g, y] = z.get((g, y), 0.0) + grad - (math.sqrt(was + grad * grad) - math.sqrt(was)) / p.alpha * old[g, y]
                        n[g, y] = was + grad * grad
    scored = [(logits(x), labels.index(y)) for x, y in held]

    def loss(t):
        return sum(-math.log(max(softmax([v / t for v in a])[y], 1e-300)) for a, y in scored)
    t = min((0.05 * 400 ** (i / 3000) for i in range(3001)), key=loss)

    def predict(text):
        prob = softmax([v / t for v in logits(features(text))])
        best = max(range(len(labels)), key=lambda i: (prob[i], -i))
        return labels[best], prob[best]
    return predict, t


def test_language_id_against_plain_training_and_prediction(spark):
    rng = random.Random(7)
    words = {"fr": "le la une maison vendue près du château été forêt".split(),
             "en": "the a house sold near of castle summer wood and".split(),
             "de": "das ein Haus verkauft nahe Schloß Sommer Wald über und".split()}
    # a part of the words is of any language, so that the scores are not all certain
    mixed = sum(words.values(), [])
    rows = []
    for i in range(90):
        lang = rng.choice(sorted(words))
        text = " ".join(rng.choice(words[lang] if rng.random() < 0.6 else mixed) for _ in range(rng.randint(1, 9)))
        rows.append((i, text, lang if i % 11 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    params = lid.Params()
    known = docs.where(~lid.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    order = (known.withColumn("u", F.xxhash64("doc_id", "text")).orderBy("u", "text", "lang").collect())
    assert 40 < len(order) < 80
    predict, t = plain_language_id([(r.text, r.lang) for r in order], params)
    model = lid.learn(docs, p=params)
    assert model.labels == ["de", "en", "fr"] and abs(model.temperature / t - 1) < 0.01
    got = {r.doc_id: r for r in lid.language_id(docs, p=params).collect()}
    scores = []
    for i, text, _ in rows:
        lang, score = predict(text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 2e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        scores.append(score)
    assert min(scores) < 0.7 and max(scores) > 0.9


def test_language_id_defined_cases(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of it", "en"), (3, None, "en"), (4, "123 .!", "en"), (5, "", None),
            (None, "und das die", "de"), (6, "of the it and", "en"), (6, "of the it and", "en"), (7, "the " * 50_000, None)]
    got = lid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id != 7:
            assert r.lang_pred == ("de" if r.doc_id in (None, 1) else "en")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lid.language_id(df.limit(0)).collect() == []
    nothing = lid.language_id(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_sample_is_bounded_for_each_label(spark):
    rows = [(i, "same text", "en" if i % 3 else "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "_id long, _text string, _lang string")
    got = lid._sample(df, {"en": 2000, "de": 1000}, 50).groupBy("_lang").count().collect()
    assert {r["_lang"]: r["count"] for r in got} == {"en": 50, "de": 50}
    with pytest.raises(ValueError, match="labels"):
        lid.train_model(df, lid.Params(max_labels=1))


# ---- mixing

def water(given, nodes):
    """budget by name from {name: (weight, capacity)}, by repeated sharing out."""
    out, open_ = {}, {k for k, (w, _) in nodes.items() if w > 0}
    while True:
        rest = given - sum(nodes[k][1] for k in out)
        total = sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if nodes[k][1] * total <= nodes[k][0] * rest}
        if not full:
            return {k: out.get(k, rest * nodes[k][0] // total if k in open_ else 0) for k in nodes}
        # the neediest first: others are judged again with what is left
        low = min(full, key=lambda k: (nodes[k][1] / nodes[k][0], k))
        out[low] = nodes[low][1]
        open_.remove(low)
        if not open_:
            return {k: out.get(k, 0) for k in nodes}


def tree_budgets(leaves, weights, share, epochs):
    def down(given, paths, depth):
        if depth == 3:
            return {paths[0]: given}
        groups = defaultdict(list)
        for p in paths:
            groups[p[depth]].append(p)
        level = mixing.LEVELS[depth]
        nodes = {k: (weights.get(level, {}).get(k, 1), epochs * sum(leaves[p] for p in v)) for k, v in groups.items()}
        out = {}
        for k, b in water(given, nodes).items():
            out |= down(b, groups[k], depth + 1)
        return out
    return down(sum(leaves.values()) * share[0] // share[1], sorted(leaves), 0)


@pytest.mark.parametrize("seed", range(3))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(3)}", rng.choice("abc"), f"s{i}"): rng.choice([0, 1, 5, 100, 1000, 10**6]) for i in range(25)}
    weights = {"domain": {"d0": 5, "d1": 0}, "lang": {"a": 3, "b": 2}, "source": {"s3": 9, "s4": 0}}
    share = rng.choice([(1, 2), (1, 1), (7, 2), (9, 1)])
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): int(r.budget) for r in mixing.budgets(df, mixing.LEVELS, weights, share, 4).collect()}
    assert got == tree_budgets(leaves, weights, share, 4)


def mix_want(rows, weights, share, epochs, seed):
    import hashlib
    leaves, members = defaultdict(int), defaultdict(list)
    for i, t, d, lang, s in rows:
        leaf = (d or "", lang or "", s or "")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        leaves[leaf] += n
        members[leaf].append((i, n))
    out = []
    for leaf, budget in tree_budgets(leaves, weights, share, epochs).items():
        whole = budget // leaves[leaf] if leaves[leaf] else 0
        rest = budget - whole * leaves[leaf]
        by_place = defaultdict(list)
        for i, n in members[leaf]:
            by_place[hashlib.md5(f"{seed}:{whole + 1}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        took, total = set(), 0
        for place in sorted(by_place):
            total += sum(n for _, n in by_place[place])
            if rest > 0 and total <= rest:
                took.add(place)
        for place, ids in by_place.items():
            out += [(i, *leaf, n, e) for i, n in ids for e in range(1, whole + (place in took) + 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("share, leaves", [((1, 2), 50_000), ((3, 1), 0)])
def test_mix(spark, share, leaves):
    rng = random.Random(share[0])
    rows = []
    for i in range(400):  # one source holds a third of the rows
        s = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", None, ""])
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["d0", "d1"]),
                     rng.choice(["en", "de", None]), s))
    rows += [(None, "a b", "d0", "en", "hot"), (None, "c", "d0", "en", "hot"), (5, "again", "d0", "en", "hot"), (900, None, "d0", "xx", "empty"),
             (901, "long " * 30_000, "d1", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    got = mixing.mix(df, share=share, broadcast_leaves=leaves)
    want = mix_want(rows, mixing.WEIGHTS, share, 4, 17)
    got = [(r.doc_id, r.domain or "", r.lang or "", r.source or "", r.n_tokens, r.epoch) for r in got.collect()]
    assert sorted(got, key=str) == want
    assert mixing.mix(df.limit(0)).collect() == []


# ---- PII

def plain_spans(t):
    """The contract's patterns as they stand."""
    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return (sum(s[::2]) + sum(2 * x - 9 * (x > 4) for x in s[1::2])) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


PARTS = ["a", "Z", "@", ".", "-", "+", "1", "22", "255", "256", "4111111111111111", "0", " ", "é", "(", ")", "x.y", "007"]


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)
    for s, e, _ in pii.candidates(text, pii.base_spans(text)):
        assert all(e <= a or b <= s for a, _, b in pii.base_spans(text))


def test_long_runs_are_linear():
    for text in ("9" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + "(" * 200_000, "9 " * 100_000):
        pii.look(text)


def cue_docs():
    seeds = [f"please phone me at +1 (200) 555-{1000 + i} before noon today" for i in range(6)]
    return [(i, t) for i, t in enumerate(seeds)] + [
        (10, "please phone me at 0200 555 77 99 before noon today"),      # unseen, same cue
        (11, "the parcel number 0200 555 77 98 has come"),                # same shape, no cue
        (12, "mail bob@site.example.org or call"), (None, "10.0.0.1"), (13, None), (14, ""), (15, "x " * 50_000),
        (12, "mail bob@site.example.org or call")]


def test_bootstrapping_finds_unseen_identifiers_by_their_context(spark):
    rows = cue_docs()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    for p in (pii.Params(), pii.Params(filter_bits=64)):  # with the small filter many other pairs pass
        got = sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.added]) for r in pii.find_pii(df, p=p).collect()), key=str)
        want = []
        for i, t in rows:
            added = [(19, 3, 33)] if i == 10 else []
            want.append((i, plain_spans(t or ""), added))
        assert got == sorted(want, key=str)
    assert pii.find_pii(df.limit(0)).collect() == []


def test_a_cue_that_mostly_stands_beside_other_things_finds_nothing(spark):
    rows = cue_docs() + [(100 + i, "they phone me at the office before noon most days") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not r.added for r in pii.find_pii(df).collect())


def added_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: [tuple(x) for x in r.added] for r in pii.find_pii(df).collect() if r.added}


def test_cues_glued_to_the_identifier(spark):
    rows = [(i, f"my tel:+1 (200) 555-{1000 + i}") for i in range(6)] + [(10, "my tel:0200 555 77 99"), (11, "mytel:0200 555 77 98")]
    rows += [(20 + i, f"bob{i}@site.example.org), urgent") for i in range(6)] + [(30, "sue(at)site.example.org), urgent")]
    assert added_of(spark, rows) == {10: [(7, 3, 21)], 30: [(0, 0, 23)]}
    # the same cues, mostly beside other things
    rows += [(100 + i, "my tel:none") for i in range(40)] + [(200 + i, "(so it is), urgent") for i in range(40)]
    assert added_of(spark, rows) == {}


def test_occurrences_hold_the_contexts_of_every_span():
    for text in ("see <mailto:bob@x.org>, please do", "my tel:0200 555 77 99, or so", "Is a (0200)5557799) now yes", "at ip=10.0.0.1; then no",
                 "or tel+1 (200) 555-1000/ b c", "Say \xe9bob@x.org\xe9 b c", "in [::1:2:3] b c", "me at 10.0.0.1 b c"):
        spans = [(f["start"], f["end"]) for f in pii.look(text)["found"]]
        want = {p for s, e in spans for p in pii.contexts(text, s, e)}
        assert spans and any(p[0] == "<" for p in want) and want == set(occurrences_of(text, want))
    assert occurrences_of("me attend me at, me at", {"< me at"}) == ["< me at"]


def occurrences_of(text, patterns, bits=1 << 20):
    words = np.zeros(bits // 64, np.uint64)
    for at in pii.filter_bits(patterns, bits).tolist():
        words[at >> 6] |= np.uint64(1 << (at & 63))
    return [p for p in pii.Known(words).occurrences(pii.lower(text).split()) if p in patterns]


def plain_contexts(text, start, end):
    def keys(words):
        return [w if len(w) <= pii.LONG else f"\t{len(w)}:{int.from_bytes(w.encode('utf-32-be'), 'big') % (2 ** 128 - 159):x}" for w in words]
    before, after = keys(pii.lower(text[:start]).split()), keys(pii.lower(text[end:]).split())
    return (["< " + " ".join(before[-2:])] if len(before) > 1 else []) + (["> " + " ".join(after[:2])] if len(after) > 1 else [])


@given(st.lists(st.sampled_from([*PARTS, "Kk", "\u0130\u03a3", "\u2028", "\t\n", "a@b.c", "+1 (200) 555-1000", "12:34:5"]), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_contexts_are_the_neighbouring_words(text):
    seen = pii.look(text)
    for f in seen["found"]:
        assert f["near"] == plain_contexts(text, f["start"], f["end"])
    want = {p for f in seen["found"] for p in f["near"]}
    assert want == set(occurrences_of(text, want))
    base = pii.base_spans(text)
    assert [(f["start"], f["end"]) for f in seen["found"] if not f["seed"]] == [c[:2] for c in pii.candidates(text, base)]


@pytest.mark.parametrize("long", ["x" * 300, "Y1-" * 150, "\u0130\u03a3" * 200])
def test_words_of_any_length_are_cues(spark, long):
    text = f"{long} {long}+1 (200) 555-1000) {long}"
    (f,) = pii.look(text)["found"]
    assert [p[:3] for p in f["near"]] == ["< \t", "> )"] and set(occurrences_of(text, set(f["near"]))) == set(f["near"])
    rows = [(i, f"the {long} +1 (200) 555-{1000 + i} it") for i in range(6)] + [(10, f"the {long} 0200 555 77 99 it"), (11, f"the {long}z 0200 555 77 99 it")]
    n = len(long)
    assert added_of(spark, rows) == {10: [(n + 5, 3, n + 19)]}


def test_local_parts_of_any_length(spark):
    long = "a" * 300
    assert pii.base_spans(f"to {long}@x.org") == [(3, 0, 309)]
    rows = [(i, f"please mail me at bob{i}@x{i}.org before noon") for i in range(6)] + [(10, f"please mail me at {long}(at)x.org before noon")]
    assert added_of(spark, rows) == {10: [(18, 0, 327)]}


@pytest.mark.parametrize("between", [" ", ",", "; ", "\n\n"])
def test_many_addresses_in_one_text(between):
    n = 100_000
    seen = pii.look(between.join(f"a{i}@x{i}.org" for i in range(n)))
    assert len(seen["base"]) == len(seen["found"]) == n
    cut = pii.look(between.join(f"a{i}(at)x{i}.org" for i in range(n)))
    assert not cut["base"] and len(cut["found"]) == n


@given(st.integers(0, 10**9), st.integers(1, 4))
@settings(max_examples=6, deadline=None)
def test_scores_against_brute_force(spark, seed, rounds):
    rng = random.Random(seed)
    edges = {(f"p{rng.randint(0, 7)}", rng.randint(0, 1), f"v{rng.randint(0, 19)}"): rng.randint(1, 5) for _ in range(60)}
    seeds = {(k, v): rng.random() < 0.4 for _, k, v in edges}
    totals = {p: rng.randint(1, 80) for p, _, _ in edges if rng.random() < 0.8}
    matched = {}
    for (p, _, _), n in edges.items():
        matched[p] = matched.get(p, 0) + n
    score = {kv: float(s) for kv, s in seeds.items()}
    for _ in range(rounds):
        hit = {}
        for (p, k, v), n in edges.items():
            hit[p, k] = hit.get((p, k), 0) + n * score[k, v]
        conf = {pk: h / max(totals.get(pk[0], 0), matched[pk[0]]) for pk, h in hit.items() if h > 0}
        for kv, is_seed in seeds.items():
            if not is_seed:
                miss = 1.0
                for p, k, v in edges:
                    if (k, v) == kv:
                        miss *= 1 - min(conf.get((p, k), 0.0), 1 - 1e-9)
                score[kv] = 1 - miss
    got = pii.score(spark.createDataFrame([(p, k, v, seeds[k, v], n) for (p, k, v), n in edges.items()],
                                          "pattern string, kind int, value string, seed boolean, n long"),
                    spark.createDataFrame(list(totals.items()), "pattern string, total long"),
                    spark.createDataFrame(list(matched.items()), "pattern string, matched long"), pii.Params(rounds=rounds)).collect()
    got = {(r.pattern, r.kind): r.confidence for r in got}
    assert got.keys() == conf.keys() and all(abs(got[k] - conf[k]) < 1e-9 for k in conf)


def test_a_candidate_of_two_kinds_counts_once(spark):
    rows = [(i, f"please phone me at +1 (200) 555-{1000 + i} before noon today") for i in range(16)]
    # 12 digits: card or phone; 16 of 20 occurrences beside a seed are 0.8
    rows += [(100 + i, f"please phone me at 0200 5557 {1000 + i} before noon today") for i in range(4)]
    assert added_of(spark, rows) == {100 + i: [(19, 3, 33)] for i in range(4)}
