"""Token counts, URL filter, decontamination and WARC archives."""
import hashlib
import random
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lotlens.llm import decontaminate as dc
from lotlens.llm import token_count as tc
from lotlens.llm import url_filter as uf
from lotlens.llm import warc

LONG = "lengthy words and, more. " * 20_000


# ---- token counts

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tc.default_tokenizer())


@pytest.fixture(scope="module")
def counts():
    with open(tc.default_tokenizer(), "rb") as f:
        return tc.PieceCounts(*tc._encoder(f.read(), ".json"), 1 << 12, 2000)


@given(st.lists(st.text(alphabet="abT's Zé1.,\n\t|<>&%日\xa0　\x1c  ", max_size=25), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_count_as_the_whole_text(tokenizer, counts, texts):
    assert counts.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_special_strings_and_line_ends(tokenizer, counts):
    texts = ["a<|endoftext|> b", "<|endoftext|>", " <|endoftext|>.\nx", "x.\n\n  y", "it's. We'll\r\n go", " ", "", "\n \n"]
    assert counts.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts(spark, tokenizer):
    texts = ["Some words here", None, "", LONG, LONG, "x" * 5000, "é ü\n日本"]
    rows = [(i if i != 4 else None, t, "n", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _text int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df).collect()}
    want = set()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want.add((i, len((t or "").encode()), n, n > 1024))
    assert got == want
    assert tc.token_counts(df.limit(0)).collect() == []


def test_other_tokenizer_files_count_whole_texts(spark):
    import public_tokenizers
    import sentencepiece
    df = spark.createDataFrame([(1, "Some  Words, here\n and there")], "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode("Some  Words, here\n and there"))
    assert tc.token_counts(df, tokenizer=model).first().n_tokens == want
    from tokenizers import Tokenizer
    word = public_tokenizers.path("word_bpe_49k.json")
    want = len(Tokenizer.from_file(word).encode("Some  Words, here\n and there", add_special_tokens=False))
    assert tc.token_counts(df, tokenizer=word).first().n_tokens == want


# ---- URL filter

def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = split_url(url)
    fits = []
    for verdict, h, p in rules:
        inside = host == h or host.endswith("." + h)
        if inside and re.match(".*".join(map(re.escape, p.split("*"))), path, re.S):
            fits.append((len(h + p), len(h), verdict == "block", h + p, verdict))
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


URLS = [None, "", "no url", "://", "http://", "http://a.com", "http://A.com/", "HTTP://x.Example.com/en/1?q=/es/",
        "https://www.example.com/en/", "http://example.com/en", "http://example.com/EN/", "http://notexample.com/en/2",
        "http://b.net/es/x#y", "http://b.net/fr/", "http://b.net/frx", "http://net/es/", "http://com.net?x=1",
        "a://b.net/es/://c.com/", "http://é.com/en/", "http://u:p@example.com:80/en/", "http://x.com/ab/cd/z",
        "http://x.com/abq/cd", "http://x.com/\n/cd", "http://www.example.com/en/" + "a" * 50_000]
RULES = list(uf.DEFAULT_RULES) + [("block", "x.com", "/ab"), ("allow", "x.com", "/a*/cd"), ("block", "é.com", "/"),
                                  ("block", "b.net", ""), ("allow", "x.com", "/*"), ("block", "com", "/abq/")]


@pytest.mark.parametrize("rules", [uf.DEFAULT_RULES, RULES])
@pytest.mark.parametrize("limit", [0, 200_000])  # without and with a broadcast
def test_url_filter(spark, rules, limit):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[7], "x", "y"), (7, URLS[7], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = uf.url_filter(df, uf.rules_frame(spark, rules), broadcast_rules=limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *judge(u, rules)) for i, u, *_ in rows), key=str)
    assert uf.url_filter(df.limit(0), uf.rules_frame(spark, rules)).collect() == []


def test_rules_are_indexed_by_the_rarest_token(spark):
    urls = spark.createDataFrame([("a.com/en/x",), ("b.com/en/y",), ("c.com/z",), ("d.net/fr/",)], "address string")
    idx = {r.rule: r.token for r in uf.index(urls, uf.rules_frame(spark, RULES)).collect()}
    assert idx["net/fr/"] in ("net", "fr") and idx["www.example.com/en/"] in ("www", "example")
    assert idx["com/"] == "com" and idx["x.com/ab"] == "x"


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert tuple(uf.url_filter(df, uf.rules_frame(spark).limit(0)).first()) == (1, "a.com", "/", None, "allow")


# ---- decontamination

def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def contaminated(rows, items, size=13):
    wins = {}
    for item, t in items:
        w = words(t)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(str(item) if item is not None else "")
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [3, 100_000])
def test_decontamination(spark, block):
    rng = random.Random(block)
    items = [(i, " ".join(rng.choices("abcdef", k=rng.choice([1, 2, 3, 6, 13, 14, 20])))) for i in range(12)]
    items += [(None, "Null item, words"), (90, None), (91, " . "), (92, items[0][1]), (93, "ÉA élan")]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 15))) for _ in range(3)]
        rows.append((i, rng.choice([" ", ". ", "\n"]).join(parts + [rng.choice(items)[1] or ""] * rng.randint(0, 2))))
    rows += [(None, "null item WORDS"), (None, None), (70, None), (71, ""), (72, "éa ÉLAN"), (73, "Éa élan"), rows[3], rows[3],
             (74, "lengthy text " * 30_000 + (items[6][1] or ""))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, words string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, window string")
    got = dc.contamination(docs, bench, block_windows=block).drop("_text_key").collect()
    assert sorted(map(tuple, got), key=str) == sorted(contaminated(rows, items), key=str)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(docs.limit(0), bench).collect() == []
    got = dc.contamination(docs, bench.limit(0)).drop("_text_key").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, []), (2, 0, 0, [])]


# ---- WARC

PAGES = [(5, "http://a/", "x" * 200), (3, "http://b/", "x" * 200), (9, None, "x" * 200), (1, "http://c/\nd", "short"),
         (2, "u", "short"), (None, "u", "x" * 200), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60),
         (7, "u", "é" * 60), (None, "u", "y" * 100), (None, "u", "y" * 100), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 9),
         (11, "u", LONG)]


def warc_want(pages):
    first = {}
    for i, _, h in pages:
        body = (h or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        to = first.get(body)
        to = None if to is None or to == i else to
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to, None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.warc_roundtrip(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == warc_want(PAGES)
    assert warc.warc_roundtrip(df.limit(0)).collect() == []
    # small archives, payloads read back
    path = str(tmp_path / "small")
    warc.write_archives(warc.with_revisits(df), path, archive_bytes=300)
    back = warc.read_archives(spark, path).collect()
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h in PAGES}


def archive(*records):
    return warc.build_archive(list(records), 1 << 10, 1 << 16, 3)


def one(page=1, payload=b"hello " * 30):
    return warc.record(page, "u", payload, hashlib.sha256(payload).hexdigest(), None)


def test_archive_leads_with_its_dictionary():
    many = [one(i, (f"page {i} " + "common words of all pages ").encode() * 20) for i in range(200)]
    data = archive(*many)
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC and size > 0
    assert list(warc.frames(data)) == many
    # the dictionary may be compressed, and skippable frames may stand between records
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])
    lead = data[:4] + len(packed).to_bytes(4, "little") + packed
    assert list(warc.frames(lead + warc.EMPTY_FRAME.encode("latin-1") + data[8 + size:])) == many


@pytest.mark.parametrize("data, message", [
    (archive(one())[:-3], "truncated"), (b"P*M\x18\x09", "truncated"), (b"junk" * 9, "not a Zstandard frame")])
def test_bad_frames(data, message):
    with pytest.raises(ValueError, match=message):
        list(warc.frames(data))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"HTTP/1.1"), (b"WARC-Date: ", b"X-Date: "), (b"hello", b"jello"), (b"\r\n\r\n\r\n", b"\r\n"),
    (b"Content-Length: 180", b"Content-Length: 181"), (b"WARC-Type: response", b"WARC-Type: revisit"),
    (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Date: ", b"WARC-Date ")])
def test_bad_records_are_rejected(old, new):
    good = one()
    assert warc.parse_record(good)["payload_bytes"] == 180
    bad = good.replace(old, new) if old in good else good[:-4] + new
    with pytest.raises(ValueError):
        warc.parse_record(bad)


def test_reader_reports_errors(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive(one(1), one(2).replace(b"WARC-Date", b"Date"), one(3)) + b"junk")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.page_id for r in got] == [1, None, 3, None] and [r.error is None for r in got] == [True, False, True, False]
