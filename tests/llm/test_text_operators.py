"""Operators against brute force, their libraries, and odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from spandrel.llm import exact_dedup as E
from spandrel.llm import secrets_scan as S
from spandrel.llm import simhash as H
from spandrel.llm.language_id import language_id
from spandrel.llm.language_id import train as train_language
from spandrel.llm.line_dedup import line_dedup
from spandrel.llm.mixing import mix, targets
from spandrel.llm.pieces import PieceCoder, decode, encode
from spandrel.llm.quality import keep_quality, quality_rules
from spandrel.llm.quality import train as train_quality
from spandrel.llm.substring_dedup import substring_dedup
from spandrel.llm.suffix_automaton import SuffixAutomaton
from spandrel.llm.token_counts import PrefixCounter, token_counts, truncated

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# exact


def test_exact_dedup(make, odd, empty):
    got = {r.doc_id: r for r in E.exact_dedup(make((1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (9, "x"), (5, None), (7, ""))).collect()}
    assert (got[1].keep_id, got[1].kept, got[2].kept, got[1].group_size) == (2, False, True, 2)
    assert got[3].kept and got[4].kept and got[9].group_size == 1
    assert (got[5].keep_id, got[7].group_size) == (7, 2)
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    rows = E.exact_dedup(odd).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows if r.doc_id == 5) == 2
    assert [r.keep_id for r in rows if r.doc_id == 1] == [2] and [r.kept for r in rows if r.doc_id == 7] == [True]
    assert E.exact_dedup(empty).collect() == []


def test_hot_group_and_history(make, spark):
    docs = make(*[(i, "same" if i % 3 else f"own {i}") for i in range(4000)])
    rows = E.exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == 1334 + 1 and {r.keep_id for r in rows if r.doc_id % 3} == {3998}
    history = E.grouped(E.digests(make((50, "old"))))
    got = {r.doc_id: (r.keep_id, r.kept) for r in E.new_documents(make((60, "OLD"), (61, "new"), (62, "new")), history).collect()}
    assert got == {60: (50, False), 61: (62, False), 62: (62, True)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 3000])
def test_perfect_hash(n):
    d = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    seeds, slots = E.perfect_hash(d)
    assert sorted(slots) == list(range(n)) and (E.slot_of(d, seeds, n) == slots).all()


@pytest.mark.parametrize(("seed", "n"), [(1749, 18), (14900, 15), (11747, 21)])
def test_perfect_hash_of_full_buckets(seed, n):
    d = np.random.default_rng(seed).integers(0, 256, (n, 32), dtype=np.uint8)
    seeds, slots = E.perfect_hash(d)
    assert sorted(slots) == list(range(n)) and (E.slot_of(d, seeds, n) == slots).all()
    with pytest.raises(ValueError, match="do not differ"):
        E.perfect_hash(np.repeat(d[:1], 3, axis=0))


def test_perfect_hash_of_small_shards():
    rng = np.random.default_rng(11)
    for n in [*range(1, 101)] * 5 + [int(x) for x in rng.integers(5, 41, 211 * 4)]:
        d = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        seeds, slots = E.perfect_hash(d)
        assert sorted(slots) == list(range(n)) and (E.slot_of(d, seeds, n) == slots).all()


def test_new_documents(make, odd, empty, spark):
    kind = "digest binary, winner long, copies long"
    ab = hashlib.sha256(b"a b c").digest()
    history = spark.createDataFrame([(bytearray(ab), 50, 1), (bytearray(ab), 70, 2), (None, 1, 1), (bytearray(hashlib.sha256(b"x").digest()), None, 1)], kind)
    rows = E.new_documents(odd, history).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows if r.text_sha256 == ab.hex()} == {(i, 70, 3, False) for i in (None, 6, 7)}
    own = {(str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(odd).collect() if r.text_sha256 != ab.hex()}
    assert {(str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in rows if r.text_sha256 != ab.hex()} == own
    assert [tuple(r)[1:4] for r in E.new_documents(make((5, "X")), history).collect()] == [(None, 1, False)]
    none = spark.createDataFrame([], kind)
    assert {(r.doc_id, r.kept) for r in E.new_documents(make((1, "a"), (2, "A")), none).collect()} == {(1, False), (2, True)}
    assert E.new_documents(empty, history).collect() == []
    hot = make(*[(i, "same") for i in range(1500)], (9999, "other"))
    assert sorted((r.doc_id, r.keep_id) for r in E.new_documents(hot, none).collect() if r.kept) == [(1499, 1499), (9999, 9999)]


def test_hot_groups_are_in_the_hash(make, monkeypatch):
    indexed, build = [], E.build_index
    monkeypatch.setattr(E, "build_index", lambda history, shards: indexed.extend(r.copies for r in history.collect()) or build(history, shards))
    docs = make(*[(i, "same" if i % 3 else f"own {i // 2}") for i in range(4000)], (None, "same"))
    rows = E.exact_dedup(docs).collect()
    assert sorted(indexed) == sorted(r.group_size for r in rows if r.kept and r.group_size > 1)
    assert {(r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id is None} == {(3998, 2667, False)}


# substrings


def brute_substring(docs, k=13):
    first, split = {}, [(i, WORD.findall((t or "").encode())) for i, t in docs]
    for i, w in split:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_substring_dedup_planted(make):
    rng = random.Random(4)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(11, 80))) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        if i % 3 == 0:
            parts.append(passages[0])
        docs.append((i * 7 % 150, rng.choice(["  ", " ", "\n\t"]).join(parts)))
    got = sorted((tuple(r) for r in substring_dedup(make(*docs)).collect()), key=str)
    assert got == brute_substring(docs)


def test_substring_dedup_odd(odd, empty, real):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring_dedup(odd).collect()), key=str) == brute_substring(docs)
    assert substring_dedup(empty).collect() == []
    docs = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring_dedup(real).collect()), key=str) == brute_substring(docs)


def test_small_reference_shards_and_chunks(make, monkeypatch):
    from spandrel.llm import substring_dedup as D

    monkeypatch.setattr(D, "AUTOMATON_WORDS", 40)
    monkeypatch.setattr(D, "CHUNK_BYTES", 4000)
    rng = random.Random(9)
    passages = [" ".join(f"p{rng.randint(0, 30)}" for _ in range(rng.randint(13, 60))) for _ in range(8)]
    docs = [(i, " ".join([f"own{i}", rng.choice(passages), f"mid{i}", rng.choice(passages)])) for i in range(120)] + [(None, passages[0])] * 3
    got = sorted((tuple(r) for r in substring_dedup(make(*docs)).collect()), key=str)
    assert got == brute_substring(docs)


def test_words_longer_than_a_hashing_block():
    from spandrel.llm.common import word_hashes, words

    rng = np.random.default_rng(1)
    text = b" ".join(bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (3, 100, 1, 64, 7, 65, 1, 300, 2)) + b" \n x"
    data = np.frombuffer(text * 3, np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    for size in (1, 7, 64, 65, 1000):
        assert (word_hashes(data, start, end, size) == word_hashes(data, start, end)).all()
    assert len(set(word_hashes(data, start, end).tolist())) == len({bytes(data[a:b]) for a, b in zip(start, end)})


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(30):
        words = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(5)]
        a = SuffixAutomaton()
        for i, w in enumerate(words):
            a.add(w, i)
        probe = [rng.choice("abcd") for _ in range(30)]
        want = [next((i for i, w in enumerate(words) if any(w[x : x + 4] == probe[j : j + 4] for x in range(len(w) - 3))), None) for j in range(27)]
        assert a.first_documents(probe, 4) == want


# fingerprints


def brute_fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows: (doc_id, fingerprint); components of links of 3 bits."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [(d, f"{fp:016x}", least.get(k)) for (d, fp), k in zip(rows, label)]


def test_near_duplicates(odd, empty, real, make):
    base = " ".join(f"v{i}" for i in range(400))
    planted = make((1, base), (2, base + " tail"), (3, base.upper() + " x"), (4, "other words here"))
    for docs in (odd, planted, real):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    assert H.near_duplicates(empty).collect() == []


def test_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", 16)
    rng = np.random.default_rng(2)
    fps = sorted({int(x) & ((1 << 30) - 1) for x in rng.integers(0, 1 << 12, 150) << 3})
    edges = [tuple(r) for r in H.link_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps)).collect()]
    want = brute_components([(x, x) for x in fps])
    label = {x: x for x in fps}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 64
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    assert {k: v for k, v in label.items()} == {d: c for d, _, c in want}


def test_bit_sliced_links_match_brute_force():
    rng = np.random.default_rng(3)
    for n in (2, 5, 63, 64, 65, 200):
        base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        fp = base[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        child, root = H.links(fp, np.zeros(n, np.int64))
        forest = H.Forest(n)
        for i in range(n):
            near = [j for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
            forest.link(np.full(len(near), i), np.array(near, np.int64))
        got = np.arange(n)
        got[child] = root
        assert (got == forest.roots(np.arange(n))).all()


# lines


def test_line_dedup(spark):
    rows = [(i, "http://A.example:80/x" if i < 9 else "https://u@b.example/", f"<p>menu</p><p>own {i}</p><script>x='<p>'</script>") for i in range(11)]
    rows += [(None, None, None), (20, "no url", ""), (3, "http://a.example/", "<p>menu<br>menu<p>own 3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.n_lines): r for r in line_dedup(pages).collect()}
    assert got[3, 3].kept_text == "own 3" and got[3, 3].n_dropped == 2
    assert got[0, 2].kept_text == "own 0" and got[0, 2].host == "a.example"
    assert got[9, 2].kept_text == "own 9" and got[None, 0].kept_text == "" and got[20, 0].host == ""
    assert line_dedup(pages.where("false")).collect() == []


def test_line_dedup_of_small_hosts_and_odd_pages(spark):
    from pyspark.sql import functions as F

    long = "<p>long " + "x" * 200_000 + "</p>" + "<p>y</p>" * 20_000
    rows = [(1, "http://one/", "<p>a<p>b"), (2, "http://two/", "<p>a<p>b"), (3, "http://two/", "<p>a<p>c"), (None, None, None), (4, "http://long/", long), (5, "http://long/", "<p>y"), (5, "http://long/", "<p>y"), (6, "http://x/", " \n ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "lines", "n", "pages", "salt", "boilerplate", "kept"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = sorted(((r.page_id or 0), r.host, r.n_lines, r.n_dropped, r.kept_text[:8]) for r in line_dedup(pages).collect())
    assert got == [(0, "", 0, 0, ""), (1, "one", 2, 0, "a\nb"), (2, "two", 2, 1, "b"), (3, "two", 2, 1, "c"), (4, "long", 20001, 20000, "long xxx"), (5, "long", 1, 1, ""), (5, "long", 1, 1, ""), (6, "x", 0, 0, "")]


# tokens


def test_token_counts_and_prefixes(odd, empty, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for docs in (odd, real):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, BPE).collect()) == want
    assert token_counts(empty, BPE).collect() == []
    c, rng = PrefixCounter(BPE), random.Random(5)
    parts = ["a", " ", "  ", "'s", "'re", "é", "日本", "\n", "1", "<|endoftext|>", "!", "'", "\xa0", "the ", "🙂"]
    for _ in range(150):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        want = [len(t.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert c.prefix_counts(s) == want
        assert len(t.encode(c.truncate(s, 3), add_special_tokens=False).ids) <= 3
    assert {r.doc_id: r.text for r in truncated(odd, BPE, 2).collect()}[6] == "A b"


def test_pieces(odd, empty, real):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, real):
        rows = {(r.doc_id, r.n_pieces): r for r in encode(docs, PIECES).collect()}
        for r in docs.select("doc_id", "text").collect():
            want = m.encode(r.text or "")
            assert rows[r.doc_id, len(want)].pieces == want and (rows[r.doc_id, len(want)].round_trip or "▁" in r.text)
    assert encode(empty, PIECES).collect() == []
    assert {r.doc_id: r.text for r in decode(encode(real, PIECES), PIECES).collect()} == texts_of(real)
    c, rng = PieceCoder(PIECES), random.Random(6)
    for _ in range(300):
        s = "".join(rng.choice(["a", "  ", "é", "日", "\n", "<s>", "\x00", "the", "🙂", "▁", "ing "]) for _ in range(rng.randint(0, 9)))
        assert c.encode(s) == m.encode(s) and c.decode(m.encode(s)) == m.decode(m.encode(s))


def test_long_words_are_not_remembered():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c, rng = PieceCoder(PIECES), random.Random(8)
    learnt = []
    learn = c._learn
    c._learn = lambda: (learnt.extend(c.known.new), learn())[1]
    usual = [f"word{i}" for i in range(50)]
    for _ in range(6):
        texts = [" ".join([*usual, "".join(rng.choice("abcdefgh") for _ in range(60)), "\n".join(usual)]) for _ in range(5)] + ["x" * 3000, "  ", "\n\n a \n"]
        ids, offsets = c.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [m.encode(x) for x in texts] and c.decode_all(ids, offsets) == texts
    assert len(learnt) == len(set(learnt)) and max(map(len, c.known)) <= 48


def test_frequent_words_survive_forgetting(monkeypatch):
    import sentencepiece

    from spandrel.llm import pieces as Q

    monkeypatch.setattr(Q, "REMEMBERED", 100)
    m, c, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCoder(PIECES), random.Random(2)
    for i in range(40):
        texts = [" ".join(["the", "same", f"w{i}x{rng.randint(0, 9**9)}", f"é{i}日"]) for _ in range(9)]
        ids, offsets = c.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [m.encode(x) for x in texts]
    assert len(c.known) < 200 and "same" in c.known


def test_decode_and_truncate_odd_rows(spark, odd, empty):
    encoded = spark.createDataFrame([(1, None), (2, []), (None, [5, 6]), (2, [])], "doc_id long, pieces array<int>")
    c = PieceCoder(PIECES)
    assert sorted(map(tuple, decode(encoded, PIECES).collect()), key=str) == sorted([(1, None), (2, ""), (2, ""), (None, c.decode([5, 6]))], key=str)
    assert decode(encoded.where("false"), PIECES).collect() == [] and truncated(empty, BPE).collect() == []
    rows = truncated(odd, BPE, 3).collect()
    assert len(rows) == odd.count() and {r.text for r in rows if r.doc_id == 1} == {None} and {r.text for r in rows if r.doc_id == 2} == {""}


def test_very_long_texts(make):
    """Megabytes of text, and words of hundreds of kilobytes, in every pass that reads texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = [f"{rng.choice(['alpha', 'Beta', 'é', 'x'])}{rng.randint(0, 9999)}" for _ in range(250_000)]
    prose, solid = " ".join(words), "".join(rng.choice("abcdefghij") for _ in range(300_000))
    docs = make((1, prose), (2, " ".join(words[1000:50_000])), (3, solid), (4, "a"))
    t, m = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {1: prose, 2: " ".join(words[1000:50_000]), 3: solid, 4: "a"}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, BPE).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert {r.doc_id: (r.n_pieces, r.round_trip) for r in encode(docs, PIECES).collect()} == {i: (len(m.encode(x)), True) for i, x in texts.items()}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {1: (250_000, 0), 2: (49_000, 49_000), 3: (1, 0), 4: (1, 0)}
    rows = {r.doc_id: r for r in quality_rules(docs, train_quality(docs.where("false"), docs.selectExpr("doc_id", "1 quality"))).collect()}
    assert rows[1].n_words == 250_000 and rows[3].word_chars == 300_000
    assert len(language_id(docs, train_language(make(*[(i, "alpha beta", "en") for i in range(30)]))).collect()) == 4


# secrets


def brute_spans(t):
    assign = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[1])))


def test_secret_scan(odd, empty, real):
    rng = random.Random(7)
    parts = ["password", "=", ":", " ", "'", "abc123", "Secret", "api_KEY", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef01", "İ", "K", "\n"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [x for x in S.scan(s) if x[1] in S.KINDS[:3]] == brute_spans(s)
    body = "aB3" * 10
    good = "ghp_" + body + S.checksum62(body)
    assert S.scan(f"x {good} y") == [(2, "github", 42)] and S.scan(f"x {good[:-1]}~ y") == []
    assert S.redacted(f"x {good} y") == "x [SECRET] y"
    for docs in (odd, real):
        want = Counter(S.written(brute_spans(r.text or "")) for r in docs.select("text").collect())
        got = S.secret_spans(docs).collect()
        assert Counter(r.spans for r in got) == want and all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert S.secret_spans(empty).collect() == []


# models


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t.encode())
    lines = [x for x in t.encode().split(b"\n") if WORD.search(x)]
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules(odd, empty, spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    model = train_quality(docs, seen)
    for d in (docs, odd):
        want = Counter(brute_quality(r.text) for r in d.select("text").collect())
        assert Counter(tuple(r)[1:7] for r in quality_rules(d, model).collect()) == want
    rows = quality_rules(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id").where("not base_failed").collect()
    truth = {r.doc_id: r["quality"] for r in labels.collect()}
    assert np.mean([r.kept == (truth[r.doc_id] == 1) for r in rows]) > 0.95
    assert quality_rules(empty, model).collect() == [] and keep_quality(empty, model).collect() == []
    assert {r.doc_id for r in keep_quality(docs, model).collect()} == {r.doc_id for r in quality_rules(docs, model).where("kept").collect()}
    nothing = train_quality(empty, labels)
    assert all(r.kept != r.base_failed for r in quality_rules(odd, nothing).collect())


def test_language_id(odd, empty, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train_language(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language_id(docs, model).collect() if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    rows = language_id(odd, model).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in rows)
    assert language_id(empty, model).collect() == []
    assert {r.lang_pred for r in language_id(odd, train_language(empty)).collect()} == {"und"}


def test_many_languages(make):
    """More languages than dimensions, each with its own words: none is left out."""
    names = [f"l{i:02d}" for i in range(40)]
    docs = make(*[(i, " ".join(f"{names[i % 40]}q{k % 7}" for k in range(i, i + 12)), names[i % 40]) for i in range(1600)])
    model = train_language(docs)
    assert model.languages == names and model.layer is not None
    rows = language_id(docs, model).collect()
    assert np.mean([r.lang_pred == names[r.doc_id % 40] for r in rows if r.held_out]) > 0.98


def test_training_texts_are_bounded(make, monkeypatch):
    from spandrel.llm import linear

    monkeypatch.setattr(linear, "LONG_TEXT", 100)
    seen = []
    monkeypatch.setattr("spandrel.llm.language_id.fit", lambda texts, y, held, languages: seen.extend(zip(texts, y.tolist())) or languages)
    long = "mot " * 100
    train_language(make(*[(i, "word " * 5 if i % 3 else "word " * 50, "en") for i in range(90)], *[(i, long, "fr") for i in range(100, 160)]))
    assert max(len(t) for t, y in seen if y == 0) <= 100 and sum(y == 1 for _, y in seen) == linear.LONG_LIMIT


def brute_means(table, parts):
    return sum(np.array([table[b[x:y]].mean(axis=0) if y > x else np.zeros(table.shape[1:]) for x, y in zip(s, e)]) for b, s, e in parts)


def test_scores_match_a_plain_reading(real):
    """Predictions of both classifiers from Python strings, one feature at a time."""
    from spandrel.llm import linear

    texts = [r.text for r in real.limit(40).collect()] + ["", "a", "é"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    table = np.random.default_rng(0).normal(size=(3 << 16, 2))
    parts = linear.features(data, offsets, (3, 4), True)
    for step in (1, 100, 1 << 17):
        assert np.allclose(linear.means(table, parts, step), brute_means(table, parts))
    one = [linear.means(table, linear.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]), (3, 4), True))[0] for x in raw]
    assert np.allclose(one, linear.means(table, parts))
    for (buckets, starts, ends), n in zip(parts, (3, 4)):
        for x, a, b in zip(raw, starts, ends):
            alone = [int(linear.byte_grams(np.frombuffer(x[i : i + n], np.uint8), n)[0]) for i in range(len(x) - n + 1)]
            assert [v & 0xFFFF for v in buckets[a:b].tolist()] == alone


# mixing


def test_targets_by_resharing(spark):
    rng = random.Random(8)
    for _ in range(5):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 10000]) for i in range(rng.randint(1, 12))}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        want, capped, rest = {}, set(), 1.5 * sum(sizes.values())
        while True:
            total = sum(w for s, w in weight.items() if s not in capped)
            share = {s: rest * weight[s] / total for s in sizes if s not in capped} if total else {}
            over = {s for s, v in share.items() if v > 2 * sizes[s]}
            if not over:
                want.update(share)
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                rest -= want[s]
            capped |= over
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(want)


def test_mix(odd, empty, make, spark):
    docs = make(*[(i, "w " * (i % 40 + 1), "en", "ab"[i % 5 == 0]) for i in range(3000)])
    rows = mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs).collect()))
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mix(docs, bins=7).collect())
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and max(r.taken / r.size for r in own) <= 2
    heavy = mix(docs, weights=spark.createDataFrame([(i, 50.0 if i % 2 else 0.02) for i in range(3000)], "doc_id long, weight double")).where("copies > 0 and source = 'b'").collect()
    assert sum(r.doc_id % 2 for r in heavy) >= len(heavy) / 2
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows) and mix(empty).collect() == []
