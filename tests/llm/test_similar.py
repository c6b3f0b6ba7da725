"""Near-duplicates at a similarity, against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spandrel.llm import similar as S
from spandrel.llm.simhash import shingle_hashes
from tests.llm.test_text_operators import WORD

MASK = (1 << 64) - 1


def brute_mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & MASK
    return x ^ x >> 32


def brute_profile(text):
    """Fingerprint and keys with Python numbers."""
    hs, odd = shingle_hashes((text or "").encode(), 5), [int(x) for x in S._ODD]
    fp = 0
    for w in range(S.WIDTH):
        wide = [brute_mixed(h * odd[w] & MASK) for h in hs]
        fp |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in wide) > len(wide)) << 64 * w
    keys = []
    for b in range(S.BANDS if hs else 0):
        key = b + 1
        for k in range(S.ROWS):
            key = brute_mixed((key * odd[0] + min(h * odd[S.WIDTH + b * S.ROWS + k] & MASK for h in hs)) & MASK)
        keys.append(key)
    return fp, frozenset(keys)


def brute_similar(docs, radius=None):
    """(doc_id, smallest reachable id): links of equal fingerprints, and of those that
    share a key within the radius."""
    radius = S.radius_of() if radius is None else radius
    rows = [(i, *brute_profile(t)) for i, t in docs]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            (_, p, k), (_, q, m) = rows[i], rows[j]
            if (p == q or k & m and (p ^ q).bit_count() <= radius) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, *_), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [(d, least.get(x)) for (d, *_), x in zip(rows, label)]


def jaccard(a, b):
    def shingles(t):
        w = WORD.findall(t.encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    """The words with n of them replaced, far enough apart to break five shingles each."""
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(words) // (2 * n)] = f"new{rng.randint(0, 10**9)}"
    return out


def planted(rng, copies=6):
    docs, truth = [], []
    for g in range(40):
        n = rng.randint(150, 400)
        words = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(n)]
        docs.append((len(docs), " ".join(words)))
        base = docs[-1][0]
        for _ in range(copies):
            # J = (n - 5 c) / (n + 5 c) for c changes
            docs.append((len(docs), " ".join(changed(rng, words, rng.choice([1, n // 70, n // 50, n // 8])))))
            truth.append((base, docs[-1][0], jaccard(docs[base][1], docs[-1][1])))
    return docs, truth


def test_profiles():
    texts = ["", "one", "one two", "a b c d e f g h", "a b c d e f g h " * 300, "x y z w v u"]
    fps, keys = S.profiles([shingle_hashes(t.encode(), 5) for t in texts])
    for t, fp, k in zip(texts, fps, keys):
        want, shared = brute_profile(t)
        assert int.from_bytes(fp.tobytes(), "little") == want and (not shared or set(k.tolist()) == shared)


def test_links_match_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 40, 49, 130, 400):
        base = rng.integers(0, 1 << 63, (3, S.WIDTH), dtype=np.uint64)
        fps = base[rng.integers(0, 3, n)].copy()
        for i in range(n):
            for _ in range(rng.integers(0, 90)):
                fps[i, rng.integers(S.WIDTH)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        for across in (False, True)[: 1 + (n > S.SHIFTED)]:
            side = np.arange(n) >= (n // 2 if across else n)
            for radius in (20, 60, 200):
                child, root = S.links(fps, np.zeros(n, np.int64), side.astype(np.int64), radius)
                want = np.arange(n)
                for i in range(n):
                    for j in range(i):
                        near = int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius
                        if near and (not across or side[i] != side[j]) and want[i] != want[j]:
                            a, b = sorted((want[i], want[j]))
                            want[want == b] = a
                got = np.arange(n)
                got[child] = root
                assert (got == want).all()


def test_radius():
    share = math.acos(2 * 0.8 / 1.8) / math.pi
    assert 0 < S.radius_of() - S.BITS * share < 0.05 * S.BITS and S.radius_of(0.9) < S.radius_of(0.8)


def test_similar_documents(spark, odd, empty, make):
    docs, truth = planted(random.Random(5))
    got = {r.doc_id: r.component_id for r in S.similar_documents(make(*docs)).collect()}
    assert got == dict(brute_similar(docs))
    near = [got[a] == got[b] for a, b, j in truth if j >= 0.8]
    far = [got[a] == got[b] for a, b, j in truth if j < 0.6]
    assert len(near) > 60 and all(near) and len(far) > 30 and not any(far)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (odd, real):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        assert sorted(map(tuple, S.similar_documents(frame).collect()), key=str) == sorted(brute_similar(rows), key=str)
    assert S.similar_documents(empty).collect() == []


def test_tiles_of_a_large_group(spark, make, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    docs = [(i, " ".join(changed(rng, words, rng.choice([1, 2, 3, 4])))) for i in range(60)] + [(100 + i, f"own text number {i} of several words " * 3) for i in range(20)]
    got = {r.doc_id: r.component_id for r in S.similar_documents(make(*docs)).collect()}
    assert got == dict(brute_similar(docs)) and {got[i] for i in range(60)} == {0}


def test_clashing_columns(make):
    docs = make((1, "a b c d e f"), (2, "a b c d e f"), (3, None))
    for name in ("node", "fp", "keys", "key", "of", "root", "least", "side", "part", "tile", "n"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
