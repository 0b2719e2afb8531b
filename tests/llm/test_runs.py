"""Runs, byte-level BPE and phrases against brute force and the public library."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import bytebpe, phrases, runs, words
from sparkloom.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, names string, piece string, slot long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "n", "p", 7) for i, t, x in rows], DOC)


def brute_runs(c):
    out = []
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            s = i
            while i + q < len(c) and c[i] == c[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(c[x] == c[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        c = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            c = [c[i] if i < a else c[a + (i - a) % p] for i in range(n)]
        assert runs.runs(c) == brute_runs(c)


class Counted(list):
    """A list that counts how often a place is read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: [0] * n, lambda n: (([0] * 8 + [1]) * 8 + [2]) * (n // 73), lambda n: [random.Random(2).randrange(2)] * (n // 2) + [1, 0] * (n // 4)])
def test_work_is_linear(make):
    for n in (2000, 16000):
        c = make(n)
        Counted.reads = 0
        runs._matches(Counted([*c, -1]), len(c))
        assert Counted.reads < 16 * len(c)


def brute_digest(doc_id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, s + e)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256("".join(f"{s},{e},{q}\n" for s, e, q in found).encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_run_digest_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b cé d e".split(" ")) for _ in range(rng.randint(0, 80))), "en") for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n ", "en"), (203, "x " * 3000, "en"), (204, "a b c\n" * 500, "en"), (None, "y y y y y y y", "en"), (7, "again again again again again again", "de"), (7, "again again again again again again", "de")]
    got = sorted(map(str, (tuple(r) for r in runs.run_digest(docs(spark, rows)).collect())))
    assert got == sorted(str(brute_digest(i, t)) for i, t, _ in rows)
    assert runs.run_digest(docs(spark, rows).limit(0)).count() == 0


def test_words_of_bytes():
    w = words.split(pa.array(["a B\tc", None, "", " x.y é", "z"]), b"\x20\x09", b".", lower=True)
    names = w.names.to_pylist()
    assert [names[c].decode() for c in w.code] == ["a", "b", "c", "x", "y", "é", "z"]
    assert w.ends.tolist() == [0, 3, 3, 3, 6, 7]
    assert (np.diff(w.piece) > 0).tolist() == [False, False, True, True, False, True]


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(tokenizer("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(codec):
    import public_tokenizers
    import tiktoken

    assert public_tokenizers.PATTERN == bytebpe.PATTERN
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks.of, special_tokens={})


def same(codec, library, texts):
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    raw, at = codec.decode(ids, bounds)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(t or ""), t
        assert raw[at[i] : at[i + 1]].tobytes() == (t or "").encode()


def test_bpe_as_the_library(codec, library):
    rng = random.Random(3)
    some = ["a", "b", "'s", "'", "'re", "'ll", "'l", "r", "e", "t", " ", "  ", "\n", "é", "日本", "1", "--", "\t", "😀", "the", "ing", "  \n", "<|endoftext|>"]
    same(codec, library, ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(5000)])
    same(codec, library, [None, "", " ", "x" * 5000, "ab" * 3000, "é" * 300, " " * 1000, "".join(rng.choice("abcdefghij") for _ in range(20000))])
    same(codec, library, [None])
    same(codec, library, [])


def test_bpe_of_every_character_class(codec, library):
    same(codec, library, [f"a{chr(i)}1{chr(i)} x" for i in range(0x3000) if not 0xD800 <= i < 0xE000])


def test_bpe_by_another_pattern(codec, library):
    plain = bytebpe.Codec(tokenizer("byte_bpe_multi_50k.tiktoken"), r"\S+|\s+")
    ids, bounds = plain.encode(pa.array(["some words, here", None]))
    raw, at = plain.decode(ids, bounds)
    assert raw[: at[1]].tobytes() == b"some words, here" and bounds[1] == bounds[2]


def test_long_and_short_merges_agree(codec):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randint(2, 64))) for _ in range(500)]
    assert bytebpe.merge_rows(pieces, 64, codec.ranks) == [bytebpe.merge_long(p, codec.ranks) for p in pieces]


def test_bpe_queries_of_odd_rows(spark, library):
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "Hello wörld's  end", "en"), (1, "Hello wörld's  end", "en"), (2, None, None), (3, "", "en"), (None, "x" * 3000, "en")]
    d = docs(spark, rows)
    got = sorted(map(str, (tuple(r) for r in bytebpe.digest(d, path).collect())))
    ids = lambda t: library.encode_ordinary(t or "")
    assert got == sorted(str((i, len(ids(t)), sha256(",".join(map(str, ids(t))).encode()).hexdigest(), sha256((t or "").encode()).hexdigest())) for i, t, _ in rows)
    back = bytebpe.decode(bytebpe.encode(d, path), path).collect()
    assert sorted(bytes(r["text"]).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bytebpe.digest(d.limit(0), path).count() == 0


def brute_phrases(rows, least, first):
    import re

    f, n = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in c.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(lang == x and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (x, v), b in c.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, some in out.items() for i, (s, a, p, x, y) in enumerate(sorted(some)[:first]))


@pytest.mark.parametrize("small", [False, True])
def test_phrases_by_brute_force(spark, monkeypatch, small):
    if small:  # many slices, a full filter, several arrays a mapper
        monkeypatch.setattr(phrases, "SLICE", 50)
        monkeypatch.setattr(phrases, "FILTER_BITS", 64)
        monkeypatch.setattr(phrases, "BLOCK", 8)
        monkeypatch.setattr(phrases, "TASK_WORDS", 20)
    rng = random.Random(6)
    some = ["Ab", "c", "é", "of the", "d.", "e,", "new york city", "x\n", "y"]
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 30))), rng.choice(["en", None, "de"])) for i in range(150)]
    rows += [(1, None, "en"), (2, "", "fr"), (3, "a b c d " * 2000, "long"), (3, "a b c d " * 2000, "long")]
    got = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows), least=20, first=40).collect())
    assert got == brute_phrases(rows, 20, 40)
    assert any(x[0] == "und" for x in got) and any(x[0] == "long" for x in got)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs(spark, [(1, None, None)])).count() == 0
    assert phrases.collocations(docs(spark, [(1, "a b", "en")]).limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 62, 50000).astype(np.uint64))
    h = phrases.PerfectHash(keys)
    assert np.array_equal(np.sort(h.slots(keys)), np.arange(len(keys)))
    assert len(phrases.PerfectHash(keys[:0]).slots(keys[:3])) == 3
