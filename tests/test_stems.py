"""Stems against words of the published description and a second, procedural form."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import metrics, stems

PUBLISHED = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll skies sky dying die ties tie died die tied tie spied spi
enjoy enjoy by by geology geolog rationally ration news news say say cry cri""".split()


def is_vowel(w, i):
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not is_vowel(w, i - 1))


def shape(w):
    return re.sub(r"(.)\1+", r"\1", "".join("v" if is_vowel(w, i) else "c" for i in range(len(w))))


def measure(w):
    return shape(w).count("vc")


def short(w):
    kinds = ["v" if is_vowel(w, i) else "c" for i in range(len(w))]
    return (kinds[-3:] == ["c", "v", "c"] and w[-1] not in "wxy") or kinds == ["v", "c"]


def longest(w, rules, ok):
    found = [x for x in rules if w.endswith(x)]
    if not found:
        return w
    x = max(found, key=len)
    stem = w[: len(w) - len(x)]
    return stem + rules[x] if ok(stem, x) else w


def slow_stem(w):
    if w in stems.IRREGULAR:
        return stems.IRREGULAR[w]
    if len(w) <= 2:
        return w
    if len(w) == 4 and w.endswith("ies"):
        w = w[:3]
    else:
        w = longest(w, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda s, x: True)
    if w.endswith("ied"):
        w = w[:3] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in shape(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not is_vowel(w, len(w) - 1):
                w = w if w[-1] in "lsz" else w[:-1]
            elif measure(w) == 1 and short(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and not is_vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and measure(w[:-4]):
        w = w[:-2]
    w = longest(w, stems.STEP2, lambda s, x: measure(s + "l" if x == "logi" else s) > 0)
    w = longest(w, stems.STEP3, lambda s, x: measure(s) > 0)
    w = longest(w, dict.fromkeys(stems.STEP4, ""), lambda s, x: measure(s) > 1 and (x != "ion" or s[-1:] in ("s", "t")))
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def by_spark(spark, words):
    return spark.createDataFrame([(words,)], "w array<string>").select(stems.stems(F.col("w")).alias("s")).first()["s"]


def test_published_words(spark):
    words, want = PUBLISHED[::2], PUBLISHED[1::2]
    assert dict(zip(words, by_spark(spark, words))) == dict(zip(words, want)) == {w: slow_stem(w) for w in words}


def test_made_up_words(spark):
    import random

    rng = random.Random(5)
    parts = [*stems.STEP2, *stems.STEP3, *stems.STEP4, "ed", "ing", "s", "ies", "y", "yy", "eed", "ss", "ied", "e", "ll"]
    words = ["".join(rng.choice("abeilosty") for _ in range(rng.randint(0, 6))) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(4000)]
    got = by_spark(spark, words)
    assert [(w, s) for w, s in zip(words, got) if s != slow_stem(w)] == []


def test_rouge_by_stems_and_nulls(spark):
    rows = [(1, "The cats were hopping", "a cat hops"), (2, None, "x"), (3, "", ""), (4, "Hopes, goes", "hope goes")]
    df = spark.createDataFrame(rows, "k int, prediction string, reference string")
    n = {(r["k"], r["n"]): r["f"] for r in metrics.rouge_n(df, ["k"], stem=True).collect()}
    assert n[1, 1] == pytest.approx(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3)) and n[4, 2] == 1.0 and n[2, 1] == 0.0
    assert [r[0] for r in df.orderBy("k").select(metrics.rouge_l("prediction", "reference", stem=True)).collect()] == pytest.approx([n[1, 1], 0.0, 0.0, 1.0])


def slow_meteor(p, r):
    """All matches by two loops from the end, equal words before equal stems."""
    p, r = list(enumerate(p)), list(enumerate(r))
    match = []
    for same in (lambda a, b: a == b, lambda a, b: slow_stem(a) == slow_stem(b)):
        for x in reversed(list(p)):
            y = next((y for y in reversed(r) if same(x[1], y[1])), None)
            if y:
                match.append((x[0], y[0]))
                p.remove(x)
                r.remove(y)
    match.sort()
    chunks = sum(k == 0 or match[k] != (match[k - 1][0] + 1, match[k - 1][1] + 1) for k in range(len(match)))
    return match, chunks


def test_meteor_with_stems(spark):
    import random

    rng = random.Random(7)
    words = "hope hopes hoping cat cats run running runs the a happy happily".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(60)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, p string, r string").select("k", metrics.meteor("p", "r")).collect()}
    for k, p, r in rows:
        match, chunks = slow_meteor(p.split(), r.split())
        want = 0.0
        if match:
            a, b = len(match) / len(p.split()), len(match) / len(r.split())
            want = a * b / (0.9 * a + 0.1 * b) * (1 - 0.5 * (chunks / len(match)) ** 3)
        assert got[k] == pytest.approx(want)
