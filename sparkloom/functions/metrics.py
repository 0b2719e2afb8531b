"""Answer metrics: exact match, set-based token F1, ROUGE, BLEU, METEOR by equal words and stems."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stems import rouge_tokens, stems
from .text import _c, hash_embedding, index_tokens, let, metric_tokens, strip
from .vector import cosine

#: Weights of BLEU-1 to BLEU-4, and what smoothing puts for a precision of zero.
BLEU_WEIGHTS = ((1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.33, 0.33, 0.33, 0.0), (0.25, 0.25, 0.25, 0.25))
EPSILON = 0.1
#: White space of any kind, as a pattern.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def exact_match(prediction: Column | str, reference: Column | str) -> Column:
    return (F.lower(strip(prediction)) == F.lower(strip(reference))).cast("int")


def _f1(both: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0) & (both > 0), 2 * (both / a) * (both / b) / (both / a + both / b)).otherwise(F.lit(0.0))


def token_f1(prediction: Column | str, reference: Column | str) -> Column:
    """Over sets of tokens: repeats don't count."""
    a, b = F.array_distinct(metric_tokens(prediction)), F.array_distinct(metric_tokens(reference))
    return _f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def _common(p: list[str], r: list[str], most: int) -> list[int]:
    """For n = 1..most: clipped common n-grams, n-grams of p and of r."""
    out = []
    for n in range(1, most + 1):
        a, b = (Counter(zip(*(x[i:] for i in range(n)))) for x in (p, r))
        out += [sum(min(c, b[g]) for g, c in a.items() if g in b), max(len(p) - n + 1, 0), max(len(r) - n + 1, 0)]
    return out


def _plain_tokens(x: Column | str) -> Column:
    return index_tokens(F.lower(_c(x)))


def gram_counts(prediction: Column, reference: Column, most: int) -> Column:
    """_common() of two token arrays, as an array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_common(list(x) if x is not None else [], list(y) if y is not None else [], most) for x, y in zip(a, b)], dtype=object)

    return counts(prediction, reference)


def ngram_overlap(pairs: DataFrame, key: list[str], most: int, tokens_of=_plain_tokens) -> DataFrame:
    """For each pair and n = 1..most: clipped common n-grams, n-grams of the prediction and of the reference.

    Both texts stand in one row, so they are counted there: nothing is shuffled, and no n-gram becomes a row."""
    rows = pairs.select(*key, gram_counts(tokens_of("prediction"), tokens_of("reference"), most).alias("c"))
    parts = F.array(*[F.struct(F.lit(n).alias("n"), *[F.col("c")[3 * n - 3 + i].alias(c) for i, c in enumerate(("both", "in_prediction", "in_reference"))]) for n in range(1, most + 1)])
    return rows.select(*key, F.explode(parts).alias("x")).select(*key, "x.*")


def rouge_n(pairs: DataFrame, key: list[str], most: int = 2, stem: bool = False) -> DataFrame:
    """ROUGE-n F-measures: key, n, f. stem: words of over three letters count by their stem."""
    return ngram_overlap(pairs, key, most, rouge_tokens if stem else _plain_tokens).select(*key, "n", _f1(F.col("both"), F.col("in_prediction"), F.col("in_reference")).alias("f"))


def _lcs(a: list[str], b: list[str]) -> int:
    """A row of the usual table is one number: bit j is 0 where the row grows at j."""
    places: dict[str, int] = {}
    for j, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << j
    all_, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for t in a:
        both = row & places.get(t, 0)
        row = (row + both | row - both) & all_
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two token arrays."""
    for a, b in batches:
        yield pd.Series([_lcs(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lcs_and_sizes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[_lcs(list(x), list(y)), len(x), len(y)] if x is not None and y is not None else [0, 0, 0] for x, y in zip(a, b)], dtype=object)


def rouge_l(prediction: Column | str, reference: Column | str, stem: bool = False) -> Column:
    """Over whole texts. stem: as in rouge_n."""
    c = _lcs_and_sizes(*[(rouge_tokens if stem else _plain_tokens)(x) for x in (prediction, reference)])  # tokens are made once
    return _f1(c[0], c[1], c[2])


def _bleu(c: Column) -> list[Column]:
    """BLEU-1..4 of gram_counts() up to 4."""
    both, hyps, hyp, ref = [c[3 * i] for i in range(4)], [c[3 * i + 1] for i in range(4)], c[1], c[2]
    brevity = F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - ref / F.greatest(hyp, F.lit(1))))
    precision = [F.greatest(b.cast("double"), F.when(b == 0, F.lit(EPSILON)).otherwise(0.0)) / F.greatest(n, F.lit(1)) for b, n in zip(both, hyps)]
    logs = [sum((F.lit(w) * F.log(p) for w, p in zip(weights, precision) if w), F.lit(0.0)) for weights in BLEU_WEIGHTS]
    return [F.when(both[0] == 0, F.lit(0.0)).otherwise(brevity * F.exp(x)) for x in logs]


def bleu(pairs: DataFrame, key: list[str]) -> DataFrame:
    """BLEU-1..4 with the smoothing above: key, bleu1..bleu4; 0 where no word is common."""
    rows = pairs.select(*key, gram_counts(_plain_tokens("prediction"), _plain_tokens("reference"), 4).alias("c"))
    return rows.select(*key, *[x.alias(f"bleu{m}") for m, x in enumerate(_bleu(F.col("c")), 1)])


def _last_matches(p: dict[int, str], r: dict[int, str]) -> list[tuple[int, int]]:
    """Places of equal entries, the last ones first; both lose what is matched."""
    free: dict[str, list[int]] = {}
    for j in sorted(r):
        free.setdefault(r[j], []).append(j)
    out = [(i, free[p[i]].pop()) for i in sorted(p, reverse=True) if free.get(p[i])]
    for i, j in out:
        del p[i], r[j]
    return out


def meteor_score(prediction: list[str], reference: list[str], prediction_stems: list[str], reference_stems: list[str]) -> float:
    """METEOR by equal words, then by equal stems of what is left (synonyms need data that isn't here)."""
    p, r = dict(enumerate(prediction)), dict(enumerate(reference))
    match = _last_matches(p, r)
    match += _last_matches({i: prediction_stems[i] for i in p}, {j: reference_stems[j] for j in r})
    if not match:
        return 0.0
    match.sort()
    precision, recall = len(match) / len(prediction), len(match) / len(reference)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(match, match[1:]))
    return precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (chunks / len(match)) ** 3)


def meteor_exact(prediction: list[str], reference: list[str]) -> float:
    """By equal words alone."""
    return meteor_score(prediction, reference, prediction, reference)


@F.pandas_udf(T.DoubleType())
def _meteor(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([meteor_score(*map(list, row)) for row in zip(*columns)], dtype="float64")


def meteor(prediction: Column | str, reference: Column | str) -> Column:
    """Words lie between white space; null is empty."""
    p, r = (F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), SPACE), lambda t: t != "") for x in (prediction, reference))
    return _meteor(p, r, stems(p), stems(r))


def greedy_token_match(prediction: Column, reference: Column, similarity) -> Column:
    """One direction of BERTScore over token vectors given: mean of each prediction token's best similarity."""
    best = F.transform(prediction, lambda a: F.array_max(F.transform(reference, lambda b: similarity(a, b))))
    return F.when((F.size(prediction) > 0) & (F.size(reference) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(prediction)).otherwise(F.lit(0.0))


def bert_scores(prediction: Column | str, reference: Column | str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of greedy matching with the offline token embedder: equal tokens are alike, others not."""
    tokens = F.struct(index_tokens(F.lower(_c(prediction))).alias("p"), index_tokens(F.lower(_c(reference))).alias("r"))

    def share(a: Column, b: Column) -> Column:
        return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(F.lit(0.0))

    # tokens and shares are values of a lambda, so they are made once however often they are named
    both = let(tokens, lambda t: F.struct(share(t["p"], t["r"]).alias("p"), share(t["r"], t["p"]).alias("r")))
    f1 = let(both, lambda s: F.when(s["p"] + s["r"] > 0, 2 * s["p"] * s["r"] / (s["p"] + s["r"])).otherwise(F.lit(0.0)))
    return both["p"], both["r"], f1


RECORD = ("exact_match", "f1", "rouge1_f", "rouge2_f", "rougeL_f", "bleu1", "bleu2", "bleu3", "bleu4", "bert_f1", "meteor", "sbert_similarity")


def metric_record(pairs: DataFrame, key: list[str], stem: bool = True) -> DataFrame:
    """key and RECORD's twelve metrics; null or empty texts give zeros. Where a model is meant (bert_f1, sbert_similarity)
    the offline embedders stand in for it. stem: ROUGE by stems."""
    empty = (F.coalesce("prediction", F.lit("")) == "") | (F.coalesce("reference", F.lit("")) == "")
    base = pairs.select(*key, "prediction", "reference", empty.alias("empty"))
    tokens_of = rouge_tokens if stem else _plain_tokens
    out = base.withColumns({"c": gram_counts(_plain_tokens("prediction"), _plain_tokens("reference"), 4), "s": gram_counts(tokens_of("prediction"), tokens_of("reference"), 2)})
    p, r = F.coalesce("prediction", F.lit("")), F.coalesce("reference", F.lit(""))
    rouge = [_f1(*[F.col("s")[3 * n + i] for i in range(3)]) for n in range(2)]
    values = {
        "exact_match": exact_match(p, r).cast("double"), "f1": token_f1(p, r), "rougeL_f": rouge_l(p, r, stem=stem),
        "bert_f1": bert_scores(p, r)[2], "meteor": meteor(p, r), "sbert_similarity": cosine(hash_embedding(p), hash_embedding(r)),
        "rouge1_f": rouge[0], "rouge2_f": rouge[1], **{f"bleu{m}": x for m, x in enumerate(_bleu(F.col("c")), 1)},
    }
    return out.select(*key, *[F.when(F.col("empty"), F.lit(0.0)).otherwise(values[c]).alias(c) for c in RECORD])
