"""An offline embedder that is trained: token vectors by random indexing of the tokens they stand beside.

Co-occurrences are counted over the corpus (exact integers, combined in the mappers). A token's vector is the sum of its
neighbours' index vectors, each weighted by how much more often the two meet than chance would have it (positive pointwise
mutual information), scaled to length 1. An index vector has NONZERO entries of +1 or -1 at places a digest of the token
tells, so there is no table of them and no vocabulary on the driver. Tokens in alike company get alike vectors. A corpus's
model is a table (term, vec): write it once, then encode with it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import index_tokens
from sparkloom.session import written

DIMS, NONZERO, WINDOW = 64, 4, 2
BATCH = 4 << 20  # characters of the texts that are encoded together


def _tokens(text: Column | str) -> Column:
    return index_tokens(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def _pairs(docs: DataFrame, text: str, window: int) -> DataFrame:
    """one, two, n: each unordered pair of tokens once, `one` not after `two`, and how often the first meets the second. A token
    that stands beside itself meets itself from both sides, so such a pair counts twice."""
    toks = docs.select(_tokens(text).alias("t"))

    def apart(d: int) -> Column:
        n = F.size("t") - d
        return F.when(n > 0, F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(1 + d), n).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    met = toks.select(F.explode(F.concat(*[apart(d) for d in range(1, window + 1)])).alias("x"))
    counted = met.groupBy(F.least("x.a", "x.b").alias("one"), F.greatest("x.a", "x.b").alias("two")).agg(F.count("*").alias("n"))
    return counted.withColumn("n", F.when(F.col("one") == F.col("two"), 2 * F.col("n")).otherwise(F.col("n")))


def _both(pairs: DataFrame, one: list[Column], two: list[Column], *more: str) -> DataFrame:
    """A row from each side of unordered pairs: the columns `one`, seen from the other side `two`; one row for a token with itself."""
    sides = F.when(F.col("one") == F.col("two"), F.array(F.struct(*one))).otherwise(F.array(F.struct(*one), F.struct(*two)))
    return pairs.select(F.explode(sides).alias("s_"), *more).select("s_.*", *more)


def cooccurrences(docs: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """term, other, n: how often two tokens stand at most `window` places apart, in both orders."""
    one, two = F.col("one"), F.col("two")
    return _both(_pairs(docs, text, window), [one.alias("term"), two.alias("other")], [two.alias("term"), one.alias("other")], "n")


def _index_vector(term: str) -> Column:
    """A term's index vector in one number: for each of its NONZERO entries 6 bits of a place and a bit for the sign."""
    digest = F.md5(term)
    place = [F.pmod(F.conv(F.substring(digest, 2 * m + 1, 2), 16, 10).cast("int"), F.lit(DIMS)) for m in range(NONZERO)]
    return sum((F.shiftleft(place[m] + F.when(F.substring(digest, 9 + m, 1) < "8", DIMS).otherwise(0), 7 * m) for m in range(NONZERO)), F.lit(0))


def _unit(terms: pa.Array, wide: np.ndarray) -> pa.RecordBatch:
    """term, vec: scaled to length 1, left out where nothing is left."""
    length = np.sqrt((wide * wide).sum(1))
    kept = np.flatnonzero(length > 1e-9)
    vec = pa.FixedSizeListArray.from_arrays(pa.array((wide[kept] / length[kept, None]).ravel()), DIMS).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([terms.take(pa.array(kept)), vec], names=["term", "vec"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of rows (term, index, w) in order of term. A term's rows may go on over many batches; its sums are all that is held."""
    term, sums = None, None
    for b in batches:
        if not b.num_rows:
            continue
        code, index, w = b.column("term").dictionary_encode(), b.column("index").to_numpy(), b.column("w").to_numpy()
        names, at, wide = code.dictionary, code.indices.to_numpy().astype(np.int64) * DIMS, 0.0
        for m in range(NONZERO):
            entry = index >> 7 * m
            wide += np.bincount(at + (entry & DIMS - 1), np.where(entry & DIMS, w, -w), len(names) * DIMS)
        wide = wide.reshape(-1, DIMS)
        if term is not None and names[0].as_py() == term:
            wide[0] += sums
        elif term is not None:
            yield _unit(pa.array([term]), sums[None])
        term, sums = names[-1].as_py(), wide[-1].copy()
        yield _unit(names[:-1], wide[:-1])
    if term is not None:
        yield _unit(pa.array([term]), sums[None])


def token_vectors(pairs: DataFrame) -> DataFrame:
    """term, vec: the model of pairs as _pairs() gives them. A token that meets others no more often than by chance has no vector.

    Chance and counts are the same from both sides of a pair, so pairs are joined once each; index vectors are made once a term."""
    one, two = F.col("one"), F.col("two")
    totals = _both(pairs, [one.alias("term")], [two.alias("term")], "n").groupBy("term").agg(F.sum("n").alias("t"))
    totals = written(totals.withColumn("index", _index_vector("term")), "totals")
    whole = totals.agg(F.sum("t").alias("all"))  # one row
    pmi = F.log(F.col("n").cast("double") * F.col("all") / (F.col("t").cast("double") * F.col("o")))
    sides = [totals.select(F.col("term").alias(name), F.col("t").alias(t), F.col("index").alias(index)) for name, t, index in (("one", "t", "i"), ("two", "o", "j"))]
    kept = pairs.join(sides[0], "one").join(sides[1], "two").crossJoin(F.broadcast(whole)).select("one", "two", "i", "j", pmi.alias("w")).where("w > 0")
    kept = _both(kept, [one.alias("term"), F.col("j").alias("index")], [two.alias("term"), F.col("i").alias("index")], "w")
    return kept.repartition("term").sortWithinPartitions("term").mapInArrow(_summed, "term string, vec array<double>")


def fit(docs: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    return token_vectors(written(_pairs(docs, text, window), "pairs"))


def _batched(texts: DataFrame, keys: list[str], columns: list[str], model: DataFrame, run: Callable[[pa.Table, list[pa.Array], pa.Array, np.ndarray], dict], out: str) -> DataFrame:
    """keys and `out`, what run gives for batches of texts of about BATCH characters: it gets their rows, their tokens, and
    the batch's different terms that have a vector with these, once each. So vectors travel once a batch and not once a text,
    a batch is as large for many texts as for few, and one text is read whole."""
    letters = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(1))
    n = max(1, math.ceil((texts.agg(F.sum(letters)).first()[0] or 0) / BATCH))
    rows = texts.select(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("b_"), *keys, *[_tokens(c).alias(f"t_{i}") for i, c in enumerate(columns)])
    named = F.array_distinct(F.concat(*[f"t_{i}" for i in range(len(columns))]))
    terms = rows.select("b_", F.explode(named).alias("term")).distinct().join(model, "term").select(F.col("b_").alias("of_"), "term", "vec")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields)

    def one(mine: pa.Table, known: pa.Table) -> pa.Table:
        tokens = [mine[f"t_{i}"].combine_chunks() for i in range(len(columns))]
        vectors = known["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        return pa.table({**{k: mine[k] for k in keys}, **run(mine, tokens, known["term"].combine_chunks(), vectors)})

    return rows.groupBy("b_").cogroup(terms.groupBy("of_")).applyInArrow(one, f"{kinds}, {out}")


def _coded(tokens: list[pa.Array], terms: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of the tokens of each column, and the row of each number's vector: the last one, after all, if it has none."""
    code = pa.concat_arrays([terms, *[t.flatten() for t in tokens]]).dictionary_encode()
    every = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.minimum(np.arange(len(code.dictionary)), len(terms))  # terms come first and are different
    cuts = np.cumsum([len(terms), *[len(t.flatten()) for t in tokens]])
    return [every[a:b] for a, b in zip(cuts[:-1], cuts[1:])], row


def encode_all(texts: DataFrame, keys: list[str], columns: list[str], model: DataFrame) -> DataFrame:
    """keys and, for each column of texts, under its name the sum of the vectors of its tokens; zeros without any."""

    def run(mine: pa.Table, tokens: list[pa.Array], terms: pa.Array, vectors: np.ndarray) -> dict:
        codes, row = _coded(tokens, terms)
        vectors, out = np.vstack([vectors, np.zeros((1, DIMS))]), {}
        for c, t, code in zip(columns, tokens, codes):
            sums, ends = np.zeros((len(t), DIMS)), np.concatenate([[0], np.cumsum(pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False))])
            for i in range(len(t)):
                term, n = np.unique(code[ends[i] : ends[i + 1]], return_counts=True)
                sums[i] = n @ vectors[row[term]] if len(term) else 0.0
            out[c] = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), DIMS).cast(pa.list_(pa.float64()))
        return out

    return _batched(texts, keys, columns, model, run, ", ".join(f"`{c}` array<double>" for c in columns))


def encode(texts: DataFrame, keys: list[str], text: str, model: DataFrame) -> DataFrame:
    """keys, vec of one column."""
    return encode_all(texts, keys, [text], model).withColumnRenamed(text, "vec")


def _best(a: np.ndarray, b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Each row's best cosine among b's; equal tokens are alike wholly, also without a vector."""
    out = [(a[s : s + rows] @ b.T).max(1) for s in range(0, len(a), rows)]
    return np.where(np.isin(names_a, names_b), 1.0, np.concatenate(out))


def bert_scores(pairs: DataFrame, keys: list[str], model: DataFrame) -> DataFrame:
    """keys, bert_precision, bert_recall, bert_f1 of pairs(prediction, reference): every token's best cosine among the other
    text's tokens, averaged over the tokens of each side. Zeros where a text has no token."""

    def run(mine: pa.Table, tokens: list[pa.Array], terms: pa.Array, vectors: np.ndarray) -> dict:
        codes, row = _coded(tokens, terms)
        vectors = np.vstack([vectors, np.zeros((1, DIMS))])
        ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False))]) for t in tokens]
        scores = np.zeros((3, mine.num_rows))
        for i in range(mine.num_rows):
            (pn, pc_), (rn, rc) = (np.unique(code[e[i] : e[i + 1]], return_counts=True) for code, e in zip(codes, ends))
            if len(pn) and len(rn):
                pv, rv = vectors[row[pn]], vectors[row[rn]]
                p, r = _best(pv, rv, pn, rn) @ pc_ / pc_.sum(), _best(rv, pv, rn, pn) @ rc / rc.sum()
                scores[:, i] = p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0
        return dict(zip(("bert_precision", "bert_recall", "bert_f1"), scores))

    return _batched(pairs, keys, ["prediction", "reference"], model, run, "bert_precision double, bert_recall double, bert_f1 double")
