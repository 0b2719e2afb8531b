"""Phrases whose words stand together more often than their parts alone: collocations of two to four words, by language.

Words are counted first, then candidates are found level by level: a phrase may only be frequent if both phrases it has that
are a word shorter are (Apriori). A filter of fixed size with no false negative carries that to the mappers, and each of them
reports the phrases left with a count that stops at `least`; the sum of such counts reaches `least` exactly if the phrase's
frequency does. A minimal perfect hash numbers the candidates found; mappers count occurrences by these numbers in numpy
arrays (the words that stand in a slot are compared, so no other phrase counts), and the arrays are summed in a tree. A
candidate's cuts are read from these counts by a join on the phrase, because slices of candidates are counted apart.

What is bounded: the filter by FILTER_BITS, a slice of candidates and its hash by SLICE (there are more slices, each with its
own pass, where there are more candidates), a mapper's share of words by TASK_WORDS. These two alone go through the driver, one
at a time. Nothing is dropped at any size: a full filter lets more phrases be reported, no fewer.

Defined results: null texts are empty, null languages `und`; a table without a phrase that is frequent enough gives no row.
Rows that repeat a doc_id count as they stand. Texts of any length are read whole. Further columns are ignored. Ties in score
and frequency go to the phrase that comes first in UTF-8 byte order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import words
from .common import materialise, release, slices

LONGEST, GAPS, BREAKS = 4, b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
FILTER_BITS, SLICE, TASK_WORDS, BATCH_BYTES = 1 << 26, 1 << 21, 500_000, 2_000_000
#: Slots of a slice that are summed as one array, and arrays that are summed in one step of the tree.
BLOCK, FAN = 1 << 16, 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of which each depends on all."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def chained(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase (or language) that goes on with a word."""
    return mixed(state * _A + word)


class PerfectHash:
    """Numbers 0..n-1 for n different keys (hashes of phrases), level by level: a key that is alone at its place is settled,
    the others go on to the next level; a slot is the rank of its bit. A key that isn't in the set gets some slot or -1, so
    who asks compares what is stored there. `last` holds keys that some 40 levels haven't parted: equal ones are an error."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels, base = [], 0
        left, self.n = keys, len(keys)
        for level in range(40):
            if not len(left):
                break
            size = max(64, int(gamma * len(left)))
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + base, -1).astype(np.int32)
            self.levels.append(rank)
            base += int(alone.sum())
            left = left[~alone[at]]
        self.last = np.sort(left)
        if len(np.unique(self.last)) < len(self.last):
            raise ValueError("equal keys")
        self.base = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * int(_A) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(keys[open_], level, len(rank))]
            out[open_] = found
            open_ = open_[found < 0]
            if not len(open_):
                return out
        if len(self.last) and len(open_):
            at = np.minimum(np.searchsorted(self.last, keys[open_]), len(self.last) - 1)
            out[open_] = np.where(self.last[at] == keys[open_], self.base + at, -1)
        return out


# -- texts as numbers ------------------------------------------------------------------------------------------------


class Share:
    """A mapper's part of the text as numbers: lang and word of each occurrence, and how many words of its piece follow
    (LONGEST, where there are more)."""

    def __init__(self, batches: list[pa.RecordBatch]):
        langs, codes, rest, names = [], [], [], []
        lang_names: dict[str, int] = {}
        n = 0
        for b in batches:
            parts = words.split(b.column("text"), GAPS, BREAKS, lower=True)
            of = np.array([lang_names.setdefault("und" if x is None else x, len(lang_names)) for x in b.column("lang").to_pylist()], np.int64)
            langs.append(np.repeat(of.astype(np.int32), np.diff(parts.ends)))
            codes.append((parts.code + n).astype(np.int32))
            names.append(parts.names)
            n += len(parts.names)
            rest.append(np.minimum(_following(parts.piece), LONGEST).astype(np.int8))
        every = pa.chunked_array(names).dictionary_encode().combine_chunks() if names else pa.array([], pa.binary()).dictionary_encode()
        every = every.combine_chunks() if isinstance(every, pa.ChunkedArray) else every
        self.names, self.lang_names = every.dictionary, list(lang_names)
        number = every.indices.to_numpy()
        self.word = number[np.concatenate(codes)] if codes else np.zeros(0, np.int64)
        self.lang = np.concatenate(langs) if langs else np.zeros(0, np.int64)
        self.rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the languages and of the words."""
        lang = np.array([xxh3_64_intdigest(x) for x in self.lang_names], np.uint64)
        return mixed(lang), np.array([xxh3_64_intdigest(x) for x in self.names.to_pylist()], np.uint64)


def _following(piece: np.ndarray) -> np.ndarray:
    """How many words come after each in its piece."""
    if not len(piece):
        return np.zeros(0, np.int64)
    last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
    return np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece))


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[Share]:
    """The partition in parts of some TASK_WORDS words (one text at least)."""
    some, size = [], 0
    for b in slices(batches, "text", BATCH_BYTES):
        some.append(b)
        size += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if size >= 6 * TASK_WORDS:
            yield Share(some)
            some, size = [], 0
    if some:
        yield Share(some)


# -- words and candidates --------------------------------------------------------------------------------------------


def _distinct(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, counts) of different rows; columns of small numbers."""
    key = cols[0].astype(np.int64)
    for c in cols[1:]:
        top = int(c.max()) + 1 if len(c) else 1
        if len(key) and int(key.max()) >= (1 << 62) // top:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + c
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word), f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shares(batches):
            first, n = _distinct(s.lang, s.word)
            yield pa.RecordBatch.from_arrays([pa.array(s.lang_names, pa.string()).take(pa.array(s.lang[first])), s.names.take(pa.array(s.word[first])).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def filter_of(phrases: DataFrame) -> Broadcast:
    """A bit for every phrase (lang, phrase), by hash: FILTER_BITS at most, whatever is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _hashes(b.column("lang").to_pylist(), b.column("phrase").to_pylist()) % np.uint64(FILTER_BITS)
            cell, bit = np.divmod(keys.astype(np.int64), 64)
            out = pd.DataFrame({"cell": cell, "bits": np.left_shift(np.uint64(1), bit.astype(np.uint64)).view(np.int64)})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits)


def _hashes(langs: list[str], told: list[str]) -> np.ndarray:
    """Of phrases that have equally many words."""
    numbers = lambda xs: np.fromiter(map(xxh3_64_intdigest, xs), np.uint64, len(told))
    state = mixed(numbers(langs))
    for column in zip(*(p.split(" ") for p in told)):
        state = chained(state, numbers(column))
    return state


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell, bit = np.divmod((keys % np.uint64(64 * len(bits))).astype(np.int64), 64)
    return bits[cell] >> bit & 1 == 1


def _reported(s: Share, k: int, bits: np.ndarray, least: int) -> pa.RecordBatch:
    """Phrases of k words of a share whose shorter parts are in the filter, and how often they come, up to `least`."""
    n = len(s.word)
    known = np.zeros(n + 1, bool)  # the phrase of k - 1 words here is frequent
    at = np.flatnonzero(s.rest >= k - 2)
    lang_hash, word_hash = s.hashes()
    state = lang_hash[s.lang[at]]
    for j in range(k - 1):
        state = chained(state, word_hash[s.word[at + j]])
    known[at] = _held(bits, state)
    at = np.flatnonzero((s.rest >= k - 1) & known[:-1] & known[1:])
    cols = [s.word[at + j] for j in range(k)]
    first, count = _distinct(s.lang[at], *cols)
    told = pc.binary_join_element_wise(*[s.names.take(pa.array(c[first])) for c in cols], b" ") if len(first) else pa.array([], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(s.lang_names, pa.string()).take(pa.array(s.lang[at][first])), told.cast(pa.string()), pa.array(np.minimum(count, least), pa.int64())], names=["lang", "phrase", "n"])


def candidates(docs: DataFrame, k: int, shorter: Broadcast, least: int) -> DataFrame:
    """lang, phrase: phrases of k words that come `least` times, given the filter of those of k - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shares(batches):
            out = _reported(s, k, shorter.value, least)
            del s
            for at in range(0, out.num_rows, 1 << 16):
                yield out.slice(at, 1 << 16)

    found = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "phrase")


# -- counting by slot ------------------------------------------------------------------------------------------------


class Table:
    """A slice of candidates: the words of all of them, and by slot the language and the words that stand there."""

    def __init__(self, langs: list[str], phrases: list[str]):
        self.langs = sorted(set(langs))
        parts = [p.split(" ") for p in phrases]
        self.words = sorted({w for p in parts for w in p})
        number, of_lang = {w: i for i, w in enumerate(self.words)}, {x: i for i, x in enumerate(self.langs)}
        lang = np.array([of_lang[x] for x in langs], np.int64)
        word = np.full((len(parts), LONGEST), -1, np.int64)
        for i, p in enumerate(parts):
            word[i, : len(p)] = [number[w] for w in p]
        keys = np.zeros(len(parts), np.uint64)
        for k in range(2, LONGEST + 1):
            some = np.flatnonzero((word >= 0).sum(1) == k)
            keys[some] = self.keys(lang[some], [word[some, j] for j in range(k)])
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        self.lang, self.word = np.empty_like(lang), np.empty_like(word)
        self.lang[slot], self.word[slot] = lang, word

    @staticmethod
    def keys(lang: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
        state = mixed(lang.astype(np.uint64) + np.uint64(len(cols) * int(_C) % 2**64))
        for c in cols:
            state = chained(state, c.astype(np.uint64))
        return state

    def count(self, s: Share) -> np.ndarray:
        """Occurrences in a share of every slot's phrase."""
        total = np.zeros(self.hash.n, np.int64)
        number = pc.fill_null(pc.index_in(s.names, pa.array(self.words, pa.string()).cast(pa.binary())), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        places = {x: i for i, x in enumerate(self.langs)}
        of_lang = np.array([places.get(x, -1) for x in s.lang_names], np.int64)
        word, lang = number[s.word], of_lang[s.lang] if len(s.lang) else s.lang
        ok = (word >= 0) & (lang >= 0)
        for k in range(2, LONGEST + 1):
            at = np.flatnonzero(ok & (s.rest >= k - 1))
            for j in range(1, k):
                at = at[word[at + j] >= 0]
            if not len(at):
                continue
            cols = [word[at + j] for j in range(k)]
            slot = self.hash.slots(self.keys(lang[at], cols))
            same = (slot >= 0) & (self.lang[slot] == lang[at])
            for j in range(LONGEST):
                same &= self.word[slot, j] == (cols[j] if j < k else -1)
            total += np.bincount(slot[same], minlength=len(total))
        return total

    def phrases(self) -> tuple[list[str], list[str]]:
        """By slot."""
        return [self.langs[x] for x in self.lang], [" ".join(self.words[w] for w in row if w >= 0) for row in self.word]


def slot_counts(docs: DataFrame, table: Broadcast) -> DataFrame:
    """slot, a: the arrays of all mappers, summed in a tree, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Table = pickle.loads(table.value)
        total = np.zeros(t.hash.n, np.int64)
        for s in shares(batches):
            total += t.count(s)
        starts = [s for s in range(0, len(total), BLOCK) if total[s : s + BLOCK].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([part] * len(starts), pa.int64()), pa.array([total[s : s + BLOCK].tobytes() for s in starts], pa.binary())], names=["start", "part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["counts"] = [np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0).tobytes()]
        return out

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0)
        return pd.DataFrame({"slot": pdf["start"].iloc[0] + np.arange(len(a)), "a": a})

    kind = "start long, part long, counts binary"
    # any deal of the arrays over the branches gives the same sums
    leaves = docs.select("lang", "text").mapInArrow(run, kind)
    branches = leaves.groupBy("start", F.pmod("part", F.lit(FAN)).alias("branch")).applyInPandas(add, kind)
    return branches.groupBy("start").applyInPandas(read, "slot long, a long")


def counted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a of all candidates: slice by slice, each with its own hash and pass."""
    spark, n = docs.sparkSession, found.count()
    slices_ = max(1, -(-n // SLICE))
    dealt = found.withColumn("slice", F.pmod(F.xxhash64("lang", "phrase"), F.lit(slices_)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "body": [pickle.dumps(Table(pdf["lang"].tolist(), pdf["phrase"].tolist()))]})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, body in zip(b.column("slice").to_pylist(), b.column("body").to_pylist()):
                langs, told = pickle.loads(body).phrases()
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(told), pa.int32()), pa.array(range(len(told)), pa.int64()), pa.array(langs), pa.array(told)], names=["slice", "slot", "lang", "phrase"])

    tables = materialise(dealt.groupBy("slice").applyInPandas(build, "slice int, body binary"), "phrase-tables")
    out = None
    for row in tables.select("slice").orderBy("slice").toLocalIterator():  # a number a slice
        body = tables.where(F.col("slice") == row["slice"]).first()["body"]  # bounded by SLICE
        some = slot_counts(docs, spark.sparkContext.broadcast(bytes(body))).withColumn("slice", F.lit(row["slice"]))
        out = some if out is None else out.unionByName(some)
    if out is None:
        release(tables)
        return spark.createDataFrame([], "lang string, phrase string, a long")
    keys = tables.mapInArrow(spell, "slice int, slot long, lang string, phrase string")
    done = materialise(out.join(keys, ["slice", "slot"]).select("lang", "phrase", "a"), "phrase-counts")
    release(tables)
    return done


# -- scores ----------------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, covered: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` best phrases."""
    docs = docs.select("lang", "text")
    every = materialise(word_counts(docs), "word-counts")
    n = every.groupBy("lang").agg(F.sum("f").alias("n"))  # a row a language
    single = every.where(F.col("f") >= least)
    shorter, levels = filter_of(single), []
    for k in range(2, LONGEST + 1):
        levels.append(materialise(candidates(docs, k, shorter, least), f"phrases-{k}"))
        shorter.unpersist()
        if k < LONGEST:
            shorter = filter_of(levels[-1])
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    a = counted(docs, found)
    for x in levels:
        release(x)
    known = single.select("lang", "phrase", F.col("f").alias("a")).unionByName(a)
    # a cut after k words: its two parts are as frequent as the phrase at least, so both are known
    w = a.withColumn("w", F.split("phrase", " "))
    cuts = w.select("lang", "phrase", "a", F.size("w").alias("size"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    of = lambda part, out: known.select("lang", F.col("phrase").alias(part), F.col("a").alias(out))
    read = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    # decimals: products may pass 64 bits
    exact = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = read.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))
    longer = w.where(F.size("w") > 2)
    inner = longer.select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    hidden = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(hidden, ["lang", "phrase"], "left").where(f"most IS NULL OR CAST(100 AS DECIMAL(4,0)) * CAST(most AS DECIMAL(19,0)) < CAST({covered} AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.select("lang", "phrase", "a", "x.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(F.broadcast(n), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
