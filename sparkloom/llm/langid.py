"""Language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability. A word's probability is the sum over all
its segmentations into pieces, computed by a forward algorithm; a text's is the product over its words (runs of letters,
lower-cased). Probabilities are fitted by expectation-maximisation (forward-backward) on a bounded sample: at most
`SAMPLE_DOCS` labelled documents of each language, whose whole texts are counted by word in the executors. Predictions
read whole texts. Words repeat, so a worker scores each distinct word once and remembers it.

Every word is summed over all segmentations, however long it is: words of up to `SHORT` letters side by side, with
probabilities scaled by a constant for each character, longer ones (text without spaces) one by one, scaled at every
character. So nothing underflows. A text's score is the sum over its own words alone.

Null or empty texts and texts without a letter are `und` with score 0; so is everything if no row is labelled. Equal
scores go to the first language by name. Rows that repeat an id are predicted each; further columns aren't read; an
empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SAMPLE_DOCS, EM_ROUNDS = 400, 4
SHORT = 32  # letters of words that are summed side by side; the longer ones' sums are the same
SCALE = 1e5  # factor of a probability for each character of its piece
TINY = 1e-300
PRIOR = 200.0  # pseudo-counts of the pooled distribution in each language's
CACHE_WORDS = 400_000
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's pieces that are text (bytes and control pieces left out)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)


class Vocabulary:
    """Finds the piece of every substring of many words at once, by rolling hashes in an open table."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.zeros(len(self.pieces), np.uint64)
        for n in sorted({len(p) for p in self.pieces}):
            at = [k for k, p in enumerate(self.pieces) if len(p) == n]
            c = _codes([self.pieces[k] for k in at], n)
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * _BASE + c[:, j]
            hashes[at] = h
        self.keys = np.zeros((1 << _BITS) + 64, np.uint64)
        self.ids = np.full((1 << _BITS) + 64, -1, np.int32)
        self.reach = 0
        for k, h in enumerate(hashes):
            s = int(h) * int(_MIX) % (1 << 64) >> 64 - _BITS
            p = 0
            while self.ids[s + p] >= 0:
                p += 1
            self.keys[s + p], self.ids[s + p], self.reach = h, k, max(self.reach, p)

    def find(self, h: np.ndarray) -> np.ndarray:
        s = (h * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        out = np.where(self.keys[s] == h, self.ids[s], -1)
        todo = np.flatnonzero((out < 0) & (self.ids[s] >= 0))
        for p in range(1, self.reach + 1):
            if not len(todo):
                break
            at = s[todo] + p
            out[todo] = np.where(self.keys[at] == h[todo], self.ids[at], -1)
            todo = todo[(out[todo] < 0) & (self.ids[at] >= 0)]
        return out

    def spans(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(end, length) -> the piece of each word there; -1 none, -2 an unknown single character."""
        n = codes.shape[1]
        out = {}
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = h * _BASE + codes[:, i + k - 1]
                ids = self.find(h)
                if k == 1:
                    ids = np.where(ids < 0, -2, ids)
                if (ids != -1).any():
                    out[i + k, k] = ids
        return out


    def starts(self, codes: np.ndarray) -> np.ndarray:
        """[start, length - 1] -> the piece of one long word there; -1 none, -2 an unknown single character."""
        n = len(codes)
        out = np.full((n, min(self.longest, n)), -1, np.int32)
        h = np.zeros(n, np.uint64)
        for k in range(1, out.shape[1] + 1):
            h = h[: n - k + 1] * _BASE + codes[k - 1 :]
            out[: n - k + 1, k - 1] = self.find(h)
        out[out[:, 0] < 0, 0] = -2
        return out


def forward(spans: dict, n: int, prob: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: the summed probability of all segmentations of the first j characters, times SCALE**j; prob has 2 more
    rows than pieces: row -2 for unknown characters, row -1 of zeros."""
    words = len(next(iter(spans.values())))
    alpha = [np.ones((words, prob.shape[1]))]
    for j in range(1, n + 1):
        a = np.zeros((words, prob.shape[1]))
        for k in range(1, j + 1):
            ids = spans.get((j, k))
            if ids is not None:
                a += alpha[j - k] * (prob[ids] * SCALE**k)
        alpha.append(a)
    return alpha


def forward_long(starts: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one long word: alpha[j] over the greatest of its window, and the logarithm of the factor taken out."""
    n, longest = starts.shape
    alpha, factor = np.zeros((n + 1, prob.shape[1])), np.zeros((n + 1, prob.shape[1]))
    alpha[0] = 1
    held = np.zeros((longest, prob.shape[1]))  # what the pieces that end at j, j+1, .. have brought so far
    log = np.zeros(prob.shape[1])
    for i in range(n):
        ids = starts[i]
        fit = np.flatnonzero(ids != -1)
        held[fit] += alpha[i] * prob[ids[fit]]
        a = held[0].copy()
        most = np.maximum(np.maximum(a, held[1:].max(axis=0)) if longest > 1 else a, TINY)
        held[:-1] = held[1:] / most
        held[-1] = 0
        log = log + np.log(most)
        alpha[i + 1], factor[i + 1] = a / most, log
    return alpha, factor


class Model:
    def __init__(self, langs: list[str], vocabulary: Vocabulary, prob: np.ndarray):
        self.langs, self.vocabulary, self.prob, self.key = langs, vocabulary, prob, uuid.uuid4().hex

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > SHORT:
                alpha, factor = forward_long(self.vocabulary.starts(_codes(["▁" + w], len(w) + 1)[0]), self.prob)
                out[k] = np.log(np.maximum(alpha[-1], TINY)) + factor[-1]
            elif w:
                by.setdefault(len(w), []).append(k)
        for n, at in by.items():
            for first in range(0, len(at), 50_000):
                some = at[first : first + 50_000]
                spans = self.vocabulary.spans(_codes(["▁" + words[k] for k in some], n + 1))
                out[some] = np.log(np.maximum(forward(spans, n + 1, self.prob)[-1], TINY)) - (n + 1) * np.log(SCALE)
        return out


def _fit_counts(vocabulary: Vocabulary, counted: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language's words under prob (one column)."""
    total = np.zeros(len(prob))
    by: dict[int, list[str]] = {}
    for w in counted:
        if len(w) > SHORT:
            _count_long(vocabulary.starts(_codes(["▁" + w], len(w) + 1)[0]), prob, counted[w], total)
        else:
            by.setdefault(len(w), []).append(w)
    for n, every in by.items():
        for first in range(0, len(every), 20_000):
            words = every[first : first + 20_000]
            weight = np.array([counted[w] for w in words], float)
            spans = vocabulary.spans(_codes(["▁" + w for w in words], n + 1))
            alpha = forward(spans, n + 1, prob)
            beta = [np.zeros((len(words), 1)) for _ in range(n + 1)] + [np.ones((len(words), 1))]
            for j in range(n + 1, 0, -1):
                for k in range(1, j + 1):
                    if (ids := spans.get((j, k))) is not None:
                        step = prob[ids] * SCALE**k * beta[j]
                        beta[j - k] += step
                        np.add.at(total, ids, (weight[:, None] * alpha[j - k] * step / np.maximum(alpha[-1], TINY))[:, 0])
    total[-1] = 0
    return total


def _count_long(starts: np.ndarray, prob: np.ndarray, weight: int, total: np.ndarray) -> None:
    """Add the expected piece counts of one long word."""
    alpha, factor = forward_long(starts, prob)
    n, longest = starts.shape
    end = np.log(max(alpha[-1, 0], TINY)) + factor[-1, 0]
    # beta[j] = log probability of what follows j, over all segmentations
    beta = np.full(n + longest + 1, -np.inf)
    beta[n] = 0.0
    for i in range(n - 1, -1, -1):
        fit = np.flatnonzero(starts[i] != -1)
        p = prob[starts[i, fit], 0]
        some = np.where(p > 0, np.log(np.maximum(p, TINY)), -np.inf) + beta[i + 1 + fit]
        most = some.max()
        if most == -np.inf:
            continue
        rel = np.exp(some - most)
        beta[i] = most + np.log(rel.sum())
        ahead = np.log(max(alpha[i, 0], TINY)) + factor[i, 0]
        np.add.at(total, starts[i, fit], weight * np.exp(np.minimum(ahead + some - end, 0.0)))


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")))


_WORD = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word stands in each slice's texts of a language."""
    for b in slices(batches, "text", 1 << 22):
        lists = words_of(b.column("text").cast(pa.string()))
        whose = pc.take(b.column("lang"), pc.list_parent_indices(lists))
        got = pa.table({"lang": whose, "word": lists.flatten()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield pa.RecordBatch.from_arrays([got["lang"].combine_chunks(), got["word"].combine_chunks(), got["count_all"].combine_chunks()], schema=_WORD)


def fit(counts: dict[str, dict[str, int]], vocabulary: Vocabulary) -> Model | None:
    """From how often each word occurs in each language."""
    counts = {lang: {w: n for w, n in sorted(c.items()) if w} for lang, c in counts.items() if lang is not None}
    langs = sorted(x for x, c in counts.items() if c)
    if not langs:
        return None
    v = len(vocabulary.pieces)

    def dist(x: np.ndarray) -> np.ndarray:
        out = np.concatenate([x[:v] / max(x[: v + 1].sum(), 1e-9), [max(x[v] / max(x[: v + 1].sum(), 1e-9), 1e-7), 0.0]])
        return out

    tables = [np.concatenate([np.full(v, 1 / v), [1e-7, 0.0]]) for _ in langs]
    for _ in range(EM_ROUNDS):
        seen = [_fit_counts(vocabulary, counts[lang], t[:, None]) for lang, t in zip(langs, tables)]
        pooled = dist(sum(s / max(1.0, s.sum()) for s in seen) + np.concatenate([np.full(v, 1e-7), [0.0, 0.0]]))
        tables = [dist(s + PRIOR * pooled) for s in seen]
    return Model(langs, vocabulary, np.stack(tables, axis=1))


class _Scorer:
    """A worker's memory of words."""

    def __init__(self, model: Model):
        self.model, self.index, self.logs = model, {}, np.zeros((0, len(model.langs)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        lists = words_of(texts)
        words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.index, self.logs = {}, self.logs[:0]
        new = [w for w in names if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.logs = np.concatenate([self.logs, self.model.words(new)])
        place = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        logs = self.logs[place[coded.indices.to_numpy()]] if len(names) else np.zeros((0, len(self.model.langs)))
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        logs[empty] = 0
        n = np.concatenate([[0], np.cumsum(~empty)])
        total, full = np.zeros((len(lists), logs.shape[1])), np.flatnonzero(np.diff(ends))
        if len(full):  # each text's own words alone are added
            total[full] = np.add.reduceat(logs, ends[full], axis=0)
        return total, n[ends[1:]] - n[ends[:-1]]


_scorers: dict[str, _Scorer] = {}


def _predicter(model, out: tuple[str, str], text: str = "_sl_text", keep: bool = False):
    """keep: the texts come out again; they are handed over once, whoever reads them."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        if m.key not in _scorers:
            _scorers.clear()
            _scorers[m.key] = _Scorer(m)
        for b in slices(batches, text, 1 << 22):
            logs, n = _scorers[m.key].texts(pc.fill_null(b.column(text).cast(pa.string()), ""))
            best = np.argmax(logs, axis=1)
            # the odds of the languages, softened as if words came in runs of sqrt(n)
            x = (logs - logs.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
            p = 1 / np.exp(x).sum(axis=1)
            lang = [m.langs[k] if c else "und" for k, c in zip(best, n)]
            names = [x for x in b.schema.names if keep or x != text]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(lang, pa.string()), pa.array(np.where(n > 0, p, 0.0))], names=[*names, *out])

    return predict


def train(docs: DataFrame, vocabulary_file: str, where: Column | None = None) -> Model | None:
    """Fit on the documented sample: for each language, the labelled documents that come first by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled if where is None else labelled.where(where)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS).select("doc_id")
    # SAMPLE_DOCS ids a language; what comes to the driver is the number of each word, not the texts
    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(words[k].to_pylist() for k in ("lang", "word", "n"))):
        counts.setdefault(lang, {})[word] = n
    return fit(counts, Vocabulary(pieces_of(vocabulary_file)))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every document."""
    rows = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"))
    if model is None:
        out = rows.select("_sl_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = rows.mapInArrow(_predicter(docs.sparkSession.sparkContext.broadcast(model), ("lang_pred", "score")), "_sl_id long, lang_pred string, score double")
    return out.withColumnRenamed("_sl_id", id_col)


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 3) = 1"


def held_out_predictions(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from documents whose crc32 leaves another remainder than 1."""
    model = train(docs, vocabulary_file, ~F.expr(HELD_OUT))
    return predict(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, vocabulary_file: str, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with a score of `least` or more, `lang` set to it; `und` goes."""
    model = train(docs.select("doc_id", "text", "lang"), vocabulary_file)
    if model is None:
        return docs.limit(0)
    schema = T.StructType([*docs.schema.fields, T.StructField("_sl_lang", T.StringType()), T.StructField("_sl_score", T.DoubleType())])
    found = docs.mapInArrow(_predicter(docs.sparkSession.sparkContext.broadcast(model), ("_sl_lang", "_sl_score"), "text", True), schema)
    good = found.where((F.col("_sl_lang") != "und") & (F.col("_sl_score") >= least))
    return good.withColumn("lang", F.col("_sl_lang")).select(docs.columns)
