"""Evolution inside the stream: every turn meets those before it, as it comes.

A sample's index is the state of its key: its documents' vectors and term counts, a list that grows by what a batch brings. A
turn is indexed, asks with its content, and leaves with its best neighbours; what a micro-batch brought becomes one commit of facts, documents, vectors, links and marks, so a reader never sees a fact without its links.

A turn that comes again is left out. One that comes late, after turns that follow it in its sample, is indexed then: it meets
what is stored up to its own place, and those that came before it aren't asked again. In order, the stream gives what
operators.job.ingest_turns gives for the whole. State grows with a sample's turns, as its graph does, and stays with its key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from sparkloom import schemas
from sparkloom.functions.text import hash_embedding, index_document, index_tokens
from sparkloom.operators import bm25, retrieval
from sparkloom.operators.graph import both_ways
from sparkloom.session import written
from sparkloom.sources import graph_store

from . import ingest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEAR = "near array<struct<other:string,rank:int,cosine:double>>"
OUT = f"{schemas.NODES}, {NEAR}"


class Index(StatefulProcessor):
    """A sample's turns: rows of facts with doc_words, words, vec and doc_vec go in, facts with their neighbours come out.

    The state of a key is the list of its indexed documents: one read and one append a batch. Postings and frequencies of
    frequencies follow from it."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.docs = handle.getListState("docs", "seq long, node_id string, vec array<double>, words string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        index = _Postings()
        for doc in self.docs.get():
            index.add(*doc)
        fresh = []
        for r in sorted(rows, key=lambda r: r["node_seq"]):
            if r["node_seq"] in index.known:
                continue
            fresh.append((r["node_seq"], r["node_id"], list(r["doc_vec"]), r["doc_words"]))
            index.add(*fresh[-1])
            yield Row(**{f: r[f] for f in ingest.NODE_FIELDS}, near=index.nearest(r, self.k))
        if fresh:
            self.docs.appendList(fresh)


class _Postings:
    """What a sample's documents make: places, lengths and vectors, a posting list a term, how many terms have each frequency."""

    def __init__(self):
        self.ids: list[str] = []
        self.known: set[int] = set()
        self.posts: dict[str, tuple[list[int], list[int]]] = {}
        self.terms = [0]  # terms by document frequency, from 0
        self.seqs, self.lengths, self.vectors = np.zeros(16, np.int64), np.zeros(16), None

    def add(self, seq: int, node_id: str, vec: list[float], words: str) -> None:
        i, toks = len(self.ids), words.split(" ") if words else []
        if self.vectors is None:
            self.vectors = np.zeros((16, len(vec)))
        if i == len(self.seqs):
            self.seqs, self.lengths, self.vectors = (np.concatenate([x, np.zeros_like(x)]) for x in (self.seqs, self.lengths, self.vectors))
        self.seqs[i], self.lengths[i], self.vectors[i] = seq, len(toks), vec
        self.ids.append(node_id)
        self.known.add(seq)
        for t, tf in Counter(toks).items():
            at, often = self.posts.setdefault(t, ([], []))
            df = len(at)
            at.append(i)
            often.append(tf)
            if df:
                self.terms[df] -= 1
            if df + 1 == len(self.terms):
                self.terms.append(0)
            self.terms[df + 1] += 1

    def nearest(self, r: Row, k: int) -> list[Row]:
        """The k best documents up to the row's place by the hybrid score."""
        n, terms = len(self.ids), np.array(self.terms[1:])
        seqs, lengths, vectors = self.seqs[:n], self.lengths[:n], self.vectors[:n]
        idf = lambda df: np.log(n - df + 0.5) - np.log(df + 0.5)
        floor = bm25.EPSILON * (terms * idf(np.arange(1, len(terms) + 1))).sum() / terms.sum() if terms.sum() else 0.0
        norm = bm25.K1 * (1 - bm25.B + bm25.B * lengths / max(lengths.mean(), 1e-300))
        asked = [self.posts[t] for t in r["words"].split(" ")] if r["words"] else []
        df = np.array([len(at) for at, _ in asked], np.int64)
        w = np.repeat(np.where(idf(df) < 0, floor, idf(df)), df)
        at, tf = np.array([i for a, _ in asked for i in a], np.int64), np.array([c for _, often in asked for c in often], np.int64)
        sparse = np.bincount(at, w * tf * (bm25.K1 + 1) / (tf + norm[at]), n)
        mine = np.flatnonzero(seqs <= r["node_seq"])
        low, high = sparse[mine].min(), sparse[mine].max()
        scaled = (sparse[mine] - low) / (high - low) if high > low else np.zeros(len(mine))
        q = np.array(r["vec"])
        length = np.sqrt((vectors[mine] ** 2).sum(1)) * np.sqrt((q**2).sum())
        cosine = np.round(np.divide(vectors[mine] @ q, length, out=np.zeros(len(mine)), where=length > 0), 9)
        score = np.round(retrieval.ALPHA * (cosine + 1) / 2 + (1 - retrieval.ALPHA) * scaled, 9)
        best = np.lexsort((-seqs[mine], -score))[:k]
        return [Row(other=self.ids[mine[i]], rank=j + 1, cosine=float(cosine[i])) for j, i in enumerate(best)]


def evolving(turns: DataFrame, k: int) -> DataFrame:
    """Facts of a stream of turns (or of a table, which is one batch), each with `near`, its k best neighbours."""
    doc = index_document("content", "context", "keywords", "tags")
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the store that keeps several states a key
    spark.streams.active  # noqa: B018  (starts what coordinates states, which a table's one batch needs as well)
    rows = ingest.facts(turns).withColumns({"doc": doc}).withColumns({"doc_words": F.array_join(index_tokens("doc"), " "), "words": F.array_join(index_tokens("content"), " "), "vec": hash_embedding("content"), "doc_vec": hash_embedding("doc")})
    return rows.drop("doc").groupBy("sample_id").transformWithState(Index(k), OUT, "append", "none")


def links(rows: DataFrame, alike: float = 0.8) -> DataFrame:
    """sample_id, src, dst: facts and those of their neighbours that are alike enough, both ways."""
    pairs = rows.select("sample_id", F.col("node_id").alias("src"), F.explode("near").alias("x")).where(F.col("x.cosine") >= alike)
    return both_ways(pairs.select("sample_id", "src", F.col("x.other").alias("dst"))).distinct()


def write_batch(rows: DataFrame, root: str, key: str, version: int, alike: float) -> int:
    """One micro-batch of facts with neighbours as one commit; a batch whose key is committed is left out."""
    spark = rows.sparkSession
    if key and graph_store.committed(spark, root, "facts", key):
        return 0
    rows = written(rows.withColumn("version", F.lit(version).cast("long")), "stream-facts")
    docs = ingest.documents(rows)
    stored = graph_store.load(spark, root, "edges").select("sample_id", "src", "dst")
    edges = links(rows, alike).join(stored, ["sample_id", "src", "dst"], "left_anti").select("*", F.lit(0).cast("long").alias("edge_seq"), F.lit("persona_related").alias("type"), F.lit(None).cast("double").alias("weight"), F.lit(version).cast("long").alias("version"))
    with graph_store.Commit(spark, root, "facts", key) as c:
        n = c.add(rows, "nodes")
        c.add(docs, "docs")
        c.add(ingest.vectors(docs), "embeddings")
        c.add(edges, "edges")
        c.add(rows, "evolved")
    return n


def ingest_evolving(spark: SparkSession, source: str, schema: str, root: str, max_files: int = 10, k: int = 5, alike: float = 0.8) -> StreamingQuery:
    """Everything new in a folder of Parquet turns, with the links that evolution gives. Start it again to go on."""
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(df: DataFrame, batch_id: int) -> None:
        stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(df, root, f"{stream}:{batch_id}" if stream else "", 0, alike)

    return evolving(turns, k).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()
