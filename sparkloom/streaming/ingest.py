"""Incremental ingest of turns into the memory graph.

Which neighbours a turn finds depends on earlier turns' texts alone, so a micro-batch of turns is a set operation. Node
ids are hashes of sample, level and place: a turn that comes again replaces its row, so delivery at least once gives
each fact once. Progress is the stream's own checkpoint; what is derived can always be rebuilt from nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom import schemas
from sparkloom.functions.text import hash_embedding, index_document, utterance
from sparkloom.operators.providers import annotate
from sparkloom.sources import graph_store


#: Columns of facts() in order.
NODE_FIELDS = tuple(x.strip().split(" ")[0] for x in schemas.NODES.replace("map<string,string>", "map").split(","))


def node_id(sample: Column | str, level: str, key: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", sample, F.lit(level), F.col(key).cast("string") if isinstance(key, str) else key), 256)


def facts(turns: DataFrame, version: Column | int = 0) -> DataFrame:
    """Nodes of turns (sample_id, turn_seq, date_time, speaker, text)."""
    note = annotate("text")
    return turns.select(
        "sample_id", node_id("sample_id", "fact", "turn_seq").alias("node_id"), F.col("turn_seq").alias("node_seq"), F.lit("fact").alias("level"), utterance("speaker", "text").alias("content"), F.col("date_time").alias("timestamp"), note["keywords"].alias("keywords"), note["context"].alias("context"), note["tags"].alias("tags"),
        F.lit(None).cast("string").alias("attribute_type"), F.lit(False).alias("refined"), F.lit(None).cast("map<string,string>").alias("attrs"), (F.lit(version) if isinstance(version, int) else version).cast("long").alias("version"),
    )


def documents(nodes: DataFrame) -> DataFrame:
    """Index documents of nodes: one current row each."""
    return nodes.select("sample_id", F.col("node_seq").alias("doc_seq"), "node_id", index_document("content", "context", "keywords", "tags").alias("text"), "version")


def vectors(docs: DataFrame) -> DataFrame:
    return docs.select("sample_id", "node_id", hash_embedding("text").cast("array<float>").alias("vec"))


def write_batch(batch: DataFrame, root: str, batch_id: int, key: str = "") -> int:
    """One batch of turns as one commit: nodes, their documents, their vectors. A batch whose key is committed is left out,
    any other that comes twice replaces its own rows. Returns how many facts were written."""
    spark = batch.sparkSession
    if key and graph_store.committed(spark, root, "facts", key):
        return 0
    nodes = facts(batch, batch_id)
    docs = documents(nodes)
    with graph_store.Commit(spark, root, "facts", key) as c:
        n = c.add(nodes, "nodes")
        c.add(docs, "docs")
        c.add(vectors(docs), "embeddings")
    return n


def rebuild_index(spark: SparkSession, root: str) -> int:
    """Documents and vectors of facts that have none (their files are lost, or the graph came without an index)."""
    nodes = graph_store.load(spark, root, "nodes").where("level = 'fact'")
    whole = graph_store.load(spark, root, "docs").join(graph_store.load(spark, root, "embeddings"), ["sample_id", "node_id"], "left_semi")
    docs = documents(nodes).join(whole.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_anti")
    if docs.isEmpty():
        return 0
    with graph_store.Commit(spark, root, "index") as c:
        n = c.add(docs, "docs")
        c.add(vectors(docs), "embeddings")
    return n


def ingest(spark: SparkSession, source: str, schema: str, root: str, max_files: int = 10) -> StreamingQuery:
    """Everything new in a folder of Parquet turns; start it again to go on where it stopped."""
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(df: DataFrame, batch_id: int) -> None:
        # the stream's own id, which its checkpoint keeps: another stream counts its batches from 0 as well
        stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(df, root, batch_id, f"{stream}:{batch_id}" if stream else "")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()


def event_counts(events: DataFrame, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts a window and type of a stream of events with a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", span).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
