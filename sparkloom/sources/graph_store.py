"""The graph and its index on disk: Parquet tables that grow by commits.

A commit may span several tables. Its rows go to folders of their own, `<table>/commit=<id>`, and its manifest, a small file
in `_commits`, is written last by one rename; readers see the folders of manifests alone. So a run that is cut off anywhere
leaves nothing half done: what has no manifest isn't there, and is found missing and done again. Nothing is rewritten; the
latest version of a row wins. A table that isn't there has no row."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom import schemas
from sparkloom.operators.graph import latest

TABLES = {"nodes": schemas.NODES, "edges": schemas.EDGES, "docs": schemas.DOCS, "embeddings": schemas.EMBEDDINGS, "evolved": schemas.EVOLVED}
KEYS = {"nodes": ["sample_id", "node_id"], "edges": ["sample_id", "src", "dst"], "docs": ["sample_id", "node_id"], "embeddings": ["sample_id", "node_id"], "evolved": ["sample_id", "node_id"]}
MANIFEST = "id string, phase string, key string, tables map<string,long>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _fields(name: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(TABLES[name]).fields]


class Commit:
    """Rows for several tables that become visible together, by finish(). As a context manager: unless the body raises."""

    def __init__(self, spark: SparkSession, root: str, phase: str, key: str = ""):
        self.spark, self.root, self.phase, self.key = spark, root, phase, key
        self.id, self.tables = f"{phase}-{uuid.uuid4().hex}", {}

    def add(self, df: DataFrame, name: str) -> int:
        """New versions of rows, written but not visible yet; how many there are."""
        path = f"{self.root}/{name}/commit={self.id}"
        df.select(*_fields(name)).write.mode("append").parquet(path)
        self.tables[name] = self.spark.read.schema(TABLES[name]).parquet(path).count()
        return self.tables[name]

    def finish(self) -> None:
        """The manifest, whole or not at all."""
        fs, to = _fs(self.spark, f"{self.root}/_commits/{self.id}.json")
        _, draft = _fs(self.spark, f"{self.root}/_commits/.{self.id}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"id": self.id, "phase": self.phase, "key": self.key, "tables": self.tables}).encode()))
        out.close()
        if not fs.rename(draft, to):
            raise OSError(f"could not commit {self.id} in {self.root}")

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finish()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """id, phase, key and row counts by table of every commit."""
    fs, path = _fs(spark, f"{root}/_commits")
    return spark.read.schema(MANIFEST).json(f"{root}/_commits") if fs.exists(path) else spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, root: str, phase: str, key: str) -> bool:
    """Whether this piece of work is done."""
    return not manifest(spark, root).where((F.col("phase") == phase) & (F.col("key") == key)).isEmpty()


def append(df: DataFrame, root: str, name: str) -> None:
    """A commit to one table."""
    with Commit(df.sparkSession, root, name) as c:
        c.add(df, name)


def _rows(spark: SparkSession, root: str, name: str, **options: str) -> DataFrame:
    """All versions, with the commit each is from. The list of folders is as long as there are commits; compact() ends that."""
    made = manifest(spark, root).where(F.map_contains_key("tables", F.lit(name)))
    paths = [f"{root}/{name}/commit={r['id']}" for r in made.select("id").orderBy("id").toLocalIterator()]
    fs, _ = _fs(spark, root)
    paths = [p for p in paths if fs.exists(_fs(spark, p)[1])]
    if not paths:
        return spark.createDataFrame([], f"{TABLES[name]}, commit string")
    return spark.read.options(basePath=f"{root}/{name}", **options).schema(f"{TABLES[name]}, commit string").parquet(*paths)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest version of every row. Readers fill missing values; stored nulls stay."""
    rows = _rows(spark, root, name).drop("commit")
    return latest(rows, KEYS[name]) if "version" in rows.columns else rows.dropDuplicates(KEYS[name])


def compact(spark: SparkSession, root: str, name: str, to: str) -> None:
    """The latest versions alone, as one commit of another root."""
    append(load(spark, root, name), to, name)


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """Commits that lack rows they had: id, table, rows written, rows that can still be read."""
    told = manifest(spark, root).select("id", F.explode("tables").alias("table", "written"))
    held = None
    for name in TABLES:
        some = _rows(spark, root, name, ignoreCorruptFiles="true", ignoreMissingFiles="true").groupBy(F.col("commit").alias("id")).agg(F.count("*").alias("found")).withColumn("table", F.lit(name))
        held = some if held is None else held.unionByName(some)
    return told.join(held, ["id", "table"], "left").select("id", "table", "written", F.coalesce("found", F.lit(0)).alias("found")).where("found < written")


def repair(spark: SparkSession, root: str) -> list[str]:
    """Take back commits that are damaged, so that their work is missing and is done again; returns their ids. A damaged
    index alone (docs, embeddings) can be made from the nodes, so its commit stays: see streaming.ingest.rebuild_index()."""
    gone = [r["id"] for r in damaged(spark, root).where(F.col("table").isin("nodes", "edges", "evolved")).select("id").distinct().orderBy("id").collect()]  # ids of broken commits
    for i in gone:
        fs, path = _fs(spark, f"{root}/_commits/{i}.json")
        if not fs.rename(path, _fs(spark, f"{root}/_commits/.{i}.damaged")[1]):
            raise OSError(f"could not take back {i} in {root}")
    return gone
