"""The queries opN_<name> over the whole tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytebpe, htmltext, idfile, langid, lines, media, neardup, packing, phrases, pieces, runs, suffix
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401  (what SQL can't express is tested in tests/llm)


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op6_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read_ids(idfile.write_ids(table(spark, sf_dir, "documents"), tokenizer(), end_id=2))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), seed=1, dropout=0.1)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_digest(table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=0)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"))


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_htmltext": op2_htmltext,
    "op3_langid": op3_langid,
    "op4_neardup": op4_neardup,
    "op5_media": op5_media,
    "op6_idfile": op6_idfile,
    "op7_pieces": op7_pieces,
    "op8_lines": op8_lines,
    "op9_suffix": op9_suffix,
    "op10_packing": op10_packing,
    "op11_runs": op11_runs,
    "op12_bytebpe": op12_bytebpe,
    "op13_phrases": op13_phrases,
}
