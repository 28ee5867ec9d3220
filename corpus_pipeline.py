"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a data frame; all but the last return the
columns of documents, in their order. Between stages the rows are written and read again.

Rows, not doc_ids, are what the stages decide on: a row is named by a key made of two hashes of all its columns, and travels as one
value, so that a doc_id may be null or stand for several texts, rows may be repeated, and columns beside those
of documents may have any names; these are handed on as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common as c
from quadrille.llm import op03_decontaminate, op04_tokens, op05_language, op07_jaccard, op10_mixing


def _hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns, nulls included."""
    own = [docs[f"`{x}`"] for x in docs.columns]
    empty = [x.isNull() for x in own]
    return F.xxhash64(*own, *empty), F.xxhash64(F.lit("second"), *empty, *own)


def _key(docs: DataFrame) -> Column:
    """A key of 64 bits for a row: the first hash, or, where rows with different second hashes share it, a hash of both. Rows with
    one key have equal hashes of 128 bits: they are the same row, repeated. Of 10^10 rows about three share a first hash, and these are
    all that the driver gets."""
    first, second = _hashes(docs)
    both = docs.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    shared = [r["a"] for r in both.where("low <> high").select("a").collect()]
    return F.when(first.isin(shared), F.xxhash64(first, second)).otherwise(first) if shared else first


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """row_key, row."""
    return docs.select(key.alias("row_key"), F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row"))


def _as_ids(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows for an operator, with their keys as doc_id."""
    return docs.select((_key(docs) if key is None else key).alias("doc_id"), "text", "lang", "source")


def _left_out(docs: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """The rows that are not marked (by doc_id, the row's key)."""
    return _keyed(docs, key).join(marks.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select("row.*")


def _once(docs: DataFrame, key: Column) -> DataFrame:
    """row_key, row: repeated rows once. They are combined in their tasks before rows move."""
    return _keyed(docs, key).groupBy("row_key").agg(F.first("row").alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose language stays undetermined. The model learns from the input's own labels.

    Texts without words are judged by their source alone; if nothing is labelled, nothing is left out."""
    key = _key(docs)
    langs, logp = op05_language.train(_as_ids(docs, key))
    if not langs:
        return docs
    found = op05_language.identify(op05_language.from_documents(_as_ids(docs, key)), langs, logp)
    return _left_out(docs, key, found.where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that with the smallest doc_id, nulls last; one of a row that is repeated.

    Texts without words are no copies of each other."""
    key = _key(docs)
    rows, _ = op07_jaccard.jaccard_join(_as_ids(docs, key))
    ids = docs.select(key.alias("row_key"), F.col("doc_id").alias("id")).distinct()
    nodes = rows.select(F.col("doc_id").alias("row_key"), "component_id").distinct().join(ids, "row_key")
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_key"))
    kept = c.cut(nodes.groupBy("component_id").agg(best.alias("best")).select("best.row_key"), "near_kept")
    return _once(docs, key).join(kept, "row_key", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the rows that hold a benchmark item. Null and empty texts stay."""
    key = _key(docs)
    found = op03_decontaminate.find_overlaps(_as_ids(docs, key).select("doc_id", "text"), c.table(spark, sf_dir, "benchmark"))
    return _left_out(docs, key, found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it, or, of a row that is repeated, all its rows together; what the
    mix does not take goes, texts without words among it."""
    key = _key(docs)
    mixed = op10_mixing.mix_by_source(_as_ids(docs, key)).where("taken > 0")
    times = mixed.groupBy(F.col("doc_id").alias("row_key")).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    rows = _once(docs, key).join(times, "row_key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids and returns what the files hold: doc_id, start, n_tokens, ids_crc32; a row for each row."""
    return op04_tokens.token_digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: SQL can express neither the trained model, nor the seeded flow, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
