"""Tables and the items that the queries are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinals import dense_order

ROW_SCHEMA = {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"], "additionalProperties": False}
LABEL_SCHEMA = {
    "type": "object", "properties": {"label": {"type": "string"}, "score": {"type": "number"}}, "required": ["label", "score"],
    "additionalProperties": False,
}
DOCS = "(SELECT doc_id, doc_id::VARCHAR AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS item_index, text, lang, source FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as item rows: ``item_id``, ``item_index`` and the columns asked for."""
    d = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id").cast("string"))
    d = d.select("doc_id", "item_id", *(columns or ("text", "lang", "source")))
    return dense_order(d, "doc_id", name="item_index")
