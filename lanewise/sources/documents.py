"""Extracted invoice documents as text maps; ``variants`` reads them from files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C

FLAT = "map<string,string>"


def parse_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, layout, fields): without a ``fields`` object every key that is not
    descriptive is a field."""
    flat = F.from_json("json", FLAT)
    nested = F.from_json(F.try_element_at("m", F.lit("fields")), FLAT)
    own = F.map_filter("m", lambda k, v: ~k.isin(C.DOCUMENT_META_KEYS))
    return (lines.withColumn("m", flat)
            .select(F.try_element_at("m", F.lit("doc_id")).alias("doc_id"),
                    F.coalesce(F.try_element_at("m", F.lit("layout")), F.lit("unknown")).alias("layout"),
                    F.coalesce(nested, own).alias("fields")))


def adapt_documents(docs: DataFrame) -> DataFrame:
    """Unify names of foreign exports: gstin is the vendor's, layouts lose their prefix, the id is
    the invoice number, else the doc id, else the file stem."""
    names = F.transform_keys("fields", lambda k, v: F.when(k == "gstin", "vendor_gstin").otherwise(k))
    stem = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]+?)(\.[^./]*)?$", 1)
    doc_id = F.coalesce(F.try_element_at("fields", F.lit("invoice_id")), F.col("doc_id"), F.nullif(stem, F.lit("")))
    return docs.select(doc_id.alias("doc_id"), F.regexp_replace("layout", "^layout_", "").alias("layout"), names.alias("fields"))
