"""Documents read from files of several JSON shapes, with values that keep their JSON types (VARIANT).

A file holds a list of documents, an object with a ``records`` list, an object keyed by document id, or one document a line. A document
has a ``fields`` object, or every key that does not describe the document is a field.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import constants as C

FIELDS = "map<string,variant>"


def _object(v: Column) -> Column:
    """The members of an object; null for every other value. Told by a cast: the schema of a value is as long as the value, and a file holds many."""
    return F.try_variant_get(v, "$", FIELDS)


def exploded(files: DataFrame, value: str = "value") -> DataFrame:
    """One row (key, doc) for each document of a column of whole JSON texts; texts that are no JSON give none.

    The key is the one in a keyed file, else null. The files are read as they are; only their members are spread.
    """
    spark = files.sparkSession
    first = F.regexp_extract(value, r"^[ \t\r\n]*([\[{])", 1)      # of valid JSON it tells objects and lists
    whole = files.select(F.try_parse_json(value).alias("v"), first.alias("kind")).where("v IS NOT NULL AND kind IN ('{', '[')")
    records = F.try_variant_get("v", "$.records", "variant")
    listed = F.try_variant_get(records, "$[0]", "variant").isNotNull() | F.to_json(records).startswith("[")      # the text only of what has no first member
    top = whole.select(F.when(F.col("kind") == "{", F.when(listed, records)).alias("r"), "v").select(F.coalesce("r", "v").alias("top"))
    return top.lateralJoin(spark.tvf.variant_explode(F.col("top").outer())).select("key", F.col("value").alias("doc"))


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, layout, fields) of rows (key, doc). A document's own id goes before the key of its file; a keyed value that is no
    object is taken as the fields themselves, which then are none."""
    parts = rows.select("key", _object(F.col("doc")).alias("doc")).withColumn("given", F.try_element_at("doc", F.lit("fields")))
    parts = parts.withColumn("fields", _object(F.col("given")))
    own = F.map_filter("doc", lambda k, v: ~k.isin(C.DOCUMENT_META_KEYS))
    empty = F.create_map().cast(FIELDS)
    return parts.select(F.coalesce(F.try_variant_get(F.try_element_at("doc", F.lit("doc_id")), "$", "string"), F.col("key")).alias("doc_id"),
                        F.coalesce(F.try_variant_get(F.try_element_at("doc", F.lit("layout")), "$", "string"), F.lit("unknown")).alias("layout"),
                        F.coalesce("fields", F.when(F.col("given").isNull(), own), empty).alias("fields"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of the first three shapes; a file cannot be split, one task reads each."""
    return documents(exploded(spark.read.text(path, wholetext=True)))


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: splittable, the form to use at scale. Lines that are no JSON object are left out."""
    lines = spark.read.text(path).select(F.lit(None).cast("string").alias("key"), F.try_parse_json("value").alias("doc"))
    return documents(lines.where(_object(F.col("doc")).isNotNull()))


def field(name: str, path: str = "$", kind: str = "string") -> Column:
    """A value inside a field; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_element_at("fields", F.lit(name)), path, kind)
