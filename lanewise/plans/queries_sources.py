"""Sources that read and write real files: document files of several shapes, resumed work, stored upserts, reference folders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import cleaning
from lanewise.plans.freight_view import FreightView
from lanewise.plans.registry import op
from lanewise.plans.scratch import scratch_folder
from lanewise.sources import documents, reference, resume, variants
from lanewise.sources.commits import Commits


FILE_NUMBERS = 16_000
LINES_EACH = 1 << 18        # a packed file is read by one task


def document_files(v: FreightView, folder: str) -> None:
    """The printed invoices as files: lists, ``records`` wrappers, files keyed by document id, and JSON lines; amounts are numbers."""
    q = F.col("doc_seq")
    numbers = {f: F.col(f"gt_{f}").cast("double") for f, kind in C.CORE_FIELDS.items() if kind in ("amount", "number")}
    values = [numbers.get(f, F.col(f"gt_{f}")).alias(f) for f in C.CORE_FIELDS]
    lines = F.array(*[F.struct(F.lit(n).alias("description"), numbers[n].alias("amount")) for n in ("freight_base", "toll")]).alias("line_items")
    nested = F.to_json(F.struct("doc_id", "layout", F.struct(*values, lines).alias("fields")))
    flat = F.to_json(F.struct("doc_id", F.lit("scan").alias("source"), *values, lines))
    keyed = F.concat(F.lit('"'), "doc_id", F.lit('":'), F.to_json(F.struct("layout", F.struct(*values, lines).alias("fields"))))
    shape = q % 4
    docs = v.documents.select("doc_id", shape.alias("shape"), F.floor(q / FILE_NUMBERS).alias("part"), F.when(shape == 1, keyed).when(shape == 2, flat).otherwise(nested).alias("json"))
    # so many numbers in a row hold a quarter as many documents of each shape at most: no file grows with the table, and there are not too many
    files = docs.where("shape < 3").groupBy("shape", "part").agg(F.concat_ws(",\n", F.sort_array(F.collect_list("json"))).alias("t"))
    whole = F.when(F.col("shape") == 1, F.concat(F.lit("{"), "t", F.lit("}"))).when(F.col("shape") == 2, F.concat(F.lit('{"records": ['), "t", F.lit("]}"))).otherwise(
        F.concat(F.lit("["), "t", F.lit("]")))
    files.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{folder}/files")
    docs.where("shape = 3").select("json").write.option("maxRecordsPerFile", LINES_EACH).option("compression", "gzip").text(f"{folder}/lines")


@op("scan_document_files", """SELECT doc_id, CASE WHEN doc_seq % 4 = 2 THEN 'unknown' ELSE layout END AS layout, gt_total::DOUBLE AS total, gt_vendor_id AS vendor_id,
    gt_toll::DOUBLE AS line_toll, CASE WHEN gt_toll IS NULL THEN 12 ELSE 13 END AS n_fields FROM f_docs""")
def _(v):
    """Documents of all four shapes, with numbers and line items that are still numbers and lists."""
    folder = scratch_folder(v.spark, "documents")
    document_files(v, folder)
    d = variants.read_documents(v.spark, f"{folder}/files").unionByName(variants.read_document_lines(v.spark, f"{folder}/lines"))
    return d.select("doc_id", "layout", variants.field("total", kind="double").alias("total"), variants.field("vendor_id").alias("vendor_id"),
                    variants.field("line_items", "$[1].amount", "double").alias("line_toll"), F.size("fields").alias("n_fields"))


@op("adapt_document_files", "SELECT gt_invoice_id AS doc_id, CASE WHEN doc_seq % 4 = 2 THEN 'unknown' ELSE (doc_seq % 7)::VARCHAR END AS layout, gt_order_id AS order_id FROM f_docs")
def _(v):
    """The same files under the names of the evaluation."""
    folder = scratch_folder(v.spark, "documents")
    document_files(v, folder)
    d = variants.read_documents(v.spark, f"{folder}/files").unionByName(variants.read_document_lines(v.spark, f"{folder}/lines"))
    text = F.transform_values("fields", lambda k, x: F.try_variant_get(x, "$", "string"))
    out = documents.adapt_documents(d.select("doc_id", "layout", F.lit(None).cast("string").alias("path"), text.alias("fields")))
    return out.select("doc_id", "layout", F.try_element_at("fields", F.lit("order_id")).alias("order_id"))


@op("resume_from_log", "SELECT invoice_id, upper(vendor_id) AS vendor_id, actual_billed_amount > 0 AS valid, 1::BIGINT AS times FROM f_inv_first")
def _(v):
    """Invoices checked by a run that ended after three of eight chunks, and by the one that went on."""
    log, schema = scratch_folder(v.spark, "done"), "invoice_id string, vendor_id string, valid boolean"

    def work(part: DataFrame) -> DataFrame:
        return part.select("invoice_id", F.upper("vendor_id").alias("vendor_id"), (F.col("actual_billed_amount") > 0).alias("valid"))
    resume.process(v.invoices_first, work, log, "invoice_id", schema, stop=lambda k: k == 3)
    done = resume.process(v.invoices_first, work, log, "invoice_id", schema)
    return done.groupBy("invoice_id").agg(F.first("vendor_id").alias("vendor_id"), F.first("valid").alias("valid"), F.count("*").alias("times"))


@op("merge_reference", """SELECT o.order_id, CASE WHEN r.order_seq % 3 = 0 THEN baseline_cost + 1 ELSE baseline_cost END AS cost, CASE WHEN r.order_seq % 6 = 0 THEN NULL ELSE 1.0::DOUBLE END AS rating,
    CASE WHEN r.order_seq % 3 = 0 THEN 2 ELSE 1 END AS version FROM f_ord o JOIN f_ord_raw r ON o.order_id = r.order_id""", r="cost:3")
def _(v):
    """Stored order costs after an update that is merged twice, the second time into a table that has it already."""
    commits = Commits(v.spark, scratch_folder(v.spark, "reference"))
    old = v.orders.select("order_id", "order_seq", F.col("baseline_cost").alias("cost"), F.lit(1.0).alias("rating"), F.lit(1).alias("version"))
    news = old.where("order_seq % 3 = 0").select("order_id", "order_seq", (F.col("cost") + 1).alias("cost"),
                                                  F.when(F.col("order_seq") % 6 == 0, float("nan")).otherwise(1.0).alias("rating"), F.lit(2).alias("version"))
    for rows in (old, news, news):
        reference.merge_reference(commits, rows, ["order_id"], "version")
    return reference.merged_reference(commits, news.schema).drop("order_seq")


@op("scan_reference_folders", "SELECT vendor_id, vendor_name, home_state, fleet_size, h.state FROM f_vendors JOIN f_hubs h ON printf('HUB%02d', (substr(vendor_id, 4)::BIGINT % 25)::INTEGER) = h.hub_id")
def _(v):
    """Reference tables as CSV in two folders: the first that has a table wins."""
    one, two = (scratch_folder(v.spark, f"folder-{k}") for k in (1, 2))
    v.hubs.write.option("header", True).csv(f"{one}/hubs.csv")
    v.hubs.limit(0).write.option("header", True).csv(f"{two}/hubs.csv")
    v.vendors.withColumn("onboarding_date", F.lit(None).cast("date")).write.option("header", True).csv(f"{two}/vendors.csv")
    hubs, vendors = (reference.read_reference(v.spark, n, [one, two]) for n in ("hubs", "vendors"))
    place = F.concat(F.lit("HUB"), F.lpad((F.substring("vendor_id", 4, 20).cast("long") % 25).cast("string"), 2, "0"))
    return vendors.withColumn("hub_id", place).join(hubs.select("hub_id", "state"), "hub_id").select("vendor_id", "vendor_name", "home_state", "fleet_size", "state")


@op("month_median_impute", """WITH w AS (SELECT hub_id, day, CASE WHEN month(day) <> 2 THEN precip END AS v FROM f_weather), m AS (SELECT month(day) AS mo, median(v) AS med FROM w GROUP BY 1)
    SELECT hub_id, day, coalesce(v, med, (SELECT median(v) FROM w)) AS precip FROM w LEFT JOIN m ON month(day) = mo""")
def _(v):
    """Rain with its missing readings, and with a month that has none, filled by medians."""
    rain = v.weather.select("hub_id", F.col("day").alias("order_date"), F.when(F.month("day") != 2, F.col("precip")).alias("precip"))
    return cleaning.month_median_impute(rain, "precip").withColumnRenamed("order_date", "day")
