"""One-permutation MinHash fingerprints of whole texts, in DataFrame functions only.

Every five-word shingle is hashed once. The high bits of a hash choose one of BINS bins, each bin keeps its least hash.
Empty bins are filled by optimal densification: bin j looks at the bins of a fixed pseudo-random order of its own and takes
the value of the first one that is filled. Only the low BITS bits of each bin are stored, as hex digits; a likeness
corrects for chance agreement of that many bits.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import input_splits, query, seeds, table

BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
WORDS = 5
SHIFT = 63 - BIN_BITS
NOTHING = (1 << SHIFT) - 1      # the last value of a bin marks it as empty
STARTS = [int(x) % BINS for x in seeds(BINS, 1)]
STEPS = [int(x) % BINS | 1 for x in seeds(BINS, 2)]     # odd: the order visits every bin
FIRST_TRIES = 16
HALF = 1 << (BITS - 1)          # stored values are shifted into a signed byte


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _is_empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(NOTHING)) == F.lit(NOTHING)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<tinyint> of BINS values, empty for a null text or one without words.

    Words are what lies between white space (space and bytes 9 to 13), lower-cased; a text of fewer than five words has its
    whole sequence as one shingle. Equal texts have equal fingerprints.
    """
    w, s, b = f"_{out}_words", f"_{out}_shingles", f"_{out}_bins"
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    n = F.size(w)

    def shingle(x, i):
        return F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, WORDS)]).bitwiseAND(F.lit((1 << 63) - 1))

    hashed = (F.when(n >= WORDS, F.transform(F.slice(F.col(w), F.lit(1), n - (WORDS - 1)), shingle))
              .otherwise(F.array(F.xxhash64(F.col(w)).bitwiseAND(F.lit((1 << 63) - 1)))))
    ends = _longs([(j << SHIFT) + NOTHING for j in range(BINS)])
    df = df.withColumn(s, F.sort_array(F.concat(hashed, ends)))

    def bin_of(x):
        return F.shiftright(x, SHIFT)

    df = df.withColumn(b, F.filter(F.col(s), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))

    def borrowed(j: Column, tries: int) -> Column:
        at = lambda t: F.get(F.col(b), F.pmod(F.get(_longs(STARTS), j) + t * F.get(_longs(STEPS), j), F.lit(BINS)).cast("int"))
        hit = F.filter(_longs(range(tries)), lambda t: ~_is_empty(at(t)))
        return at(F.get(hit, F.lit(0)))

    filled = F.transform(F.col(b), lambda x, j: F.when(~_is_empty(x), x).otherwise(F.coalesce(borrowed(j, FIRST_TRIES), borrowed(j, BINS))))
    packed = F.transform(filled, lambda x: (x.bitwiseAND(F.lit((1 << BITS) - 1)) - HALF).cast("tinyint"))
    return df.withColumn(out, F.when(n > 0, packed).otherwise(F.array().cast("array<tinyint>"))).drop(w, s, b)


def as_text(fingerprint: str) -> Column:
    """Two hex digits for each bin."""
    return F.array_join(F.transform(F.col(fingerprint), lambda x: F.substring(F.hex(x.cast("int") + HALF + (1 << BITS)), 2, 2)), "")


def likeness(a: str, b: str) -> Column:
    """Bias-corrected share of equal bins, 0 to 1; two texts without words are alike, one without words is like no other."""
    same = F.size(F.filter(F.col(a), lambda x, i: x == F.get(F.col(b), i))) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(F.size(a) == 0, F.lit(1.0)).otherwise(corrected)


def id_ranges(df: DataFrame, ranges: int) -> DataFrame:
    """``df`` (id) with ``bucket``: 0 to ranges-1 in ascending id, of about equal rows. The cut points are one array of
    ``ranges`` numbers; a row looks them up in two steps of about the square root of that."""
    step = max(1, int(ranges ** 0.5))
    cuts = df.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges)).alias("c"))
    heads = F.filter("_cuts", lambda c, i: (i % step == 0) & (c < F.col("id")))
    block = F.greatest(F.size(heads) - 1, F.lit(0)) * step
    inside = F.filter(F.slice("_cuts", F.col("_block") + 1, F.lit(step)), lambda c: c < F.col("id"))
    return (df.withColumn("_cuts", F.coalesce(cuts.scalar(), F.array().cast("array<long>"))).withColumn("_block", block)
            .withColumn("bucket", F.col("_block") + F.size(inside)).drop("_cuts", "_block"))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (id, text) with fp, next_text and next_fp of the following row in descending id; the first row follows the last.

    Rows are dealt to ranges of ids; a window runs within each range, and the first row of the next lower range is looked up
    for its last row. Ties go by text.
    """
    placed = with_fingerprint(id_ranges(docs, ranges), "text", "fp")
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("text"))
    tops = id_ranges(docs.select("id"), ranges).groupBy("bucket").agg(F.max("id").alias("id"))
    # one row for each range, so the single-partition windows and the broadcast are bounded by the number of ranges
    down = Window.orderBy(F.desc("bucket"))
    after = tops.select("bucket", F.lead("id").over(down).alias("next"), F.max("id").over(Window.partitionBy()).alias("top"))
    after = after.select("bucket", F.coalesce("next", "top").alias("id"))
    rows = docs.join(F.broadcast(tops.select("id")), "id", "left_semi")
    first = Window.partitionBy("id").orderBy(F.desc("text"))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = with_fingerprint(rows, "text", "fp").select("id", F.col("text").alias("top_text"), F.col("fp").alias("top_fp"))
    joint = after.join(rows, "id").select("bucket", "top_text", "top_fp")
    inner = placed.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order),
                                "_last": F.lead(F.lit(1)).over(order).isNull()})
    last = F.col("_last")
    return inner.join(joint, "bucket").select("id", "text", "fp", F.when(last, F.col("top_text")).otherwise(F.col("next_text")).alias("next_text"),
                                              F.when(last, F.col("top_fp")).otherwise(F.col("next_fp")).alias("next_fp"))


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses. Null texts count as empty; a null doc_id sorts last."""
    lowest = F.lit(-(1 << 63)).cast("long")
    docs = table(spark, sf_dir, "documents")
    ranges = 4 * input_splits(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ranges)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    out = with_fingerprint(out, "edited", "edited_fp")
    return out.select(F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
                      likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
