"""Train/test splits and samples from an arithmetic hash of a numeric key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.scale import running_total

BUCKETS = 1_000_003        # prime; also the number of distinct hash values


def hash_bucket(seq: Column, seed: int = 42) -> Column:
    """Evenly spread bucket 0..BUCKETS-1, the same in every engine."""
    return F.pmod(F.pmod(seq, F.lit(BUCKETS)) * 7919 + F.lit(seed * 104_729 % BUCKETS), F.lit(BUCKETS))


def random_split(df: DataFrame, seq: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", hash_bucket(F.col(seq), seed) < int(test_share * BUCKETS))


def share_cutoffs(df: DataFrame, by: list[str], share: float | dict[str, float], seq: str, seed: int) -> DataFrame:
    """Per group the largest hash bucket with which the share is not yet exceeded; of several shares, each under its name.

    Rows are counted per (group, bucket) with map-side combine; the window sees at
    most BUCKETS rows per group, however many rows the group has.
    """
    shares = share if isinstance(share, dict) else {"cutoff": share}
    counts = (df.withColumn("_h", hash_bucket(F.col(seq), seed)).groupBy(*by, "_h").agg(F.count("*").alias("_n")))
    upto = Window.partitionBy(*by).orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    cum = counts.select(*by, "_h", F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(whole).alias("_all"))
    return cum.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("_cum") <= F.round(F.col("_all") * x), F.col("_h"))), F.lit(-1)).alias(n)
                                  for n, x in shares.items()])


def stratified_split(df: DataFrame, label: str, seq: str, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """The same share of every label goes to the test side."""
    cut = F.broadcast(share_cutoffs(df, [label], test_share, seq, seed))       # one row per label
    return (df.join(cut, label)
            .withColumn("is_test", hash_bucket(F.col(seq), seed) <= F.col("cutoff")).drop("cutoff"))


def layout_holdout_split(docs: DataFrame, seq: str, real_layouts: list[str] = (), held_share: float = 0.25,
                         val_share: float = 0.1, seen_share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole layouts held out, real layouts test only, the rest train/val/seen test.

    Fewer than two layouts that are not real raise an error when the rows are read."""
    real = F.col("layout").isin(list(real_layouts)) if real_layouts else F.lit(False)
    # layouts are ranked by a hash of their name, over ranges of hashes
    names = docs.select("layout").where(~real).distinct()
    ranked = running_total(names.select("layout", F.md5(F.concat(F.lit(f"{seed}:"), "layout").cast("binary")).alias("_md5"), F.lit(1).alias("_one")), "_md5", ["_one"], descending=False)
    total = ranked.agg(F.max("cum__one")).scalar()
    total = F.when(total >= 2, total).otherwise(F.raise_error(F.lit("a layout hold-out needs two layouts or more")).cast("long"))
    held = F.least(F.greatest(F.lit(1), F.ceil(total * held_share)), total - 1)
    unseen = ranked.where(F.col("cum__one") <= held).select("layout", F.lit(True).alias("_unseen"))
    tagged = docs.join(unseen, "layout", "left").withColumn("_unseen", F.coalesce("_unseen", F.lit(False)))
    pool = tagged.where(~F.col("_unseen") & ~real)
    cuts = share_cutoffs(pool, [], {"seen": seen_share, "val": seen_share + val_share}, seq, seed).select(F.struct("seen", "val").alias("c")).scalar()
    seen_cut, val_cut = cuts["seen"], cuts["val"]
    h = hash_bucket(F.col(seq), seed)
    return tagged.withColumn("split", F.when(real, "test_real").when(F.col("_unseen"), "test_unseen_layouts")
                             .when(h <= seen_cut, "test_seen_layouts").when(h <= val_cut, "val")
                             .otherwise("train")).drop("_unseen")


def split_violations(split: DataFrame) -> DataFrame:
    """Documents in two splits and held-out layouts that also occur in training; empty when sound."""
    twice = (split.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
             .select(F.lit("document_in_two_splits").alias("problem"), F.col("doc_id").cast("string").alias("item")))
    held = split.where(F.col("split").isin("test_unseen_layouts", "test_real")).select("layout")
    leak = held.intersect(split.where(F.col("split").isin("train", "val", "test_seen_layouts")).select("layout"))
    return twice.unionByName(leak.select(F.lit("layout_leak").alias("problem"), F.col("layout").alias("item")))


def sample_rows(df: DataFrame, seq: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows: the n smallest hashes, the key breaking ties."""
    return df.orderBy(hash_bucket(F.col(seq), seed), F.col(seq)).limit(n)
