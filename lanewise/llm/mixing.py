"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of BLOCK rows. With integer weights w and period D (the sum of the weights), block j
of a source is released at slot floor(j*D/w) and due before slot ceil((j+1)*D/w). Serving the released block with the earliest
deadline keeps every source within less than one block of its share w/D at every slot. Releases and deadlines repeat with
the period, so one period is scheduled on the driver (D slots, a parameter) and every block finds its slot by arithmetic.
When a source has too few blocks left for a whole period, one period runs with what it has, and the others go on with their
own weights: all rows are kept.
"""

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import input_splits, query, table

BLOCK = 32
PARTS = 1000          # the weights of all sources add up to this
TEMPERATURE = 0.5     # without given weights, a source weighs as its rows to this power
SEED = 77


def integer_weights(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole parts by largest remainder, at least one each; ``parts`` grows to four for each source if need be."""
    if not weights:
        return {}
    parts, total = max(parts, 4 * len(weights)), sum(weights.values())
    exact = {s: w / total * parts for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: max(0, parts - sum(out.values()))]:
        out[s] += 1
    return out


def release(j: int, w: int, period: int) -> int:
    return j * period // w


def deadline(j: int, w: int, period: int) -> int:
    return -(-(j + 1) * period // w)


def schedule_period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slot of each block of one period by earliest deadline first among released blocks; ties by the name of the source."""
    period = sum(weights.values())
    waiting = [(0, deadline(0, w, period), s, 0) for s, w in sorted(weights.items())]
    heapq.heapify(waiting)
    ready, slots = [], {s: [] for s in weights}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, (release(j + 1, weights[s], period), deadline(j + 1, weights[s], period), s, j + 1))
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple]:
    """(source, phase, first block, blocks, weight, period, first slot, slots of a period) until every block has a slot."""
    left, done, start, out, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, [], 0
    while left := {s: n for s, n in left.items() if n > 0}:
        whole = min(n // weights[s] for s, n in left.items())
        w = {s: weights[s] if whole else min(weights[s], n) for s, n in left.items()}
        rounds, period, slots = max(1, whole), sum(w.values()), schedule_period(w)
        for s in w:
            out.append((s, phase, done[s], rounds * w[s], w[s], period, start, slots[s]))
            done[s] += rounds * w[s]
            left[s] -= rounds * w[s]
        start, phase = start + rounds * period, phase + 1
    return out


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` as struct ``record`` with source, block, turn (slot of its block), position (gapless from 0),
    release and deadline (slots).

    ``weights``: share by source; a source without one weighs as the least of those given. None: rows to the power
    TEMPERATURE. A null source is a source of its own, named by the empty string. The order within a source is a seeded hash
    of the row. Rows of a source are numbered in chunks, so a hot source never meets in one task. The driver holds one row
    for each source. Ties between equal rows go by place of input. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(record.alias("record"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"))
    rows = rows.withColumn("lot", F.xxhash64(F.lit(SEED), "record", F.monotonically_increasing_id()))
    rows = rows.withColumn("chunk", F.pmod("lot", F.lit(4 * input_splits(docs))))
    key = rows.select("source", "chunk", "lot")
    counts = key.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r["source"]: r["n"] for r in key.groupBy("source").agg(F.count("*").alias("n")).collect()}   # one row for each source
    if weights is None:
        shares = {s: n ** TEMPERATURE for s, n in totals.items()}
    else:
        least = min([w for w in weights.values() if w > 0], default=1.0)
        shares = {s: weights.get(s) or least for s in totals}
    plan = phases({s: -(-n // block) for s, n in totals.items()}, integer_weights(shares))
    short, slot_of = [], {}
    for s, _, first, n, w, period, start, slots in plan:
        last = -(-totals[s] // block) - 1
        if totals[s] % block and first <= last < first + n:
            at = last - first
            slot_of[s] = start + at // w * period + slots[at % w]
            short.append((slot_of[s], block - totals[s] % block))
    numbered = rows.join(counts.select("source", "chunk", "before"), ["source", "chunk"])
    within = Window.partitionBy("source", "chunk").orderBy("lot")
    numbered = numbered.withColumn("index", F.col("before") + F.row_number().over(within) - 1)
    numbered = numbered.withColumns({"block": F.floor(F.col("index") / block).cast("long"), "place": F.pmod("index", F.lit(block))})
    ddl = "source string, phase int, first long, n long, w long, period long, start long, slots array<int>"
    table_ = spark.createDataFrame(plan, ddl)      # at most two phases for each source that runs out, PARTS slots in each
    at = F.col("block") - F.col("first")
    turn = F.col("start") + F.floor(at / F.col("w")) * F.col("period") + F.get("slots", F.pmod(at, F.col("w")).cast("int"))
    found = numbered.join(F.broadcast(table_.withColumnRenamed("source", "of")),
                          (F.col("source") == F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("n")))
    missing = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(k).cast("long").alias("k")) for t, k in sorted(short)]) if short else None
    gap = F.aggregate(F.filter(missing, lambda x: x["t"] < F.col("turn")), F.lit(0).cast("long"), lambda a, x: a + x["k"]) if short else F.lit(0)
    out = found.withColumn("turn", turn.cast("long"))
    return out.select("record", "source", "block", "turn", (F.col("turn") * block + F.col("place") - gap).cast("long").alias("position"),
                      (F.col("start") + F.floor(at * F.col("period") / F.col("w"))).cast("long").alias("release"),
                      (F.col("start") + F.ceil((at + 1) * F.col("period") / F.col("w"))).cast("long").alias("deadline"))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The rows and columns of ``docs``, stored in the order of the mixture when written: ranges of positions, sorted within."""
    out = mixed(docs, weights)
    out = out.select("record", "position").repartitionByRange(input_splits(docs), "position").sortWithinPartitions("position")
    return out.select(*[F.col(f"record.`{c}`").alias(c) for c in docs.columns])


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of sources weighted by the square root of their rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("record.doc_id", F.col("record.source").alias("source"), "block", "turn", "position", "release", "deadline")
