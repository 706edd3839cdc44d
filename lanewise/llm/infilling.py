"""Fill-in-the-middle transformation: texts are cut at unit ends and their parts reordered around sentinels.

A unit is a run of white space followed by a run of other characters, or a run of white space that ends the text. Only ASCII
white space separates, so a unit ends at a byte that is no white space and stands before one, and at the last byte of a text.

The bytes of a batch of texts are viewed as 64-bit words. Unit ends, and bytes that begin a code point, are marked in the high
bit of their byte by arithmetic on whole words, without a look at single bytes. ``bitwise_count`` gives the marks of a word, their
running total the rank of any byte. The k-th unit of a text is found by a binary search of the running total for its word, and
within the word by clearing k-1 low marks. The texts themselves stay in the JVM, which only receives where to cut.

A null text counts as an empty one; an empty text has no units and stays plain. Rows are independent: repeated rows, null ids
(hashed as an empty string) and extra columns of any name pass through, and an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lanewise.llm.common import binary_buffers, pieces, query, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50           # percent of the texts that are transformed
SPM = 80            # percent of those with the suffix first
CUT = ["n", "prefix_chars", "middle_chars"]

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, SEVEN, EIGHT, TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


def words_of(raw: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, the last one filled up with zeros, and one word of zeros behind."""
    room = np.zeros((len(raw) // 8 + 2) * 8, np.uint8)
    room[: len(raw)] = raw
    return room.view("<u8")


def _at_least(low: np.ndarray, least: int) -> np.ndarray:
    """High bit of each byte whose lower seven bits are ``least`` or more."""
    return (low + ONES * np.uint64(0x80 - least)) & HIGH


def unit_ends(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is no white space (20, 09 to 0D) and stands before a byte that is."""
    low = words & LOW7
    control = _at_least(low, 0x09) & ~_at_least(low, 0x0E)
    blank = ~_at_least(low ^ (ONES * np.uint64(0x20)), 1)
    space = (control | blank) & ~words & HIGH
    following = space >> EIGHT
    following[:-1] |= space[1:] << TOP
    return following & ~space


def point_starts(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that begins a code point: any but 10xxxxxx."""
    return HIGH & ~(words & ~(words << ONE))


class Marks:
    """Rank and select over marked high bits."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, byte: np.ndarray) -> np.ndarray:
        """Marks before the byte."""
        word = byte >> 3
        below = (ONE << ((byte & 7).astype(np.uint64) << np.uint64(3))) - ONE
        here = np.bitwise_count(self.marks[word] & below).astype(np.int64)
        return np.where(word > 0, self.upto[word - 1], 0) + here

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the mark number k, from 1."""
        word = np.searchsorted(self.upto, k, "left")
        left = k - np.where(word > 0, self.upto[word - 1], 0)
        mark = self.marks[word]
        for step in range(1, 8):
            mark = np.where(left > step, mark & (mark - ONE), mark)
        below = np.bitwise_count((mark & (~mark + ONE)) - ONE).astype(np.int64)       # the mark is bit 7 of its byte
        return word * 8 + below // 8


def cuts(column: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: units n, and the code points before and inside the middle. The prefix ends after the smaller of
    first % (n + 1) and second % (n + 1) units, the middle after the larger."""
    raw, offs = binary_buffers(column)
    units, before, inside = (np.zeros(len(offs) - 1, np.int64) for _ in range(3))
    for i, j, part, o in pieces(raw, offs):
        if not len(part):
            continue
        words = words_of(part)
        ends = unit_ends(words)
        full = np.flatnonzero(np.diff(o))
        last = o[full + 1] - 1
        np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
        ends[-1] = 0
        ends, points = Marks(ends), Marks(point_starts(words))
        base, start = ends.rank(o[:-1]), points.rank(o[:-1])
        n = ends.rank(o[1:]) - base
        a, b = first[i:j] % (n + 1), second[i:j] % (n + 1)
        at = []
        for k in (np.minimum(a, b), np.maximum(a, b)):
            byte = o[:-1].copy()
            some = np.flatnonzero(k)
            byte[some] = ends.select(base[some] + k[some]) + 1
            at.append(points.rank(byte) - start)
        units[i:j], before[i:j], inside[i:j] = n, at[0], at[1] - at[0]
    return units, before, inside


@arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in CUT]))
def cut_points(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cuts(text, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x) for x in found], CUT)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (struct of all its columns), n, form, prefix_chars, middle_chars, output.

    Forms: plain (empty texts, texts that contain a sentinel, and 100 - rate percent of the others), spm, psm.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"))
    rows = rows.withColumn("cut", cut_points("text", F.get("h", F.lit(0)), F.get("h", F.lit(1))))
    sentinel = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | sentinel | (F.get("h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "text", form.alias("form"), "cut.*")
    begin, length = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    head, middle = F.substring("text", F.lit(1), begin), F.substring("text", begin + 1, length)
    tail = F.substring("text", begin + length + 1, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle)
    spm_text = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm_text).otherwise(psm)
    hidden = F.col("form") == "plain"
    return rows.select("row", "n", "form", F.when(~hidden, F.col("prefix_chars")).alias("prefix_chars"),
                       F.when(~hidden, F.col("middle_chars")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text, from form and output alone. The parts hold no sentinel, so the first of each is the one that was put in."""
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))
    one = F.call_function("substring_index", body, second, F.lit(1))
    rest = F.substring(body, F.char_length(one) + len(SUFFIX) + 1, F.char_length(body))
    two = F.substring_index(rest, MIDDLE, 1)
    three = F.substring(rest, F.char_length(two) + len(MIDDLE) + 1, F.char_length(rest))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, one)).otherwise(F.concat(one, three, two))


SQL = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
    h AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
        ('0x' || d[25:32])::BIGINT AS h4 FROM u),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
            ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


@query("op13_infilling", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, cut points and digests of every document; digests are of the output and of the text rebuilt from it."""
    out = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))
