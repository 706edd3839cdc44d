"""op11_alignment, op12_toxicity and op13_infilling on awkward rows against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.llm import alignment, infilling, toxicity
from lanewise.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, row string, n string, form string, output string, cut string, h string, score string, flush string, at string"
LONG = " ".join(f"word{k % 977} is\there" for k in range(90_000)) + " \n"          # above the batch of 1 MiB
AWKWARD = [None, "", " ", "\t\n\v\f\r ", "a", " a", "a ", "one two  three\n", "é 😀 日本語 x y", "<P>", "x <S> y", "a <M>", "<<P", "a <", "tail<P", "\x00 \x1c x\x85y",
           "<|endoftext|> <s> <unk> <0x41>", "▁ and ▁x", "ﬁ ½ ﷺ İ", "ß𝔘‍👩‍👧", "repeat repeat", "repeat repeat", LONG]


def rows_of(texts):
    rows = [(k if k % 7 else -k, t, "en", "s", 0) for k, t in enumerate(texts)]
    return rows + [rows[6], (None, "no id at all", None, None, None), (5, "another text of id five", "x", "y", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spans"))
    rng = np.random.default_rng(3)
    words = "alpha beta gamma δέλτα <P> éà 日本 , . \n \t".split(" ")
    mixed = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(150)]
    spark.createDataFrame(rows_of(AWKWARD + mixed), DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(k, t, *["keep"] * 9) for k, t in enumerate(AWKWARD[:12])], CLASH)


def texts_of(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- fill in the middle ----------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_infilling(spark, folder):
    got = collections.Counter(tuple(r) for r in QUERIES["op13_infilling"](spark, folder).collect())
    assert got == collections.Counter(infilled(i, t) for i, t in texts_of(spark, folder))
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}


def test_infilling_marks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        raw = rng.choice(np.frombuffer(" \t\n\v\f\r\x08\x0e\x1f!aé日😀".encode(), np.uint8), size)
        marks = infilling.unit_ends(infilling.words_of(raw)).view(np.uint8)[:size] > 0
        space = np.isin(raw, [32, 9, 10, 11, 12, 13])
        assert [bool(marks[k]) for k in range(size - 1)] == [bool(not space[k] and space[k + 1]) for k in range(size - 1)]
        m = infilling.Marks(infilling.point_starts(infilling.words_of(raw)))
        starts = [k for k in range(size) if raw[k] & 0xC0 != 0x80]
        assert m.select(np.arange(1, len(starts) + 1)).tolist() == starts
        assert m.rank(np.arange(size)).tolist() == [sum(s < k for s in starts) for k in range(size)]


def test_infilling_columns_and_empty(spark, clash, empty):
    out = infilling.transformed(clash, rate=100, spm=50).collect()
    assert len(out) == 12 and all(r["row"]["output"] == "keep" for r in out)
    back = infilling.transformed(clash, rate=100).select("row.text", infilling.restored(F.col("form"), F.col("output")).alias("t")).collect()
    assert all((r["text"] or "") == r["t"] for r in back)
    assert QUERIES["op13_infilling"](spark, empty).count() == 0


# ---- toxic passages --------------------------------------------------------------------------------------------

def maximal(scores):
    """Maximal scoring segments by their definition: the best segment (the shorter of equal ones, then the first), then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return maximal(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, v) for x, y, v in maximal(scores[b:])]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(300):
        scores = rng.integers(-5, 6, rng.integers(0, 25)) + rng.random() * 1e-3
        total = np.concatenate([[0.0], np.cumsum(scores)])
        at = np.flatnonzero(scores > 0)
        got = [(int(at[a]), int(at[b]) + 1) for a, b, _ in toxicity.segments(at, scores[at], total[at])]
        values = [v for *_, v in toxicity.segments(at, scores[at], total[at])]
        want = maximal(scores.tolist())
        assert sorted(np.round(values, 6)) == sorted(round(v, 6) for *_, v in want)
        assert got == [(a, b) for a, b, _ in want]


def test_rate_and_curve():
    values, weights = np.array([-1.0, 1.0]), np.array([3.0, 1.0])
    assert abs(toxicity.solve_rate(values, weights) - math.log(3)) < 1e-9
    a, b = toxicity.logistic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([10.0] * 4), np.array([0.0, 1.0, 9.0, 10.0]))
    p = 1 / (1 + np.exp(-(a + b * np.arange(4))))
    assert b > 0 and p[0] < 0.1 and p[3] > 0.9


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["zounds", "varlet", "knave", "xyzzyan", "xyzzyer", "xyzzyis", "xyzzyou"]
    docs, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, rng.integers(20, 200)))
        toxic = k % 4 == 0
        for _ in range(rng.integers(3, 9) if toxic else 0):
            words.insert(rng.integers(0, len(words)), str(rng.choice(bad)) + rng.choice(["", ",", "!"]))
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_folder(spark, tmp_path_factory):
    docs, labels = corpus(5, 800)
    more = [(9000, None), (9001, ""), (9002, "..."), (9003, LONG), (9004, "zounds " * 3000), (9004, "knave varlet knave varlet"), (None, "zounds, varlet! knave")]
    path = str(tmp_path_factory.mktemp("toxic"))
    spark.createDataFrame(docs + [(i, t, "en", "s", 0) for i, t in more], DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    odd = [(9001, 1, None), (None, 1, 1), (3, 1, 0), (777_777, 1, 1)]
    spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity(spark, toxic_folder):
    got = QUERIES["op12_toxicity"](spark, toxic_folder).collect()
    assert len(got) == 807
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [(by[k]["predicted"], int(k % 4 == 0)) for k in range(800) if held(k)]
    assert len(out) > 100 and sum(p == y for p, y in out) >= 0.98 * len(out)
    low = min(r["score"] for r in got)
    assert all(by[k]["score"] == low and by[k]["n_passages"] == 0 for k in (9000, 9001, 9002)) and by[9003]["predicted"] == 0 and by[None]["predicted"] == 1


def test_toxicity_reads_no_held_out_label(spark, toxic_folder):
    docs = spark.read.parquet(f"{toxic_folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{toxic_folder}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    turned = labels.withColumn("label", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(one.units, two.units) and np.allclose(one.scores, two.scores) and np.allclose(one.curve, two.curve)
    text = "the knave, the varlet and zounds again " + "alpha " * 50
    (_, n, segs), = one.found(pa.array([text]))
    assert n == 57 and all(s[2] > 0 for s in segs)
    assert text.encode()[min(s[0] for s in segs): max(s[1] for s in segs)].startswith(b"knave")


def test_toxicity_without_labels(spark, toxic_folder, empty, clash):
    docs = spark.read.parquet(f"{toxic_folder}/documents.parquet").select("doc_id", "text").limit(50)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.fit(docs, none) == 0.5
    assert toxicity.fit(docs, docs.selectExpr("doc_id", "1 AS label")) == 1.0
    assert QUERIES["op12_toxicity"](spark, empty).count() == 0
    for model in (0.25, toxicity.Model(np.array([4], np.uint64), np.array([1.0]))):
        out = toxicity.scored(clash, model).collect()
        assert len(out) == 12 and all(r["row"]["score"] == "keep" for r in out)


# ---- alignment -------------------------------------------------------------------------------------------------

def brute_alignment(rows):
    """Every document by itself, token by token."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.byte_of_character()
    per, count = [], collections.Counter()
    for i, t in rows:
        found = None
        if t:
            sides = [[(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids],
                     [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t)]]
            if all(b"".join(x for _, x in side) == (" " + t).encode() for side in sides):
                spans = [[(k, e - len(x), e) for (k, x), e in zip(side, np.cumsum([len(x) for _, x in side]).tolist())] for side in sides]
                links, j = [], 0
                for k, s, e in spans[0]:
                    while spans[1][j][2] <= s:
                        j += 1
                    q = j
                    while q < len(spans[1]) and spans[1][q][1] < e:
                        links.append((k, spans[1][q][0]))
                        q += 1
                common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
                member = [collections.defaultdict(list), collections.defaultdict(list)]
                for side, m in zip(spans, member):
                    at = np.searchsorted(common, [e for *_, e in side])
                    for (k, *_), g in zip(side, at.tolist()):
                        m[g].append(str(k))
                text = ";".join(",".join(member[0][g]) + "|" + ",".join(member[1][g]) for g in range(len(common)))
                found = (len(spans[0]), len(spans[1]), len(common), links, sha(text))
                count.update(set(links))
        per.append((i, found))
    top = collections.Counter()
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
            (i, f[0], f[1], f[2], len(f[3]), sum(count[x] == top[x[0]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for i, f in per]


@pytest.mark.parametrize("flush", [1 << 20, 200])
def test_alignment(spark, folder, flush, monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", flush)
    monkeypatch.setattr(alignment, "BATCH", 1 << 20 if flush > 1000 else 300)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = collections.Counter(tuple(r) for r in QUERIES["op11_alignment"](spark, folder).select(*names).collect())
    assert got == collections.Counter(brute_alignment(texts_of(spark, folder)))


def test_alignment_refines_shared_characters():
    import public_tokenizers
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab \n😀日本語ßİ𝔘👩é\t"), rng.integers(1, 50))) for _ in range(400)]
    good, _, one, two = alignment.encoder(*files).encode(texts)
    assert good.sum() > 300
    for side, vocabulary in zip((one, two), alignment.encoder(*files).words):
        assert np.array_equal(side.ends, np.cumsum(vocabulary.length[side.ids]))


def test_alignment_spans(spark, clash, empty):
    import public_tokenizers
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for r in alignment.spans(clash, *files).collect():
        text = AWKWARD[r["row"]["doc_id"]]
        assert r["row"]["flush"] == "keep"
        if text:
            assert r["a_ends"][-1] == r["b_ends"][-1] == r["group_ends"][-1] == len(text.encode()) + 1
            assert set(r["group_ends"]) == set(r["a_ends"]) & set(r["b_ends"])
        else:
            assert r["a_ids"] == r["b_ids"] == []
    assert QUERIES["op11_alignment"](spark, empty).count() == 0
