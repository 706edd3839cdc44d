"""Every registered corpus query over a folder of awkward tables and over empty ones; the digests of some by plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

from lanewise.llm import fingerprints, quality
from lanewise.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
OPS = ["op1_fingerprints", "op2_quality", "op3_near_dedup", "op4_token_store", "op5_sharding", "op6_katz", "op7_passages", "op8_mixing", "op9_embeddings", "op10_packing",
       "op11_alignment", "op12_toxicity", "op13_infilling"]


def corpus():
    rng = np.random.default_rng(12)
    words = np.array([f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "ond", "ust")])
    good = [" ".join(rng.choice(words, rng.integers(30, 120))).capitalize() + "." for _ in range(90)]
    junk = ["!!! " + " ".join([str(rng.choice(words)).upper() + "!!"] * int(rng.integers(20, 60))) for _ in range(30)]
    texts = good + junk
    texts += [texts[0], texts[1] + " and a tail of its own", None, "", " \t\n", "é 😀 日本", "\x00\x1c", " ".join(f"long{k % 7919}" for k in range(150_000))]
    labels = [(k, int(k < 90), 0) for k in range(120)]
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[5]], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("all"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(40)] + [(50, None), (51, [0.0] * 16), (52, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name, ddl in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], ddl).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", OPS)
def test_one_row_each(spark, folder, name):
    rows, _ = corpus()
    got = QUERIES[name](spark, folder).collect()
    if name == "op9_embeddings":
        assert sorted(r["vec_id"] for r in got) == [*range(40), 50, 51, 52]
    elif name == "op10_packing":
        assert {r["doc_id"] for r in got} == {i for i, *_ in rows}
    else:
        assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in rows)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def shingles(text):
    w = (text or "").split(" ") if "\t" not in (text or "") else (text or "").split()
    w = [x.lower() for x in " ".join(w).split()]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_op1_by_plain_python(spark, folder):
    rows, _ = corpus()
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    got = {(r["doc_id"]): r for r in QUERIES["op1_fingerprints"](spark, folder).collect()}
    prints = {}
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        if i == 5:                                   # the repeated row follows itself
            continue
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(t, set()).add(r["fingerprint"])
        for column, other in (("near_edited", edited), ("near_next", follow)):
            a, b = shingles(t), shingles(other)
            if len(a) > 20 and len(b) > 20:
                assert abs(r[column] - len(a & b) / len(a | b)) < 0.25          # five standard errors of 128 bins
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.BINS == 128


def test_op2_scores_and_folds(spark, folder):
    got = QUERIES["op2_quality"](spark, folder).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.THRESHOLD)
    held = [(r["predicted"], int(r["doc_id"] < 90)) for r in got if r["held_out"] and r["doc_id"] < 120]
    assert len(held) > 10 and sum(p == y for p, y in held) >= 0.9 * len(held)
