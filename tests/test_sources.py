"""Document files, the resume log and stored upserts."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise import schemas
from lanewise.plans import queries_sources
from lanewise.plans.queries_sources import document_files
from lanewise.sources import reference, resume, variants
from lanewise.sources.commits import Commits


def write(folder, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_document_shapes(spark, tmp_path):
    path = write(tmp_path / "in", a=[{"doc_id": "l1", "layout": "x", "fields": {"total": 12.5, "items": [{"amount": 3}, {"amount": 4.5}]}}, {"doc_id": 7, "source": "s", "total": "9"}],
                 b={"records": [{"doc_id": "r1", "fields": {"total": None}}]}, c={"k1": {"layout": "y", "fields": {"total": 1}}, "k2": {"doc_id": "own", "total": 2, "path": "p"}, "k3": 5},
                 d="no json", e=[], f={"records": {"layout": "z", "total": 8}})
    got = {r["doc_id"]: r for r in variants.read_documents(spark, path).select(
        "doc_id", "layout", F.map_keys("fields").alias("names"), variants.field("total", kind="double").alias("n"), variants.field("total").alias("t"),
        variants.field("items", "$[1].amount", "double").alias("second"), F.schema_of_variant(F.try_element_at("fields", F.lit("items"))).alias("kind")).collect()}
    assert set(got) == {"l1", "7", "r1", "k1", "own", "k3", "records"}
    assert got["l1"]["n"] == 12.5 and got["l1"]["second"] == 4.5 and got["l1"]["kind"].startswith("ARRAY<OBJECT")
    assert got["7"]["layout"] == "unknown" and got["7"]["names"] == ["total"] and got["7"]["t"] == "9"
    assert got["r1"]["n"] is None and got["k1"]["layout"] == "y" and got["own"]["names"] == ["total"] and got["k3"]["names"] == [] and got["records"]["n"] == 8


def test_document_lines(spark, tmp_path):
    path = write(tmp_path / "in", a='{"doc_id": "1", "fields": {"a": [1, 2]}}\nnot json\n[1]\n{"doc_id": "2", "b": true}\n')
    rows = {r["doc_id"]: r["k"] for r in variants.read_document_lines(spark, path).select("doc_id", F.map_keys("fields").alias("k")).collect()}
    assert rows == {"1": ["a"], "2": ["b"]}


RESULT = "id string, n int"


def test_resumed_work_loses_and_repeats_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    items = spark.createDataFrame([(f"i{k}",) for k in range(500)] + [("i3",), (None,)], "id string")
    calls = []

    def work(part):
        rows = part.withColumn("n", F.length("id"))
        calls.append(sorted(r["id"] for r in part.collect()))
        return rows

    resume.process(items, work, log, "id", RESULT, chunks=5, stop=lambda k: k == 2)
    half = sorted(r["id"] for r in resume.read_log(spark, log, RESULT).collect())
    assert 100 < len(half) < 400 and sorted(sum(calls, [])) == half
    (tmp_path / "log" / "part-torn.json").write_text('{"id": "i499x", "n": 5}\n{"id": "i4')
    calls.clear()
    done = resume.process(items, work, log, "id", RESULT, chunks=5).collect()
    assert sorted(r["id"] for r in done) == sorted([f"i{k}" for k in range(500)] + ["i499x"])
    assert not set(sum(calls, [])) & set(half)
    calls.clear()
    resume.process(items, work, log, "id", RESULT, chunks=5)
    assert sum(calls, []) == []


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_filter_before_the_exact_join(spark, n):
    done = spark.range(n).selectExpr("CAST(id AS string) AS id")
    items = spark.range(2000, 6000).selectExpr("CAST(id AS string) AS id", "id AS v").unionByName(spark.createDataFrame([(None, -1)], "id string, v long"))
    got = sorted(r["v"] for r in resume.unfinished(items, done, "id").collect())
    assert got == [-1, *range(max(2000, n), 6000)]
    if n == 3000:
        probe = resume.maybe_done(resume.done_filter(done, "id"))
        rate = items.where("v >= 3000").agg(F.avg(probe(F.xxhash64("id")).cast("double"))).first()[0]
        assert rate < 0.01


VENDOR = "k string, x double, version int"


def test_merge_shows_one_version(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "ref"))
    first = spark.createDataFrame([(f"k{i}", float(i), 1) for i in range(40)], VENDOR)
    news = spark.createDataFrame([("k1", 100.0, 2), ("k2", float("nan"), 2), ("new", 7.0, 2), ("k3", -1.0, 0)], VENDOR)
    assert reference.merge_reference(commits, first, ["k"], "version", buckets=4)
    reader = reference.merged_reference(commits, first.schema)
    before = sorted(map(tuple, reader.collect()))
    assert reference.merge_reference(commits, news, ["k"], "version", buckets=4)
    assert sorted(map(tuple, reader.collect())) == before                     # a reader that began before the merge keeps its version
    once = sorted(map(tuple, reference.merged_reference(commits, first.schema).collect()), key=str)
    want = {f"k{i}": (float(i), 1) for i in range(40)} | {"k1": (100.0, 2), "k2": (None, 2), "new": (7.0, 2)}
    assert {k: (x, v) for k, x, v in once} == want
    reference.merge_reference(commits, news, ["k"], "version", buckets=4)
    assert sorted(map(tuple, reference.merged_reference(commits, first.schema).collect()), key=str) == once
    assert not reference.merge_reference(commits, first, ["k"], "version", buckets=4, expected=41)
    assert sorted(map(tuple, reference.merged_reference(commits, first.schema, 0).collect())) == before
    rows = commits.rows()
    assert any(rows[0][b] == rows[1][b] for b in rows[0]) or len(rows[0]) == len({b for b in rows[1] if rows[1][b] != rows[0].get(b)})


def test_uncommitted_parts_are_not_read(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    spark.range(3).write.parquet(commits.fresh("t", 0))                        # a step that died
    assert commits.rows() == {} and commits.read("t", "id long").isEmpty()
    path = commits.fresh("t", 0)
    spark.range(5).write.parquet(path)
    commits.commit(0, {"t": path})
    assert commits.read("t", "id long").count() == 5 and commits.done(0) and not commits.done(1)


def test_first_folder_wins(spark, tmp_path):
    rows = spark.createDataFrame([("VEN001", "One", "S", 3, None)], schemas.VENDORS)
    rows.write.option("header", True).csv(str(tmp_path / "b" / "vendors.csv"))
    rows.withColumn("vendor_name", F.lit("Other")).write.parquet(str(tmp_path / "c" / "vendors.parquet"))
    folders = [str(tmp_path / n) for n in "abc"]
    assert reference.read_reference(spark, "vendors", folders).first()["vendor_name"] == "One"
    with pytest.raises(FileNotFoundError):
        reference.read_reference(spark, "hubs", folders)


def test_files_hold_many_documents_and_kinds_are_not_told_by_schemas(spark, tmp_path, capsys):
    names = [f for f in C.CORE_FIELDS]
    docs = spark.range(0, 16_000, 2).select(F.format_string("D%d", "id").alias("doc_id"), F.lit("a").alias("layout"), F.col("id").alias("doc_seq"),
                                            *[F.lit("1").alias(f"gt_{f}") for f in names])
    document_files(SimpleNamespace(documents=docs), str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs" / "files").glob("part-*"))) == 2      # one list and one with records, not one for a thousand numbers
    read = variants.read_documents(spark, str(tmp_path / "docs" / "files"))
    assert read.count() == read.select("doc_id").distinct().count() == 8000
    read.explain("extended")
    assert "schema_of_variant" not in capsys.readouterr().out


def test_document_files_are_packed(spark, tmp_path, monkeypatch):
    """Documents are text of many times the rows' size: their files are packed, read back whole, and none of lines grows with the table."""
    monkeypatch.setattr(queries_sources, "LINES_EACH", 600)
    docs = spark.range(8000).select(F.format_string("D%d", "id").alias("doc_id"), F.lit("a").alias("layout"), F.col("id").alias("doc_seq"),
                                    *[F.lit("1").alias(f"gt_{f}") for f in C.CORE_FIELDS]).coalesce(1)
    queries_sources.document_files(SimpleNamespace(documents=docs), str(tmp_path))
    files, lines = (list((tmp_path / n).glob("part-*")) for n in ("files", "lines"))
    assert len(files) == 3 and len(lines) == 4 and all(p.name.endswith(".gz") for p in files + lines)
    assert sum(p.stat().st_size for p in files + lines) < 300_000
    read = variants.read_documents(spark, str(tmp_path / "files")).unionByName(variants.read_document_lines(spark, str(tmp_path / "lines")))
    assert {r["doc_id"] for r in read.select("doc_id").collect()} == {f"D{k}" for k in range(8000)} and read.count() == 8000
