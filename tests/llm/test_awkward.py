"""Cases that went wrong before: letters that lower-case to marks, tables stored in folders, clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import embeddings, katz, near_dedup, packing, passages, token_store


def test_token_ids_of_every_letter():
    """Ids equal the library's on text of letters of all scripts, marks and tails."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x41, 0x30000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(7)
    texts = ["İ.", "İİ!", "xİ.y", "ALİ, İSTANBUL.", "İ", "i̇.", "ẞ!", "ΑΣ.", "Å."]
    texts += ["".join(c + str(rng.choice(["", ".", "!?", "'s", "9"])) for c in letters[k: k + 40]) for k in range(0, len(letters), 40)][::7]
    pool = list("İıßσςΣéÅaZ9'.,!?-") + ["́", "̇", " ", "<|", "|>"] + [letters[k] for k in rng.integers(0, len(letters), 40)]
    texts += ["".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(3000)]
    got = token_store.encode([t.encode() for t in texts], path)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed_bigrams_are_small(spark, monkeypatch):
    """What is stored of the bigrams of mostly distinct pairs: less than their codes and numbers alone take unpacked, nothing lost."""
    stored, durable = {}, katz.durable

    def watched(df, name, *rest):
        stored[name] = durable(df, name, *rest)
        return stored[name]

    monkeypatch.setattr(katz, "durable", watched)
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 3000, 400)) for _ in range(200)]
    model = katz.fit(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    rows, seen = stored["bigrams"].collect(), {(v, w) for t in texts for v, w in zip(["\n", *t.split()], [*t.split(), "\n"])}
    n = np.concatenate([katz.joined([r["n"]], "<i8") if hasattr(katz, "squeezed") else np.frombuffer(r["n"], "<i8") for r in rows])
    assert len(n) == len(seen) and n.sum() == 200 * 401 == model.total
    assert sum(len(r["code"]) for r in rows) < 3.2 * len(seen)
    assert sum(len(r["n"]) for r in rows) < len(seen)


@pytest.mark.parametrize("n", [600, 2400])
def test_cells_of_vectors_stay_small(spark, monkeypatch, n):
    """Vectors without a direction of their own: cells grow finer with the table, links are those of brute force, a hub's and its copies' too."""
    monkeypatch.setattr(embeddings, "TILE", 64)
    monkeypatch.setattr(embeddings, "GUESTS", 96, raising=False)
    homes, durable = [], embeddings.durable

    def watched(df, name, *rest):
        out = durable(df, name, *rest)
        if name == "cells":
            homes.extend(r["count"] for r in out.where("home").groupBy("block", "cell").count().collect())
        return out

    monkeypatch.setattr(embeddings, "durable", watched)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, 64)) + 0.3 * rng.standard_normal(64)
    x[: n // 10] = x[n // 10: 2 * (n // 10)] + rng.uniform(0.1, 0.4, (n // 10, 1)) * rng.standard_normal((n // 10, 64))      # on both sides of the bound
    x[n - 50:] = x[0] + 0.05 * rng.standard_normal((50, 64))
    x[7] = x[8]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    least, label = None, np.arange(n)
    while least is None or (least != label).any():
        least, label = label, np.where(near, label, n).min(axis=1)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(rows).collect()}
    assert got == {k: (int(near[k].sum()) - 1, int(label[k])) for k in range(n)}
    assert max(homes) <= 4 * 64


def test_each_word_is_judged_once(monkeypatch):
    """Ids equal the library's over caches that are emptied, words without ids and words too long to keep; plain words take no second look."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path, looks, judge = public_tokenizers.path("word_bpe_49k.json"), [], token_store.letters_only
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(token_store, "letters_only", lambda t: looks.append(t) or judge(t))
    monkeypatch.setattr(token_store, "WORD_CACHE", 20)
    monkeypatch.setattr(token_store, "CORE_CACHE", 25)
    monkeypatch.setattr(token_store, "_tokenizers", {})
    plain = [" ".join(f"{chr(97 + k % 26)}word{'x' * (k % 5)}s Again, and-on." for k in range(n, n + 9)) for n in range(0, 60, 3)]
    odd = ["\x00 \x01x \x00", "", " \n", "y" * 300 + ". " + "z" * 65 + " y", "\x00", "é" * 80 + " é!", "the the, THE"]
    for texts in (plain[:9], odd, plain, odd + plain[::-1]):
        for t, ids in zip(texts, token_store.encode([t.encode() for t in texts], path)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert not any(t.isascii() and t.isalpha() for t in looks)


def test_no_overfull_bin_in_a_partitioned_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(n)), "en", f"s{k % 2}", 0) for k, n in enumerate(rng.integers(0, 2500, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.partitionBy("source").parquet(str(tmp_path / "t"))
    out = packing.packed(spark.read.parquet(str(tmp_path / "t")))
    assert out.groupBy("bin").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(len(t.split()) + 1 for _, t, *_ in rows)


def plain_best_fit(items, capacity, per_source):
    """(length, clusters, source) in order of length: the fullest bin that takes it, else a new one."""
    bins, where = [], {}
    for k in sorted(range(len(items)), key=lambda k: (-items[k][0], k)):
        n, clusters, source = items[k]
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if b["used"] + n <= capacity and not b["clusters"] & clusters
                and (source is None or b["sources"].count(source) < per_source)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "clusters": set(), "sources": []})
        bins[i]["used"] += n
        bins[i]["clusters"] |= clusters
        bins[i]["sources"].append(source)
        where[k] = i
    return where


def test_op10_against_plain_best_fit(spark, tmp_path):
    """The registered query on a stored table of several files, near copies among them."""
    from lanewise.llm.queries import QUERIES
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in rng.integers(1, 3000, 70)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["changed"]) for b in base[:40]] + [" ".join(base[0]), "", None]
    rows = [(k, t, "en", f"s{k % 3}" if k % 9 else None, 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op10_packing"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out if r["n_tokens"] == packing.CAPACITY and r["bin"].startswith("row:")) == sorted(
        (k, packing.CAPACITY) for k, t in enumerate(texts) for _ in range(len((t or "").split()) // packing.CAPACITY))
    stored = [(r["key"], r["source"], r["marks"], r["n_words"]) for r in packing.measured(spark.read.parquet(str(tmp_path / "documents.parquet"))).orderBy("file", "row").collect()]
    plain = plain_best_fit([((n + 1) - n // packing.CAPACITY * packing.CAPACITY, set(m), s) for _, s, m, n in stored], packing.CAPACITY, packing.PER_SOURCE)
    got = {r["doc_id"]: r["bin"] for r in out if not r["bin"].startswith("row:")}
    pairs = {(stored[k][0], f"0:{b}") for k, b in plain.items()}
    assert {(i, b) for i, b in got.items()} == pairs
    assert all(got[k] != got[70 + k] for k in range(40) if len(base[k]) > 30)          # near copies are in different bins


def test_columns_named_like_working_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "keep", "keep", "keep", "keep", 1), (2, "own words go first " + text, "keep", "keep", "keep", "keep", 1), (3, "something else", "keep", "keep", "keep", "keep", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _uid string, _text string, _doc string, c0 int")
    cut = {r["doc_id"]: r for r in passages.cut_texts(docs).collect()}
    assert cut[1]["text"] == text and cut[2]["text"] != rows[1][1] and cut[3]["text"] == "something else"
    assert all(r[c] == "keep" for r in cut.values() for c in ("_id", "_uid", "_text", "_doc")) and all(r["c0"] == 1 for r in cut.values())
    kept = near_dedup.one_of_each(docs.withColumn("text", F.lit(text))).collect()
    assert [(r["doc_id"], r["_doc"], r["_id"]) for r in kept] == [(1, "keep", "keep")]


def components_of(rows):
    """By brute force over nodes (doc_id, text): smallest doc_id reachable by links of at least 75 %."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = {r: shingles(r[1]) for r in set(rows)}
    left, out = set(sets), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
            left.difference_update(near)
            todo += near
        out.update({x: min(i for i, _ in group) for x in group})
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies_without_a_common_middle(spark, monkeypatch, block):
    """Copies that are edited again and again: many pairs are near the threshold on both sides."""
    monkeypatch.setattr(near_dedup, "SET_BLOCK", block)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(120)]
        for k in range(60):
            words = list(words)
            for at in rng.integers(0, 120, rng.integers(1, 4)):
                words[at] = f"e{rng.integers(0, 1000)}"
            rows.append((int(1000 * g + rng.integers(0, 10 ** 6) * 3 + g), " ".join(words)))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    want = components_of(rows)
    got = {r["doc"]: r["component"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: want[i, t] for i, t in rows}
    assert 3 <= len(set(got.values())) < 60


def test_one_doc_id_on_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc"], r["n_shingles"], r["component"]) for r in near_dedup.near_duplicates(docs).collect())
    assert found == sorted([(1, 26, 1), (5, 26, 1), (5, 26, 5), (7, 26, 5), (9, 26, 9), (9, 26, 9), (9, 0, 9), (9, 0, 9)])
    kept = sorted((r["doc_id"], r["text"] or "") for r in near_dedup.one_of_each(docs).collect())
    assert kept == sorted([(1, a), (5, b), (9, c), (9, c), (9, ""), (9, "")])


def test_joining_links_join_all_that_brute_force_joins():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(60, rng.integers(20, 50), replace=False)).astype(np.uint64) for _ in range(60)]
    sets += [np.sort(np.unique(np.append(s[:-2], 70 + k))).astype(np.uint64) for k, s in enumerate(sets[:30])]
    sig = np.stack([near_dedup.signature(near_dedup.mix64(s)) for s in sets])
    items = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :near_dedup.SET_BYTES].tobytes() for s in sets]
    n = len(sets)
    keys = [np.array([0, 1 + k % 3]) for k in range(n)]

    def groups(links):
        label = list(range(n))
        for x, y in links:
            lo, hi = min(label[x], label[y]), max(label[x], label[y])
            label = [lo if v == hi else v for v in label]
        return label
    brute = []
    for x in range(n):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                brute.append((x, y))
    got = near_dedup.joining_links(sig, items, keys, np.arange(n), None)
    assert set(map(lambda p: (max(p), min(p)), got)) <= set(brute)
    assert groups(got) == groups(brute) and len(got) == n - len(set(groups(brute)))
