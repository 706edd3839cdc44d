"""Every operator on awkward rows, against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import embeddings, fingerprints, katz, mixing, near_dedup, packing, passages, quality, sharding, token_store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


BASE = prose(1, 80)
TEXTS = [
    (0, BASE), (1, BASE), (1, BASE), (2, BASE.replace("alpha", "ALPHA", 1)), (3, None), (4, ""), (5, "   \n\t "), (6, "one two"), (7, "One Two"), (8, "é" * 30 + " ü"),
    (9, prose(2, 60) + " " + BASE), (10, prose(3, 6000)), (11, "a" * 400), (12, "a" * 300 + "b"), (13, BASE + " tail one two three"), (None, prose(4, 30)), (15, prose(5, 40)), (16, prose(5, 40)),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, record string, bucket string, doc string, cell string, key string, uid string, block string, _text string, position string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), *["x"] * 9) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def raw(t):
    return (t or "").encode()


def words(t):
    return raw(t).lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark, docs, none):
    out = fingerprints.with_fingerprint(docs.select("doc_id", "text"), "text", "fp").withColumn("s", fingerprints.as_text("fp"))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r["text"] or ""].add(r["s"])
        assert len(r["s"]) == (2 * fingerprints.BINS if words(r["text"]) else 0)
    assert all(len(v) == 1 for v in got.values())
    assert got[BASE] == got[BASE.replace("alpha", "ALPHA", 1)]
    pairs = out.select(F.col("fp").alias("a")).crossJoin(out.where("doc_id = 13").select(F.col("fp").alias("b"), "text")).withColumn("l", fingerprints.likeness("a", "b"))
    assert all(0 <= r["l"] <= 1 for r in pairs.collect())
    near = out.where("doc_id = 0").select(F.col("fp").alias("a")).crossJoin(out.where("doc_id = 13").select(F.col("fp").alias("b"))).select(fingerprints.likeness("a", "b").alias("l")).first()["l"]
    truth = len(shingles(BASE) & shingles(TEXTS[14][1])) / len(shingles(BASE) | shingles(TEXTS[14][1]))
    assert abs(near - truth) < 0.15
    assert fingerprints.with_fingerprint(none, "text", "fp").count() == 0


def test_next_in_descending_id(spark, docs):
    low = -(1 << 63)
    rows = docs.select(F.coalesce("doc_id", F.lit(low).cast("long")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(rows, 6).collect()
    order = sorted(((low if i is None else i, t or "") for i, t in TEXTS), reverse=True)
    want = collections.Counter((*order[k], order[(k + 1) % len(order)][1]) for k in range(len(order)))
    assert collections.Counter((r["id"], r["text"], r["next_text"]) for r in got) == want


def test_quality(spark, docs, none):
    stats = quality.with_statistics(docs).cache()
    assert stats.count() == len(TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(3, None), (None, 1), (99, 1)], "doc_id long, label int")
    model = quality.fit(stats, labels)
    scores = [r["score"] for r in quality.scores(stats, model).collect()]
    assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(TEXTS)
    assert quality.fit(stats, labels.where("false")) is None
    assert quality.keep_good(docs, labels.where("false")).count() == len(TEXTS)
    assert quality.keep_good(none, labels).count() == 0


def test_isotonic():
    level = quality.isotonic(np.array([1.0, 2, 0, 1, 1]), np.array([1.0, 0, 0, 0, 1]))
    assert np.allclose(level, [0.25, 0.25, 0.25, 0.25, 1])


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, none):
    sets = {i: shingles(t) for i, t in TEXTS if i is not None}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and 100 * len(x & y) >= 75 * len(x | y)
    want = components_of(sorted(sets), linked)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r["doc"] is not None:
            assert (r["n_shingles"], r["component"]) == (len(sets[r["doc"]]), want[r["doc"]])
        else:
            assert r["component"] is None
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(i for i, _ in TEXTS if i is None or want[i] == i)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_without_a_common_pivot(spark):
    """A chain and a star whose least member is linked with few: the open buckets must be settled too."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        t = list(base)
        for j in range(4):
            t[(17 * k + 23 * j) % 100] = f"x{k}_{j}"
        rows.append((k, " ".join(t)))
    rows.append((50, " ".join(base)))
    for k in range(8):
        rows.append((100 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 60))))
    sets = {i: shingles(t) for i, t in rows}
    want = components_of(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc"]: r["component"] for r in got.collect()} == want


def test_least_matches():
    assert near_dedup.least_matches(128) < 96 and near_dedup.least_matches(32) < near_dedup.least_matches(64)


def test_token_store(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write_store(docs, path)
    got = token_store.with_global_start(spark, store, token_store.read_store(spark, store)).collect()
    tok, at = Tokenizer.from_file(path), 0
    want = collections.Counter()
    for i, t in sorted(((token_store.NULL_KEY if i is None else i), t or "") for i, t in TEXTS):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert collections.Counter((r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    found = token_store.lookup(spark, store, spark.createDataFrame([(1,), (9,), (1000,), (-5,)], "doc_id long")).collect()
    assert collections.Counter(r["key"] for r in found) == {1: 2, 9: 1}
    empty = token_store.write_store(none, path)
    assert token_store.read_store(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 5000))
    levels, slot = token_store.build_index(keys)
    assert sorted(slot) == list(range(len(keys))) and (token_store.find_slots(levels, keys) == slot).all()


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(spark, docs, none, shards):
    rows = sharding.shuffled_shards(docs, shards).select("record.doc_id", "record.text", "shard", "slot").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter(TEXTS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffled_shards(none).count() == 0


def test_sharding_holds_no_split_at_once(spark, docs, monkeypatch):
    """One input split of many bytes: buckets are bounded in bytes, and rows are dealt to them before they are gathered."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1000)
    one = docs.select("doc_id", "text").coalesce(1)
    assert sharding.total_bytes(one) == sum(len(raw(t)) + 16 for _, t in TEXTS)
    out = sharding.shuffled_shards(one, 3)
    written = spark.read.parquet(out.inputFiles()[0].rpartition("/")[0])
    assert written.select("bucket").distinct().count() > 5
    rows = out.select("record.doc_id", "record.text", "shard", "slot").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter(TEXTS)
    places = sorted((r["slot"], r["shard"]) for r in rows)
    assert places == [(k // 3, k % 3) for k in range(len(TEXTS))]


def test_katz_sums_to_one(spark, docs, none, monkeypatch):
    monkeypatch.setattr(katz, "VOCABULARY", 6)
    train = [t for i, t in TEXTS[:14]]
    model = katz.fit(docs.where("doc_id < 13").select("text"))
    counts = collections.Counter(w for t in train[:13] for w in words(t))
    queries = [w.decode() for w in counts] + ["neverseen"]
    # P(w1) P(w2 | w1) P(end | w2) over every w2 and the end: texts "w1 w2" and "w1", for a known and an unknown history
    for first in ("alpha", "neverseen", "two"):
        rows = [(k, f"{first} {w}") for k, w in enumerate(queries)] + [(-1, first), (-2, f"{first} {first}"), (-3, f"{first} {first} {first}")]
        out = {r["doc_id"]: r["score"] for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
        after = {w: out[k] for k, w in enumerate(queries)}
        single = {r["text"]: r["score"] for r in katz.score(spark.createDataFrame([(w,) for w in queries], "text string"), model, ["text"]).collect()}
        start = {r["text"]: r["score"] for r in katz.score(spark.createDataFrame([(f"{w} {w}",) for w in queries], "text string"), model, ["text"]).collect()}
        assert all(v < 0 for v in [*after.values(), *single.values(), *start.values()])
    keys, n = [], []
    for r in model.bigrams.collect():
        keys.append(np.frombuffer(r["keys"], "<u4").astype(int))
        n.append(np.frombuffer(r["counts"], "<i8"))
    key, c = np.concatenate(keys), np.concatenate(n)
    p = np.r_[model.p_word(model.counts), model.other()]
    assert math.isclose(p.sum(), 1, rel_tol=1e-9)
    rare = model.unigrams.where(F.col("n") < int(model.counts.min())).collect()
    assert math.isclose(sum(model.p_word(np.array([r["n"] for r in rare]))) + model.unknown, model.other(), rel_tol=1e-9)
    for v in np.unique(key >> 16):
        w, k = key[key >> 16 == v] & 65535, c[key >> 16 == v]
        seen = (model.scale[v] * katz.discounted(k, model.d2) / model.history[v]).sum()
        assert math.isclose(seen + model.alpha[v] * (1 - p[w].sum()), 1, rel_tol=1e-9)
    assert katz.score(docs, model, ["doc_id"]).count() == len(TEXTS)
    assert katz.score(none, model, ["doc_id"]).count() == 0
    assert katz.score(docs, katz.fit(none.select("text")), ["doc_id"]).where("score > 0").count() == 0


def brute_katz(train):
    """log10 P of a text, by counts of all words and all bigrams."""
    rows = [[*words(t), "</s>"] for t in train]
    c1, c2 = collections.Counter(w for r in rows for w in r), collections.Counter(b for r in rows for b in zip(["</s>", *r], r))
    few = lambda c: katz.discounts([sum(n == k for n in c.values()) for k in range(1, katz.K + 2)])
    d1, d2, total = few(c1), few(c2), sum(c1.values())
    cut = lambda n, d: n * d[n] if n <= katz.K else n
    seen = sum(cut(n, d1) for n in c1.values()) / total
    unknown = max(1 - seen, 1 / (total + 1))
    p = lambda w: cut(c1[w], d1) / total * (1 - unknown) / seen if w in c1 else unknown
    after = collections.defaultdict(dict)
    for (v, w), n in c2.items():
        after[v][w] = n

    def share(w, v):
        if v not in after:
            return p(w)
        h = sum(after[v].values())
        mass = sum(cut(n, d2) for n in after[v].values()) / h
        left = max(1 - mass, 1 / (h + 1))
        if w in after[v]:
            return (1 - left) / mass * cut(after[v][w], d2) / h
        return left / (1 - sum(p(x) for x in after[v])) * p(w)

    def score(t):
        r = [*words(t), "</s>"]
        return sum(math.log10(share(w, v)) for v, w in zip(["</s>", *r], r))
    return score


@pytest.mark.parametrize("vocabulary", [0, 6, 65_535])
def test_katz_counts_bigrams_of_rare_words(spark, docs, monkeypatch, vocabulary):
    monkeypatch.setattr(katz, "VOCABULARY", vocabulary)
    model = katz.fit(docs.where("doc_id < 13").select("text"))
    truth = brute_katz([t for i, t in TEXTS if i is not None and i < 13])
    texts = [*[t for _, t in TEXTS], "two one two", "never seen one two", "tail one", "one two alpha beta", "ü ü"]
    got = katz.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r["score"], truth(texts[r["doc_id"]]), rel_tol=1e-9, abs_tol=1e-9)


def brute_passages(rows):
    seen, out = collections.defaultdict(lambda: math.inf), {}
    for i, b in rows:
        for k in range(len(b) - 49):
            seen[b[k:k + 50]] = min(seen[b[k:k + 50]], i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        out[(i, b)] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_passages(spark, docs, none):
    top = (1 << 63) - 1
    want = brute_passages([(top if i is None else i, raw(t)) for i, t in TEXTS])
    got = passages.without_repeats(docs, ["doc_id", "text", "record"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        key = (top if r["doc_id"] is None else r["doc_id"], raw(r["text"]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[key]
    cut = passages.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    assert passages.without_repeats(none).count() == 0


def test_cut_texts_keeps_replacement_characters(spark):
    shared = " shared passage of more than fifty bytes, told twice over " * 2
    own = "own \ufffd text, no passage of it comes again \ufffd"
    rows = [(1, own), (2, "\u00e9" + shared + "\u00e9 end"), (3, "\ufffd a " + "\u0169" + shared + "\u00ea tail \ufffd"), (4, "\ufffd")]
    got = {r["doc_id"]: r["text"] for r in passages.cut_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1], got[2], got[4]) == (own, rows[1][1], "\ufffd")
    # the last byte of the letter before and the first of that after the passage are shared: both letters go as a whole
    assert got[3] == "\ufffd a  tail \ufffd"
    assert passages.whole_characters("a\u20acb".encode(), 2, 3) == (1, 4)


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 60, 700):
        for letters in (1, 2, 5):
            text = rng.integers(97, 97 + letters, n).astype(np.uint8)
            order, b = passages.suffix_order(text), text.tobytes()
            assert sorted(order.tolist()) == list(range(n))
            cut = [b[i:i + 50] for i in order]
            assert cut == sorted(cut)
            lcp = passages.common_prefixes(text, order)
            for k in range(1, n):
                x, y = (b[order[k - 1]:] + b"\0" * 60)[:50], (b[order[k]:] + b"\0" * 60)[:50]
                assert lcp[k] == next((j for j in range(50) if x[j] != y[j]), 50)


def test_mixing(spark, docs, none):
    got = mixing.mixed(docs, {"s0": 3.0, "s1": 1.0}, block=2).select("record.doc_id", "source", "block", "turn", "position", "release", "deadline").collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in TEXTS)
    assert sorted(r["position"] for r in got) == list(range(len(TEXTS)))
    assert all(r["release"] <= r["turn"] < r["deadline"] for r in got)
    assert len({(r["source"], r["block"]) for r in got}) == len({r["turn"] for r in got})
    assert mixing.in_mixed_order(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0


def test_lag_is_under_one_block():
    w = mixing.integer_weights({"a": 50, "b": 7, "c": 1, "d": 1}, 100)
    slots, period = mixing.schedule_period(w), sum(w.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(period))
    for s, at in slots.items():
        assert all(abs(sum(x <= t for x in at) - w[s] * (t + 1) / period) < 1 for t in range(period))
    plan = mixing.phases({"a": 5, "b": 90, "c": 31, "d": 0}, w)
    taken = collections.Counter()
    for s, _, first, n, *_ in plan:
        assert first == taken[s]
        taken[s] += n
    assert taken == {"a": 5, "b": 90, "c": 31}


def test_packing(spark, docs, none):
    rows = packing.packed(docs, capacity=64, per_source=2).collect()
    size, held = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["doc_id"]] += r["n_tokens"]
        held[r["bin"]].append(r)
    assert size == sum((collections.Counter({i: len(words(t)) + 1}) for i, t in TEXTS), collections.Counter())
    assert all(sum(r["n_tokens"] for r in b) <= 64 for b in held.values())
    texts = dict(TEXTS)
    for b in held.values():
        same = [texts[r["doc_id"]] or "" for r in b]
        assert len(set(same)) == len(same)
    assert packing.packed(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    found = packing.best_fit([8, 7, 3, 2, 2], [0, 1, 0, 1, 0], [0, 0, 0, 0, 0], 10, 5)
    assert [b for b, _ in found] == [0, 1, 1, 0, 2]
    rng = np.random.default_rng(1)
    n, c, s = rng.integers(1, 60, 200).tolist(), rng.integers(0, 9, 200).tolist(), rng.integers(0, 3, 200).tolist()
    bins = collections.defaultdict(list)
    for i, (b, _) in enumerate(packing.best_fit(n, c, s, 64, 2)):
        bins[b].append(i)
    for b in bins.values():
        assert sum(n[i] for i in b) <= 64 and len({c[i] for i in b}) == len(b) and max(collections.Counter(s[i] for i in b).values()) <= 2


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + 0.15 * rng.standard_normal(24) * (i >= 40)).tolist()) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (202, [2e30 * x for x in rows[3][1]]), (203, None), (204, []), (205, [0.0] * 24), (206, [float("nan")] + [1.0] * 23),
             (207, [float("inf")] + [1.0] * 23), (208, [None] + [1.0] * 23), (209, [1.0, 2.0])]
    x = {k: (i, np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max()) for k, (i, v) in enumerate(rows) if k < 124}
    links = {k: [m for m in x if m != k and x[k][1] @ x[m][1] >= 0.95] for k in x}
    ids = sorted({i for i, _ in rows})
    want = components_of(ids, lambda a, b: any(x[m][0] == b for k in x if x[k][0] == a for m in links[k]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "cls": F.lit(2)}).repartition(3)
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    count = {x[k][0]: len(v) for k, v in links.items()}
    for r in got:
        assert r["component_id"] == want[r["vec_id"]]
        assert r["n_links"] == count.get(r["vec_id"], 0)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for first, dims, n in ((0, 24, 40), (100, 8, 12), (200, 1, 4), (300, 17, 12), (400, 3, 1)):
        base = rng.standard_normal((n, dims)).tolist()
        rows += [(first + i, v) for i, v in enumerate(base)] + [(first + 50 + i, v) for i, v in enumerate(base[: n // 2])]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    linked = lambda a, b: len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.95
    want = components_of(sorted(x), linked)
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == (sum(j != i and linked(i, j) for j in x), want[i])


def test_passages_of_a_frequent_anchor(monkeypatch):
    """An anchor with more bytes than one sort should hold gives the same windows, a class of first bytes at a time."""
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 70, np.uint8)
    runs = [np.concatenate([line[int(rng.integers(0, 20)): 70 - int(rng.integers(0, 20))], rng.integers(97, 99, int(rng.integers(0, 40)), np.uint8)]) for _ in range(400)]
    runs += [line[:30], line[:49], line[:50]]
    size, doc = np.array([len(r) for r in runs]), rng.integers(0, 60, len(runs))
    text = np.concatenate([np.append(r, np.uint8(0)) for r in runs])
    first = np.cumsum(size + 1) - size - 1
    whole = passages.repeated_windows(text, first, size, doc)
    monkeypatch.setattr(passages, "SORT_BYTES", 1000)
    held = []
    kept = passages.window_classes
    monkeypatch.setattr(passages, "window_classes", lambda *a: (held.append(len(x[2])) or x for x in kept(*a)))
    assert len(whole) and sorted(passages.repeated_windows(text, first, size, doc)) == sorted(whole)
    assert len(held) > 20 and max(held) < sum(held) / 2


def test_passages_cells_follow_the_bytes(spark, docs, monkeypatch):
    one = docs.select("doc_id", "text").coalesce(1)
    assert passages.units(one) == 1
    monkeypatch.setattr(passages, "UNIT", 1000)
    assert passages.units(one) == -(-sum(len(raw(t)) for _, t in TEXTS) // 1000)
    top = (1 << 63) - 1
    want = brute_passages([(top if i is None else i, raw(t)) for i, t in TEXTS])
    got = passages.without_repeats(one, ["doc_id", "text"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        key = (top if r["doc_id"] is None else r["doc_id"], raw(r["text"]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[key]
