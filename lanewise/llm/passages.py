"""Exact removal of repeated passages by suffix arrays.

A byte goes if it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id.

Where strings can repeat at all is found by winnowing: of the GRAM-byte grams of each LENGTH-byte window the one with the least
hash is its anchor, so equal windows have equal anchors. Neighbouring windows with one anchor form a run. Runs with equal
anchor and equal bytes share the fate of the one in the smallest document. Where an anchor has several different runs, their
bytes are fetched and suffix-sorted in two stages: suffixes smaller than their successors are sorted directly (as far as
LENGTH bytes matter), the others are induced by scanning the buckets of first bytes; adjacent common prefixes of LENGTH or
more tell equal windows. An anchor whose runs have more than SORT_BYTES is sorted directly, one class of first bytes after the
other, so what its sort holds does not grow with the number of its runs.

Work is exchanged in packed rows: by cell (hash of the anchor) and by block (hash of the document). Equal runs within the
documents a task holds together are settled there, so a passage that a third of all documents share meets once per such
group and not once per document.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import BASE, BASE_INVERSE, binary_buffers, durable, input_splits, mix64, pieces, powers, query, seeds, table

LENGTH = 50
GRAM = 16
FLUSH = 16 << 20              # bytes of text that are settled together
UNIT = 24 << 20               # bytes of text whose runs fill CELLS cells, at most, however large the input splits
CELLS = 2                     # cells of runs for each unit: a cell holds about ten times its share of the text in memory
BLOCKS = 4                    # blocks of documents for each unit
SORT_CELLS = 8                # suffix sorts for each unit: a sort holds about forty times its bytes in memory
SORT_BYTES = 4 << 20          # bytes of a cell that are sorted at once; an anchor of more is sorted in classes of first bytes
CTX_BYTES = 6
CODES = seeds(256, 3)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, digest of the bytes, first and end byte of every run of windows with one anchor; windows stay within a row."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[raw] * powers(BASE, n), out=total[1:])
    inverse = powers(BASE_INVERSE, n)
    gram = mix64((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low = (gram & HIGH) | (LOW - np.arange(len(gram), dtype=np.uint64))       # least hash, rightmost among equals
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    if width > step:
        low = np.minimum(low[: step - width], low[width - step:])
    anchor = (LOW - (low & LOW)).astype(np.int64)
    whole = np.ones(len(anchor) + LENGTH, np.int32)                            # windows that cross a row's end do not count
    cuts = offs[1:-1]
    edge = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(edge, np.maximum(cuts - LENGTH + 1, 0).clip(max=len(anchor)), 1)
    np.add.at(edge, cuts.clip(max=len(anchor)), -1)
    whole = np.cumsum(edge[:-1]) == 0
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    mine = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, a = at[first], at[np.append(first[1:], len(at)) - 1] + LENGTH, mine[first]
    digest = mix64(((total[hi] - total[lo]) * inverse[lo]) ^ ((a - lo) * 1024 + (hi - lo)).astype(np.uint64))
    return gram[a], digest, lo, hi


def flushes(batches):
    """(uids, ids, anchor, digest, row, first byte in the row, length) of the runs of about FLUSH bytes of text at a time."""
    uids, ids, found, held = [], [], [], 0

    def out():
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in ("u8", "u8", "i8", "i8", "i8")]
        return np.concatenate(uids), np.concatenate(ids), *parts

    for b in batches:
        raw, offs = binary_buffers(b.column(2))
        uid, doc, done = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), 0
        for i, j, part, o in pieces(raw, offs, 1 << 21):
            key, digest, lo, hi = runs(part, o)
            row = np.searchsorted(o, lo, "right") - 1
            base = sum(map(len, uids))
            found.append((key, digest, base + row, lo - o[row], hi - lo))
            uids.append(uid[i:j])
            ids.append(doc[i:j])
            held += len(part)
            if held >= FLUSH:
                yield out()
                uids, ids, found, held = [], [], [], 0
    if uids:
        yield out()


def first_of_equal(key, digest, doc):
    """For runs sorted by (anchor, digest, doc): order, group starts, and of each run the smallest doc with its bytes."""
    order = np.lexsort((doc, digest, key))
    k, d = key[order], digest[order]
    start = np.ones(len(order), bool)
    start[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(start) - 1
    least = doc[order][np.flatnonzero(start)][group] if len(order) else doc
    return order, start, least


def pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind)).tobytes()


SPANS = "block int, kind int, uid binary, doc binary, lo binary, size binary, key binary"
COLUMNS = ["block", "kind", "uid", "doc", "lo", "size", "key"]


def by_block(blocks: int, kind: int, uid, doc, lo, size, key=None) -> pd.DataFrame:
    """Packed rows, one for each block that has any."""
    block = (uid % blocks).astype(np.int64)
    order = np.lexsort((lo, uid, block))
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    rows = []
    for at in np.split(order, cuts) if len(order) else []:
        rows.append((int(block[at[0]]), kind, pack(uid[at], "<i8"), pack(doc[at], "<i8") if kind else b"", pack(lo[at], "<u4"), pack(size[at], "<u4" if kind == 0 else "u1"),
                     pack(key[at], "<u8") if kind else b""))
    return pd.DataFrame(rows, columns=COLUMNS)


def joined(uid, lo, size):
    """Spans of one document that touch or overlap become one."""
    if not len(uid):
        return uid, lo, size
    order = np.lexsort((lo, uid))
    uid, lo, end = uid[order], lo[order], (lo + size)[order]
    # ends grow within a document: offset by document keeps the running maximum apart
    doc = np.cumsum(np.r_[True, uid[1:] != uid[:-1]]).astype(np.int64) << 33
    reach = np.maximum.accumulate(end + doc)
    new = np.r_[True, (lo + doc)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    stop = reach[np.append(at[1:], len(uid)) - 1] - doc[at]
    return uid[at], lo[at], stop - lo[at]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes as far as LENGTH bytes; the end sorts before every byte."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    word = np.zeros(n + 56, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k: k + n + 56]
    follow = padded[1: n + 1].astype(np.int16)
    step = np.sign(follow - text)                                   # 1: smaller than its successor, 0: as its successor
    step[-1] = -1
    decided = np.flatnonzero(step)
    rising = step[decided[np.searchsorted(decided, np.arange(n))]] > 0
    # stage one: direct sort, eight bytes at a time, of what is still equal
    pos = np.flatnonzero(rising)
    pos = pos[np.argsort(word[pos])]
    key = word[pos]
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(1, -(-LENGTH // 8)):
        group = np.cumsum(new) - 1
        many = np.flatnonzero(np.bincount(group)[group] > 1) if len(pos) else np.zeros(0, np.int64)
        if not len(many):
            break
        sub = pos[many]
        key = word[sub + 8 * k]
        order = np.lexsort((key, group[many]))
        pos[many], key = sub[order], key[order]
        new[many[1:]] |= key[1:] != key[:-1]
    # stage two: scan the buckets of first bytes; a suffix hands its predecessor, if larger, to the bucket of that one's byte
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    direct = np.searchsorted(text[pos], np.arange(257))
    out = []

    def hand_on(suffixes, c):
        before = suffixes[suffixes > 0] - 1
        before = before[~rising[before]]
        first = text[before]
        for d in np.unique(first):
            waiting[d].append(before[first == d]) if d != c else None
        return before[first == c]

    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(level):
            out.append(level)
            level = hand_on(level, c)
        own = pos[direct[c]: direct[c + 1]]
        if len(own):
            out.append(own)
            hand_on(own, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the one before it in ``order``, as far as LENGTH; 0 for the first."""
    padded = np.concatenate([text, np.zeros(LENGTH + 1, np.uint8)])
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(LENGTH):
        live = live[padded[order[live] + k] == padded[order[live - 1] + k]]
        out[live] += 1
    return out


def window_classes(text: np.ndarray, first: np.ndarray, size: np.ndarray, classes: int):
    """The windows of all runs (positions and their runs), in so many classes by their first eight bytes: equal ones share a class."""
    width = (size - LENGTH + 1).clip(min=0)
    kind = np.empty(int(width.sum()), np.uint16)
    ends = np.cumsum(width)
    padded = np.concatenate([text, np.zeros(72, np.uint8)])

    def at(w):
        """Run and position of the windows numbered ``w``."""
        run = np.searchsorted(ends, w, "right")
        return run, first[run] + w - (ends[run] - width[run])

    for k in range(0, len(kind), 1 << 20):
        w = np.arange(k, min(k + (1 << 20), len(kind)))
        kind[w] = mix64(words_at(padded, at(w)[1])) % np.uint64(classes)
    for c in range(classes):
        run, pos = at(np.flatnonzero(kind == c))
        yield padded, run, pos


def words_at(padded: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number in their order."""
    word = np.zeros(len(pos), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[pos + k]
    return word


def repeated_in_classes(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """As ``repeated_windows``, for more bytes than one sort should hold: a class at a time, eight bytes at a time of what is still equal."""
    found = []
    for padded, run, pos in window_classes(text, first, size, min(1 << 16, -(-len(text) // SORT_BYTES))):
        group = np.zeros(len(pos), np.int64)
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            word = words_at(padded, pos + k)
            order = np.lexsort((word, group))
            run, pos, group, word = run[order], pos[order], group[order], word[order]
            new = np.zeros(len(pos), np.int64)
            new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1 if len(pos) else np.zeros(0, bool)      # a window like no other is settled
            run, pos, group = run[many], pos[many], group[many]
        if len(pos):
            group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
            least = np.minimum.reduceat(doc[run], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
            found.append(pos[doc[run] > least])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def repeated_windows(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of runs that lie at ``first`` in ``text``, the windows (positions) whose string is also in a run of a smaller doc."""
    if len(text) > SORT_BYTES:
        return repeated_in_classes(text, first, size, doc)
    order = suffix_order(text)
    run = np.searchsorted(first, order, "right") - 1
    full = (run >= 0) & (order + LENGTH <= first[run] + size[run])
    order, run = order[full], run[full]
    if not len(order):
        return order
    start = common_prefixes(text, order) < LENGTH
    start[0] = True
    least = np.minimum.reduceat(doc[run], np.flatnonzero(start))[np.cumsum(start) - 1]
    return order[doc[run] > least]


def settle_locally(blocks: int):
    """Spans of runs that a smaller document of the same flush has too."""
    def run(batches):
        for uid, ids, key, digest, row, lo, size in flushes(batches):
            order, _, least = first_of_equal(key, digest, ids[row])
            gone = order[ids[row][order] > least]
            u, a, n = joined(uid[row[gone]], lo[gone], size[gone])
            yield pa.RecordBatch.from_pandas(by_block(blocks, 0, u, u, a, n), schema=SCHEMA, preserve_index=False)
    return run


SCHEMA = pa.schema([("block", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in COLUMNS[2:]]])


def to_cells(cells: int):
    """Distinct runs of a flush, packed by cell."""
    def run(batches):
        for uid, ids, key, digest, row, lo, size in flushes(batches):
            order, _, least = first_of_equal(key, digest, ids[row])
            own = order[ids[row][order] == least]
            cell = (key[own] >> np.uint64(8)) % np.uint64(cells)
            place = np.argsort(cell, kind="stable")
            own, cell = own[place], cell[place]
            for at in np.split(own, np.flatnonzero(np.diff(cell)) + 1) if len(own) else []:
                used, local = np.unique(row[at], return_inverse=True)
                low = digest[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CTX_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                    (int((key[at[0]] >> np.uint64(8)) % np.uint64(cells)), pa.int32()), (pack(uid[used], "<i8"), pa.binary()), (pack(ids[used], "<i8"), pa.binary()),
                    (pack(key[at] & LOW, "<u4"), pa.binary()), (np.ascontiguousarray(low).tobytes(), pa.binary()), (pack(local, "<u4"), pa.binary()),
                    (pack(lo[at], "<u4"), pa.binary()), (pack(size[at], "u1"), pa.binary()))], names=["cell", "uids", "ids", "key", "digest", "row", "lo", "size"])
    return run


CELL = "cell int, uids binary, ids binary, key binary, digest binary, row binary, lo binary, size binary"


def settle_cell(blocks: int):
    """All runs of the anchors of a cell: spans (kind 0) of those a smaller document has alike, and the rest of the anchors with
    several different runs in several documents (kind 1), one run for each."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        uid, doc, key, digest, lo, size = [], [], [], [], [], []
        for r in f.itertuples(index=False):
            row = np.frombuffer(r.row, "<u4")
            uid.append(np.frombuffer(r.uids, "<i8")[row])
            doc.append(np.frombuffer(r.ids, "<i8")[row])
            key.append(np.frombuffer(r.key, "<u4"))
            d = np.zeros((len(row), 8), np.uint8)
            d[:, :CTX_BYTES] = np.frombuffer(r.digest, np.uint8).reshape(-1, CTX_BYTES)
            digest.append(d.view("<u8").ravel())
            lo.append(np.frombuffer(r.lo, "<u4").astype(np.int64))
            size.append(np.frombuffer(r.size, "u1").astype(np.int64))
        uid, doc, key, digest, lo, size = map(np.concatenate, (uid, doc, key, digest, lo, size))
        order, start, least = first_of_equal(key, digest, doc)
        uid, doc, key, lo, size = uid[order], doc[order], key[order], lo[order], size[order]
        gone = doc > least
        u, a, n = joined(uid[gone], lo[gone], size[gone])
        spans = by_block(blocks, 0, u, u, a, n)
        anchor = np.r_[True, key[1:] != key[:-1]]
        group, heads = np.cumsum(anchor) - 1, np.flatnonzero(anchor)
        several = (np.add.reduceat(start.astype(np.int64), heads) > 1) & (np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads))
        # of equal runs in one document or in repeated rows of it, one is enough to compare, but all are to be settled
        open_ = several[group] & ~gone
        full_key = key[open_].astype(np.uint64) | (np.uint64(int(f["cell"].iloc[0])) << np.uint64(32))
        rest = by_block(blocks, 1, uid[open_], doc[open_], lo[open_], size[open_], full_key)
        return pd.concat([spans, rest], ignore_index=True)
    return run


def unpack(f: pd.DataFrame, kind: int):
    f = f[f["kind"] == kind]
    join = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in f[c]]) if len(f) else np.zeros(0, t)
    return join("uid", "<i8"), join("doc", "<i8"), join("lo", "<u4").astype(np.int64), join("size", "u1" if kind else "<u4").astype(np.int64), join("key", "<u8")


def fetch(cells: int):
    """The bytes of open runs, packed by cells of the sort."""
    def run(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "uid", "doc", "lo", "size", "bytes"]
        uid, doc, lo, size, key = unpack(asked, 1)
        if not len(uid) or not len(texts):
            return pd.DataFrame(columns=names)
        text = dict(zip(texts["uid"], texts["text"]))
        cell = (mix64(key) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            parts = [text[u][a: a + n] for u, a, n in zip(uid[at].tolist(), lo[at].tolist(), size[at].tolist())]
            rows.append((int(cell[at[0]]), pack(uid[at], "<i8"), pack(doc[at], "<i8"), pack(lo[at], "<u4"), pack(size[at], "u1"), b"".join(parts)))
        return pd.DataFrame(rows, columns=names)
    return run


FETCHED = "cell int, uid binary, doc binary, lo binary, size binary, bytes binary"


def sort_cell(blocks: int):
    """Suffix-sort the runs of a cell; spans of windows that a smaller document has."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        uid, doc = (np.concatenate([np.frombuffer(b, "<i8") for b in f[c]]) for c in ("uid", "doc"))
        lo = np.concatenate([np.frombuffer(b, "<u4") for b in f["lo"]]).astype(np.int64)
        size = np.concatenate([np.frombuffer(b, "u1") for b in f["size"]]).astype(np.int64)
        raw = np.frombuffer(b"".join(f["bytes"]), np.uint8)
        first = np.cumsum(size + 1) - size - 1                        # one zero byte between runs
        text, body = np.zeros(int((size + 1).sum()), np.uint8), np.ones(int((size + 1).sum()), bool)
        body[first + size] = False
        text[body] = raw
        found = repeated_windows(text, first, size, doc)
        run_ = np.searchsorted(first, found, "right") - 1
        u, a, n = joined(uid[run_], lo[run_] + found - first[run_], np.full(len(found), LENGTH))
        return by_block(blocks, 0, u, u, a, n)
    return run


def whole_characters(t: bytes, a: int, b: int) -> tuple[int, int]:
    """The span a to b of UTF-8 bytes, with all of a character that it holds a part of."""
    following = lambda i: 0 < i < len(t) and t[i] & 0xC0 == 0x80
    least, most = a - 3, b + 3                          # no character has more than four bytes
    while a > least and following(a):
        a -= 1
    while b < most and following(b):
        b += 1
    return a, b


def cut(extra: list[str], whole: bool = False):
    """Remaining bytes of every text, given all spans of its block; with ``whole``, of characters none of which is cut."""
    def run(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        uid, _, lo, size, _ = unpack(spans, 0)
        uid, lo, size = joined(uid, lo, size)
        begin = dict(zip(*[x.tolist() for x in np.unique(uid, return_index=True)]))
        edges, rows = np.append(np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else [], len(uid)).astype(np.int64), []
        stop = dict(zip(edges[:-1].tolist(), edges[1:].tolist()))
        for u, t in zip(texts["uid"], texts["text"]):
            if u not in begin:
                rows.append((len(t), 0, 0, t))
                continue
            a = begin[u]
            b, at, kept = stop[a], 0, []
            for k in range(a, b):
                first, end = int(lo[k]), int(lo[k] + size[k])
                if whole:
                    first, end = whole_characters(t, first, end)
                kept.append(t[at: max(first, at)])
                at = end
            kept.append(t[at:])
            rest = b"".join(kept)
            rows.append((len(t), len(t) - len(rest), b - a, rest))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        for c in extra:
            out[c] = texts[c].to_numpy()
        return out
    return run


def units(docs: DataFrame) -> int:
    """How many times UNIT the texts have, and as many as the input splits at least."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(input_splits(docs), -(-total // UNIT))


def without_repeats(docs: DataFrame, carry: list[str] = ("doc_id",), whole: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept (binary) and the ``carry`` columns of every row of ``docs`` (doc_id, text).

    Null texts are empty and null doc_ids come after all others. Rows of one doc_id take nothing from each other; repeated rows
    have the same result each. With ``whole``, a character that is cut in two goes as a whole. Texts below LENGTH bytes are left as they are. An empty table gives an empty result.
    """
    carry = list(carry)
    parts = units(docs)
    cells, blocks = CELLS * parts, BLOCKS * parts
    # repeated rows have one uid: what is removed depends on doc_id and text alone
    names = {f"c{i}": c for i, c in enumerate(carry)}
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       *[F.col(f"`{c}`").alias(n) for n, c in names.items()]).withColumn("uid", F.xxhash64("id", "text"))
    scan = rows.select("uid", "id", "text")
    local = scan.mapInArrow(settle_locally(blocks), SPANS)
    settled = scan.mapInArrow(to_cells(cells), CELL).groupBy("cell").applyInPandas(settle_cell(blocks), SPANS)
    known = durable(settled.unionByName(local), "spans")

    texts = rows.select(F.pmod("uid", F.lit(blocks)).cast("int").alias("block"), "uid", "text", *names)
    fetched = texts.groupBy("block").cogroup(known.where("kind = 1").groupBy("block")).applyInPandas(fetch(SORT_CELLS * parts), FETCHED)
    sorted_ = fetched.groupBy("cell").applyInPandas(sort_cell(blocks), SPANS)
    spans = known.where("kind = 0").unionByName(sorted_)
    kinds = dict(rows.select(*names).dtypes)
    ddl = "n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", {n} {k}" for n, k in kinds.items())
    out = texts.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(cut(list(names), whole), ddl)
    return out.select("n_bytes", "n_removed", "n_spans", "kept", *[F.col(n).alias(c) for n, c in names.items()])


def cut_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out of ``text``, columns and order of columns unchanged; a character
    that is cut in two goes as a whole, texts without repeats stay byte for byte, and ``n_chars``, where there is one, counts anew. No row goes."""
    out = without_repeats(docs, [c for c in docs.columns if c != "text"], whole=True)
    out = out.withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op7_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
