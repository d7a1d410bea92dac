"""Similarity join on word shingles: R-trees of count vectors bound the overlap, survivors are verified exactly.

The method. The shingles of a document are hashed into groups; the counts of the groups are a point. Two sets can't
share more shingles than the sum of the smaller counts, group by group, and two boxes of points no more than the sum of
the smaller upper corners. An R-tree of such points is searched against itself: pairs of boxes whose bound is below
the asked similarity are dropped with all that is in them.

How it is dealt out. Two sets with Jaccard similarity >= t share a shingle among the first n - ceil(t * n) + 1 of each,
in any common order. The order puts shingles that are frequent in the corpus last, so the shared ones are rare. Documents
that share such a shingle form a block, each block has its R-tree, and blocks with more than ``BLOCK_ROWS`` documents
are cut into pieces that meet pairwise in tasks of their own. Before that, each document is compared with the first of
its blocks; pairs known to be connected that way need no second look, which turns thousands of near copies into
stars instead of pairs.

Defined results: words are lower-cased in A-Z only; fewer words than a shingle give one shingle of all of them; a text
without words (or null) has the empty set and links with nothing; rows with the same doc_id are one node with the
links of each; a row with a null doc_id gets a null component and no links; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.components import connected_components
from factweave.llm.storage import bitmap, in_bitmap, save, slot, small_batches

SHINGLE = 5
PERCENT = 75
#: Coordinates of a document's point, and of the boxes above it (each the sum of several).
GROUPS, BOX_GROUPS = 256, 32
#: Points or boxes in a box.
FANOUT = 8
#: Shingles that are put last, the most frequent ones: a bound on what is broadcast (1 MB), not on what is compared.
FREQUENT = 1 << 17
BLOCK_ROWS = 8192
#: Fine points have two to four groups a shingle, in two bits each, as long as that is at most so many groups (as a power of
#: two); beyond that one byte for each of a quarter as many. Mid points of sets that are large for GROUPS travel with the rows of
#: blocks, 1 KB at most; the others' fine points are fetched for candidates only.
MID_BITS, FINE_BITS, MID_FROM = 12, 18, 3 * GROUPS
#: Pairs of boxes whose bounds are computed at once.
PAIRS_AT_ONCE = 1 << 16
#: Rows of blocks with the same smallest label that one task searches at least, so that it meets a pair of long texts, which
#: share many blocks, as often as it can and tells it once.
TOGETHER_ROWS = 1 << 13
#: Rows of blocks that are searched at once, and pairs that a task remembers so as not to tell them again.
SEARCHED_ROWS, REMEMBERED = 4_000, 100_000


def _sets(c: W.Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk."""
    s, at = c.windows(k)
    first = np.searchsorted(at, c.first)
    short = W.coefficients(k)
    for r in range(len(c.first) - 1):
        a, b = c.first[r], c.first[r + 1]
        if b - a >= k:
            yield np.unique(s[first[r] : first[r + 1]])
        elif b > a:
            yield W.mix((c.hashes[a:b] * short[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield s[:0]


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def frequent_shingles(docs: DataFrame, k: int = SHINGLE, most: int = FREQUENT) -> DataFrame:
    """(s, n) of the most frequent shingles: those found twice in some chunk of documents, with their summed counts."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            for c in W.chunks(batch, lower=True):
                s, at = c.windows(k)
                s, n = np.unique(s, return_counts=True)
                yield pa.record_batch([s[n > 1].view(np.int64), n[n > 1]], schema=schema)

    found = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return found.where("n >= 4").orderBy(F.desc("n"), "s").limit(most)


def _signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, f1, f2, point, mid, fine, prefix): set size, 128-bit fingerprint, count vectors, and the shingles that lead to its blocks."""
    often = frequent_shingles(docs, k).toArrow()  # FREQUENT rows at most
    shingle, count = often["s"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(shingle)
    shingle, rank = shingle[order], (1 + np.log2(np.maximum(count, 1))).astype(np.uint8)[order]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("point", pa.binary()), ("mid", pa.binary()), ("fine", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def prefix(s: np.ndarray) -> np.ndarray:
        keep = len(s) - (percent * len(s) + 99) // 100 + 1
        if not len(s) or not len(shingle):
            return s[:keep]
        i = np.minimum(np.searchsorted(shingle, s), len(shingle) - 1)
        return s[np.argsort(np.where(shingle[i] == s, rank[i], 0), kind="stable")[:keep]]

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for c in W.chunks(batch, lower=True):
                sets = list(_sets(c, k))
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets]).view(np.int64)
                f2 = np.array([W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets]).view(np.int64)
                heads = [prefix(s) for s in sets]
                offsets = np.append(0, np.cumsum([len(x) for x in heads])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
                yield pa.record_batch([ids.slice(c.rows.start, len(sets)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), f1, f2, _points(sets), *_fine_points(sets), lists], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, point binary, mid binary, fine binary, prefix array<long>")


def _points(sets: list[np.ndarray]) -> pa.Array:
    """Counts of each set's shingles in GROUPS groups, in one byte each where they fit."""
    counts = [np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS) for s in sets]
    return _binary([x.astype(np.uint8 if x.max() < 256 else np.uint32) for x in counts])


def _fine_point(s: np.ndarray, most_bits: int) -> bytes | None:
    """Counts of many groups: how much two-bit counts leave out (four bytes; -1: counts are whole bytes), then the counts."""
    bits = max(2, (2 * len(s)).bit_length())
    if bits <= most_bits:
        x = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        y = np.minimum(x, 3).astype(np.uint8).reshape(-1, 4)
        return np.int32((x - np.minimum(x, 3)).sum()).tobytes() + (y << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    x = np.bincount((s >> np.uint64(66 - most_bits)).astype(np.int64), minlength=1 << most_bits - 2)
    return np.int32(-1).tobytes() + x.astype(np.uint8).tobytes() if x.max() < 256 else None


def _fine_points(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Mid points of large sets, and fine points where the mid one is missing or no finer one fits into its size."""
    mid = [_fine_point(s, MID_BITS) if len(s) >= MID_FROM else None for s in sets]
    fine = [None if x is not None and (2 * len(s)).bit_length() <= MID_BITS else _fine_point(s, FINE_BITS) for s, x in zip(sets, mid, strict=True)]
    return pa.array(mid, pa.binary()), pa.array(fine, pa.binary())


def _counts(point: bytes) -> tuple[np.ndarray, int]:
    """The counts of a fine point and how many shingles they leave out."""
    missing = int(np.frombuffer(point, np.int32, 1)[0])
    x = np.frombuffer(point, np.uint8, offset=4)
    return (x, 0) if missing < 0 else ((x[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel(), missing)


def _mid_bound(mids: list[bytes | None], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of rows i and j by their mid points; a very large number where one has none."""
    out = np.full(len(i), 1 << 40)
    size = np.array([0 if x is None else (len(x) - 4) * (1 if x[:4] == b"\xff\xff\xff\xff" else 4) for x in mids])
    groups = np.minimum(size[i], size[j])  # the finer point is folded to the other
    for g in np.unique(groups[groups > 0]).tolist():
        pairs = np.flatnonzero(groups == g)
        used, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        counts, missing = np.empty((len(used), g), np.uint8), np.empty(len(used), np.int64)
        for k, u in enumerate(used.tolist()):
            x, missing[k] = _counts(mids[u])
            counts[k] = x if len(x) == g else np.minimum(x.reshape(g, -1).sum(1), 255)
            if len(x) > g:
                missing[k] += int(x.sum()) - int(counts[k].sum(dtype=np.int64))
        a, b = at[: len(pairs)], at[len(pairs) :]
        for part in np.array_split(np.arange(len(pairs)), len(pairs) * g // (1 << 21) + 1):
            x, y = a[part], b[part]
            out[pairs[part]] = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) + missing[x] + missing[y]
    return out


def _shingles(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents in wanted(id); a bitmap of fixed size spares most others their hashing."""
    bits = bitmap(wanted, "id")
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits, batch.column(2).to_numpy())))
            for c in W.chunks(batch, lower=True):
                found = _binary(list(_sets(c, k)))
                yield pa.record_batch([batch.column(0).slice(c.rows.start, len(found)).cast(pa.int64()), found], schema=schema)

    ids = docs.select(F.col("doc_id").alias("id"), "text", slot(F.col("doc_id").cast("long")).alias("s")).where("id IS NOT NULL")
    return ids.mapInArrow(sets, "id long, shingles binary").join(wanted, "id", "left_semi")


def _matrix(points: pa.Array) -> np.ndarray:
    values = points.to_pylist()
    narrow = np.array([len(v) == GROUPS for v in values], bool)
    if narrow.all():
        return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), GROUPS).astype(np.uint16)
    return np.stack([np.frombuffer(v, np.uint8 if x else np.uint32) for v, x in zip(values, narrow, strict=True)]).astype(np.uint32)


def _may_match(overlap: np.ndarray, least_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these summed sizes can reach the similarity: 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * least_sizes


def r_tree_pairs(block: np.ndarray, piece: np.ndarray, n: np.ndarray, group: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one block, of different groups, whose bound allows the similarity; one R-tree a block, all searched at once.

    piece: in a block of two pieces only pairs across pieces count (0 and 1); -1 where a block is whole.
    """
    order = np.lexsort((n, group, piece, block))
    block, piece, n, group, points = block[order], piece[order], n[order].astype(np.int64), group[order], points[order]
    coarse = points.reshape(len(points), BOX_GROUPS, -1).sum(2, dtype=np.int64).astype(np.uint32)
    levels = [{"block": block, "least": n, "most": n, "group": group, "piece": piece, "top": coarse}]
    while (levels[-1]["block"][1:] == levels[-1]["block"][:-1]).any():
        x = levels[-1]
        new = np.append(True, x["block"][1:] != x["block"][:-1])
        begin = np.flatnonzero(new)
        place = np.arange(len(new)) - np.repeat(begin, np.diff(np.append(begin, len(new))))
        first = np.flatnonzero(place % FANOUT == 0)
        pure = np.minimum.reduceat(x["group"], first)
        same = lambda c: np.where(np.minimum.reduceat(x[c], first) == np.maximum.reduceat(x[c], first), np.minimum.reduceat(x[c], first), -2)
        levels.append({"block": x["block"][first], "least": np.minimum.reduceat(x["least"], first), "most": np.maximum.reduceat(x["most"], first), "group": np.where(np.maximum.reduceat(x["group"], first) == pure, pure, -1), "piece": same("piece"), "top": np.maximum.reduceat(x["top"], first, axis=0), "first": first, "end": np.append(first[1:], len(new))})
    roots = np.arange(len(levels[-1]["block"]))
    todo, left, right = [(len(levels) - 1, roots, roots)], [], []
    while todo:
        level, i, j = todo.pop()
        if len(i) > PAIRS_AT_ONCE:
            todo += [(level, i[:PAIRS_AT_ONCE], j[:PAIRS_AT_ONCE]), (level, i[PAIRS_AT_ONCE:], j[PAIRS_AT_ONCE:])]
            continue
        x = levels[level]
        keep = (x["group"][i] == -1) | (x["group"][i] != x["group"][j])
        keep &= (x["piece"][i] < 0) | (x["piece"][i] != x["piece"][j])
        keep &= (100 * x["most"][i] >= percent * x["least"][j]) & (100 * x["most"][j] >= percent * x["least"][i])
        if not level:
            keep &= i != j
        i, j = i[keep], j[keep]
        keep = (i == j) | _may_match(np.minimum(x["top"][i], x["top"][j]).sum(1, dtype=np.int64), x["least"][i] + x["least"][j], percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not level:
            keep = _may_match(np.minimum(points[i], points[j]).sum(1, dtype=np.int64), n[i] + n[j], percent)
            left.append(order[i[keep]])
            right.append(order[j[keep]])
            continue
        a, b = x["end"][i] - x["first"][i], x["end"][j] - x["first"][j]
        pair = np.repeat(np.arange(len(i)), a * b)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(a * b) - a * b, a * b)
        ci, cj = x["first"][i][pair] + k // b[pair], x["first"][j][pair] + k % b[pair]
        once = (i[pair] != j[pair]) | (ci <= cj)
        todo.append((level - 1, ci[once], cj[once]))
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _search(percent: int):
    """Blocks of (token, p, q, id, n, label, point), sorted by token, p, q -> candidate pairs (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key = ["token", "p", "q"]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_numpy() for c in ("token", "p", "q", "piece", "id", "n", "label")}
        new = np.append(True, np.any([col[c][1:] != col[c][:-1] for c in key], axis=0))
        i, j = r_tree_pairs(np.cumsum(new), np.where(col["p"] == col["q"], -1, (col["piece"] == col["q"]).astype(np.int64)), col["n"], col["label"], _matrix(t["point"]), percent)
        a, b = np.minimum(col["id"][i], col["id"][j]), np.maximum(col["id"][i], col["id"][j])
        o = np.lexsort((b, a))
        o = o[np.append(True, (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1]))] if len(o) else o
        near = _may_match(_mid_bound(t["mid"].to_pylist(), i[o], j[o]), col["n"][i[o]] + col["n"][j[o]], percent)
        return pa.record_batch([a[o][near], b[o][near]], schema=schema)

    def search(batches):
        held: list[pa.RecordBatch] = []
        told: set[tuple[int, int]] = set()  # a pair of long texts shares many blocks; one row of it is enough

        def found(ready: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pairs(pa.Table.from_batches(ready))
            new = [x for x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) if x not in told]
            if len(told) > REMEMBERED:
                told.clear()
            told.update(new)
            return pa.record_batch([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in key]
            # the last block of a batch may go on in the next one
            cut = batch.num_rows - 1
            while cut and all(x[cut] == x[cut - 1] for x in k):
                cut -= 1
            if not cut and held and any(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() != x[0] for c, x in zip(key, k, strict=True)):
                if sum(x.num_rows for x in held) >= SEARCHED_ROWS:
                    yield found(held)
                    held = []
            if cut:
                held.append(batch.slice(0, cut))
                if sum(x.num_rows for x in held) >= SEARCHED_ROWS:
                    yield found(held)
                    held = []
            held.append(batch.slice(cut))
        if held:
            yield found(held)
    return search


def _near(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and points allow the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(batches):
        for t in batches:
            i = {c: t.column(j) for j, c in enumerate(t.schema.names)}
            shared = np.minimum(_matrix(i["a_point"]), _matrix(i["b_point"])).sum(1, dtype=np.int64) if t.num_rows else np.zeros(0, np.int64)
            places = np.arange(t.num_rows)
            shared = np.minimum(shared, _mid_bound(i["a_fine"].to_pylist() + i["b_fine"].to_pylist(), places, places + t.num_rows))
            ok = pa.array(_may_match(shared, i["a_n"].to_numpy() + i["b_n"].to_numpy(), percent))
            yield pa.record_batch([i["a"].filter(ok), i["b"].filter(ok)], schema=schema)

    side = lambda x: sized.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("point").alias(f"{x}_point"), F.coalesce("fine", "mid").alias(f"{x}_fine"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * a_n >= {percent} * b_n AND 100 * b_n >= {percent} * a_n")
    return both.select("a", "b", "a_n", "b_n", "a_point", "b_point", "a_fine", "b_fine").mapInArrow(near, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = save(_shingles(docs, ids, k), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"{x}_shingles"))

    def check(batches):
        for t in batches:
            i = {c: t.column(j) for j, c in enumerate(t.schema.names)}
            ok = []
            for x, y in zip(i["a_shingles"], i["b_shingles"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([i["a"].filter(ok), i["b"].filter(ok)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return save(both.select("a", "b", "a_shingles", "b_shingles").mapInArrow(check, "a long, b long").distinct(), "verified")


def _searched(rows: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, of different labels, from rows of blocks (token, id, m, label, x); x: the smallest label of the block."""
    parts = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    piece = F.pmod(F.xxhash64("id"), parts).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("piece", o).alias("p"), F.greatest("piece", o).alias("q")))
    # whole blocks are dealt out by their smallest label, in as many lots as its rows fill
    lots = rows.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / TOGETHER_ROWS).cast("int").alias("lots"))
    rows = rows.join(lots, "x").withColumn("lot", F.pmod(F.xxhash64("token"), F.col("lots")).cast("int"))
    rows = rows.join(sets.select(F.col("doc_id").alias("id"), "n", "point", "mid"), "id").withColumn("parts", parts).withColumn("piece", piece)
    rows = rows.select("x", "lot", "token", "id", "label", "n", "point", "mid", "piece", F.inline(meet)).repartition("x", "lot", "p", "q").sortWithinPartitions("token", "p", "q")
    more = rows.select("token", "p", "q", "piece", "id", "n", "label", "point", "mid").mapInArrow(_search(percent), "a long, b long").distinct()
    return _verified(save(_near(save(more, "candidates"), sets, percent), "near"), docs, k, percent)


def similar_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id reachable by links, itself included."""
    small_batches(docs.sparkSession)
    signed = save(_signed(docs, k, percent), "signed")
    sets = signed.where("doc_id IS NOT NULL AND n > 0")
    # written, so that the join after it can be split where a third of all rows are copies of one text
    first = sets.groupBy("f1", "f2").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    first = save(first, "firsts")
    copies = sets.select("f1", "f2", F.col("doc_id").alias("b")).join(first, ["f1", "f2"]).where("a <> b").select("a", "b").distinct()
    copies = save(copies, "copies")
    leads = sets.select("doc_id", F.explode("prefix").alias("token"))
    stats = leads.groupBy("token").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = leads.join(stats, "token").select("token", F.col("doc_id").alias("id"), "a", "m")
    # of equal sets the first is kept, which is the first of its blocks where any of them is; an id with several sets keeps all blocks
    several = sets.groupBy(F.col("doc_id").alias("b")).agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y")
    settled = copies.select("b").join(several, "b", "left_anti")
    blocks = save(blocks.join(settled.select(F.col("b").alias("id")), "id", "left_anti"), "blocks")
    stars = _near(blocks.where("a <> id").select("a", F.col("id").alias("b")).distinct(), sets, percent)
    stars = _verified(save(stars, "stars"), docs, k, percent)
    # documents that stars connect have one label, the smallest of them
    label = connected_components(stars).select(F.col("node").alias("id"), F.col("component").alias("label"))
    rows = blocks.select("token", "id", "m").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # a block with one label is settled; of blocks with the same members one is enough
    member = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(20,0)"))
    open_ = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c"), member(1).alias("s1"), member(2).alias("s2")).where("x <> y")
    open_ = open_.groupBy("c", "s1", "s2").agg(F.min("token").alias("token"), F.min("x").alias("x")).select("token", "x")
    rows = save(rows.join(open_, "token").distinct(), "open")
    linked = _searched(rows, sets, docs, k, percent)
    found = connected_components(stars.union(linked).union(copies))
    out = signed.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def link_counts(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links, of unique doc_ids: (doc_id, n_links) of every row, and (a, b) between the first documents of different sets.

    No pair is spared because its documents are connected already, so a group of near copies costs the square of its different
    sets; exact copies are one set. A null doc_id has no links.
    """
    small_batches(docs.sparkSession)
    signed = save(_signed(docs, k, percent), "signed")
    sets = signed.where("doc_id IS NOT NULL AND n > 0")
    size = save(sets.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("m")), "classes")
    leads = sets.join(size.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.explode("prefix").alias("token"), F.col("doc_id").alias("id"))
    rows = leads.join(leads.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("x")).where("m > 1"), "token")
    pairs = _searched(save(rows.withColumn("label", F.col("id")), "open"), sets, docs, k, percent)
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("id")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("id")))
    other = ends.join(size.select("id", "m"), "id").groupBy("x").agg(F.sum("m").alias("others"))
    degree = size.join(other, size["id"] == other["x"], "left").select("f1", "f2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = sets.select("doc_id", "f1", "f2").join(degree, ["f1", "f2"]).select("doc_id", "n_links")
    rest = signed.where("doc_id IS NULL OR n = 0").select("doc_id", F.lit(0).cast("long").alias("n_links"))
    return out.union(rest), pairs


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, with the smallest doc_id of each group.

    Rows with the same doc_id and text are one. Different texts under one doc_id are documents of their own: each goes only if
    its own text is in a group with a row that stays. Rows with a null doc_id all stay.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(text).alias("_first"), F.max(text).alias("_last")).where("_first <> _last")
    several = save(several.select("_id", "_first"), "repeated_ids")  # none where ids are unique
    apart = F.col("_first").isNotNull() & (text != F.col("_first"))
    # further texts of an id get a number of their own, beyond the ids in use
    node = F.when(apart, F.xxhash64("doc_id", text).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(F.col("doc_id").cast("long"))
    known = docs.where("doc_id IS NOT NULL").join(several, F.col("doc_id") == F.col("_id"), "left").withColumn("_node", node).drop("_id", "_first")
    first = similar_groups(known.select(F.col("_node").alias("doc_id"), "text"), k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    known = known.join(first, F.col("_node") == F.col("_kept"), "left_semi")
    # rows of one document are together after the join: no further shuffle
    known = known.withColumn("_place", F.row_number().over(Over.partitionBy("_node").orderBy("text"))).where("_place = 1")
    return known.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
