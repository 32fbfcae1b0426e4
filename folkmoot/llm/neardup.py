"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A text's fingerprint has 128 bits, the signs of the summed hash bits of its
distinct words. Cut into 64 segments of two bits, a fingerprint maps to its
segments' bit counts, a point whose Manhattan distance from another never
exceeds the Hamming distance of the fingerprints. Counts are kept as sorted bits
(00, 01, 11), so that the Manhattan distance is itself a count of differing bits.

Points are joined on grids, in two steps. An outer grid takes a few of the 64
coordinates, with edges of one; its cells are brought together by a shuffle, and
they are few and large, so that a point is sent a small number of times. Within
a cell, inner grids over the other coordinates split the points further, in
memory, until a point expects a bounded number of unrelated points in its part;
small cells are compared pair by pair. Candidates within the Manhattan bound are
verified by exact Hamming distance.

Recall is the same at every number of points: there are so many outer and inner
grids that a pair at the full ``distance`` is compared with probability
``FAR_RECALL`` and one at ``design`` bits with probability ``recall``, counted
exactly for bits that fall anywhere; closer pairs are likelier. More points only
take more grids. No cell, partner or group is capped.

Equal fingerprints are one point, so thousands of exact copies cost no pairs.
Parts in which many are near each other are searched from point to point: what
is reached is joined by one link and isn't compared again. A cell gives each of
its points one link at most, to the least of its group, so that near copies by
the thousand give a link each, not a million pairs.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake, row_key, settle

WORD = re.compile(r"\w+")
BITS, SEGMENTS = 128, 64
DISTANCE = 24
DESIGN, RECALL = 17, 0.95
FAR_RECALL = 0.9
OUTER_RECALL = 0.97
UNRELATED = 0.45
CELL, CROWD, DENSE = 1 << 20, 8, 1024
ODD = 0x5555555555555555
GRIDS = 1 << 16


def fingerprints(texts: list[str]) -> np.ndarray:
    """Row by row two signed 64-bit halves. Texts without a word get a hash of the text itself."""
    import xxhash

    known: dict[str, int] = {}
    flat: list[int] = []
    starts = np.zeros(len(texts), dtype=np.int64)
    for n, text in enumerate(texts):
        starts[n] = len(flat)
        words = set(WORD.findall(text.lower())) or {"\0" + text}
        flat += [known.setdefault(w, len(known)) for w in words]
    digests = b"".join([xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in known])
    signs = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16), axis=1).astype(np.int8) * 2 - 1
    if not len(texts):
        return np.empty((0, 2), dtype=np.int64)
    sums = np.add.reduceat(signs[np.array(flat)], starts, axis=0, dtype=np.int32)
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)


def fingerprint_rows(rows: DataFrame, slice_rows: int = 256) -> DataFrame:
    """Columns but the last, ``text``, with f1 and f2."""
    keep = rows.columns[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), slice_rows):
                pdf = whole.iloc[at : at + slice_rows]
                f = fingerprints(pdf["text"].tolist())
                out = pdf[keep].copy()
                out["f1"], out["f2"] = f[:, 0], f[:, 1]
                yield out

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInPandas(run, schema + ", f1 long, f2 long")


def embedded(f: Column) -> Column:
    """A half's segment counts, each as its two bits sorted."""
    high = F.shiftrightunsigned(f, 1)
    return f.bitwiseOR(high).bitwiseAND(F.lit(ODD)).bitwiseOR(F.shiftleft(f.bitwiseAND(high).bitwiseAND(F.lit(ODD)), 1))


@lru_cache(maxsize=256)
def _agreeing(k: int, bits: int) -> list[tuple[float, int, float]]:
    """(probability, coordinates that agree, probability that a grid of k has both in one cell) of pairs that differ in so many bits.

    Of the bits, which fall anywhere, two in a segment leave its count as it was
    half of the time.
    """
    agree = [0.0] * (SEGMENTS + 1)
    for two in range(max(0, bits - SEGMENTS), bits // 2 + 1):
        ways = math.comb(SEGMENTS, two) * math.comb(SEGMENTS - two, bits - 2 * two) * 2 ** (bits - 2 * two) / math.comb(BITS, bits)
        for same in range(two + 1):
            agree[SEGMENTS - bits + two + same] += ways * math.comb(two, same) / 2**two
    return [(p, m, math.comb(m, k) / math.comb(SEGMENTS, k)) for m, p in enumerate(agree) if p]


def shared(k: int, bits: int) -> list[tuple[float, float]]:
    """(probability, probability that a grid of k coordinates has both in one cell) of pairs that differ in so many bits."""
    return [(p, q) for p, _, q in _agreeing(k, bits)]


def _fewest(missed: Callable[[int], float], most: float) -> int:
    """The least number from 1 on at which so few are missed."""
    low, high = 0, 1
    while missed(high) > most:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > most else (low, mid)
    return high


def _coordinates(points: float, crowd: int) -> int:
    """So many that a point expects ``crowd`` unrelated points to agree with it in all."""
    unrelated = (1 - UNRELATED) ** 2 + UNRELATED**2 / 2
    return math.ceil(math.log(max(points / crowd, 1)) / -math.log(unrelated))


def shape(points: int, distance: int = DISTANCE, cell: int = CELL) -> tuple[int, int]:
    """(coordinates of an outer grid, number of outer grids) for so many points: cells of about ``cell`` points, 81 kinds of cells at least."""
    k = min(max(4, _coordinates(points, cell)), SEGMENTS // 2)
    pairs = shared(k, distance)
    return k, _fewest(lambda n: sum(p * (1 - q) ** n for p, q in pairs), 1 - OUTER_RECALL)


@lru_cache(maxsize=4096)
def inner_grids(k: int, n: int, inner: int, distance: int, design: int, recall: float) -> int:
    """Fewest inner grids of so many coordinates in each cell of ``n`` outer grids of ``k``, for the recall of both steps together.

    Cells of other sizes have other inner grids; as each kind alone would do, so
    does any mixture (Hoelder's inequality).
    """

    def missed(bits: int, many: int) -> float:
        total = 0.0
        for p, agree, q in _agreeing(k, bits):
            r = math.comb(agree - k, inner) / math.comb(SEGMENTS - k, inner) if agree >= k else 0.0
            total += p * (1 - q * (1 - (1 - r) ** many)) ** n
        return total

    return max(_fewest(lambda m: missed(distance, m), 1 - FAR_RECALL), _fewest(lambda m: missed(min(design, distance), m), 1 - recall))


def _masks(coordinates: list[int], k: int, n: int, rng: random.Random) -> list[tuple[int, int]]:
    """Two masks for each grid, over the halves; grids cut from one shuffle share no coordinate."""
    out: list[tuple[int, int]] = []
    while len(out) < n:
        order = rng.sample(coordinates, len(coordinates))
        for i in range(0, len(order) - k + 1, k):
            halves = [0, 0]
            for s in order[i : i + k]:
                halves[s // 32] |= 3 << (2 * (s % 32))
            out.append((halves[0], halves[1]))
    return out[:n]


def grids(k: int, n: int, seed: int = 3) -> list[tuple[int, int]]:
    """Masks of the outer grids, as signed halves."""
    return [tuple(h - (1 << 64) if h >> 63 else h for h in m) for m in _masks(list(range(SEGMENTS)), k, n, random.Random(seed))]


@lru_cache(maxsize=256)
def inner_masks(outer: tuple[int, int], inner: int, n: int) -> np.ndarray:
    """Masks of the inner grids of an outer grid's cells, over the coordinates that it leaves."""
    free = [s for s in range(SEGMENTS) if not (outer[s // 32] >> (2 * (s % 32))) & 1]
    return np.array(_masks(free, inner, n, random.Random(f"{outer} {inner}")), dtype=np.uint64)


def cells(points: DataFrame, masks: list[tuple[int, int]], first: int = 0) -> DataFrame:
    """A row for each point and grid, with the hash of its cell, which ends in the grid's number."""
    each = F.array(*[F.struct(F.lit(first + i).alias("g"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(masks)])
    rows = points.withColumn("m", F.explode(each))
    cell = F.xxhash64("m.g", embedded(F.col("f1")).bitwiseAND(F.col("m.a")), embedded(F.col("f2")).bitwiseAND(F.col("m.b")))
    # The low bits name the grid.
    return rows.select(cell.bitwiseAND(F.lit(-GRIDS)).bitwiseOR(F.col("m.g").cast("long")).alias("cell"), *points.columns)


def _sorted_bits(f: np.ndarray) -> np.ndarray:
    """``embedded``, for unsigned halves in numpy."""
    odd, one = np.uint64(ODD), np.uint64(1)
    high = f >> one
    return ((f | high) & odd) | ((f & high & odd) << one)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of two lists of (n, 2) halves."""
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])


def cell_links(f: np.ndarray, distance: int, block: int = 256) -> list[tuple[int, int]]:
    """Links (i, j) that join the points of one cell just as all near pairs would: a search from every point not reached yet.

    A frontier is compared with the points not reached, by the Manhattan bound
    first and exactly where that passes. Points once reached aren't compared
    again, so a cell of near copies takes few passes.
    """
    e = _sorted_bits(f)
    if len(f) <= 2 * block:
        # Few points: all pairs at once, given out as they are unless they are many.
        x, y = np.nonzero(np.triu(_apart(e, e) <= distance, 1))
        exact = np.bitwise_count(f[x] ^ f[y]).sum(1) <= distance
        if exact.sum() <= 4 * len(f):
            return list(zip(x[exact].tolist(), y[exact].tolist()))
    left = np.arange(len(f))
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:block], frontier[block:]
            ok = _apart(e[some], e[left]) <= distance
            if ok.any():
                x, y = np.nonzero(ok)
                exact = (np.bitwise_count(f[some[x]] ^ f[left[y]]).sum(1) <= distance).nonzero()[0]
                reached, first = np.unique(y[exact], return_index=True)
                links += zip(some[x[exact[first]]].tolist(), left[reached].tolist())
                frontier = np.concatenate([frontier, left[reached]])
                left = np.delete(left, reached)
    return links


def near_pairs(f: np.ndarray, e: np.ndarray, distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of near points, compared one with all."""
    us, vs = [], []
    for a in range(0, len(f), block):
        x, y = np.nonzero(_apart(e[a : a + block], e[a:]) <= distance)
        x, y = x[x < y] + a, y[x < y] + a
        exact = np.bitwise_count(f[x] ^ f[y]).sum(1) <= distance
        us.append(x[exact])
        vs.append(y[exact])
    return np.concatenate(us), np.concatenate(vs)


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after links: the least label that is reached. Labels are numbers of points and label themselves."""
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, to := label[label]):
            label = to
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def cell_groups(f: np.ndarray, outer: tuple[int, int], k: int, n: int, distance: int, design: int, recall: float) -> np.ndarray:
    """For each point of an outer grid's cell the least point of its group there."""
    e, label = _sorted_bits(f), np.arange(len(f))
    if len(f) <= DENSE:
        return joined(label, *near_pairs(f, e, distance))
    inner = min(max(1, _coordinates(len(f), CROWD)), SEGMENTS - k)
    odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    for mask in inner_masks(outer, inner, inner_grids(k, n, inner, distance, design, recall)):
        part = (e[:, 0] & mask[0]) * odd[0] + (e[:, 1] & mask[1]) * odd[1]
        order = np.argsort(part)
        part = part[order]
        alike = part[1:] == part[:-1]
        some = np.flatnonzero(np.concatenate([alike, [False]]) | np.concatenate([[False], alike]))
        order = order[some]
        u, v = near_in_cells(part[some], f[order], distance)
        label = joined(label, order[u], order[v])
    return label


def near_in_cells(cell: np.ndarray, f: np.ndarray, distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of rows sorted by cell, as ``cell_links`` has them for each cell; all small cells are compared at once."""
    if not len(cell):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([first, [len(cell)]]))
    few = size <= 2 * block
    at = np.repeat(np.arange(len(first)), size)
    after = first[at] + size[at] - 1 - np.arange(len(cell))
    e = _sorted_bits(f)
    live = np.flatnonzero(few[at] & (after > 0))
    us, vs, step = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], 1
    while len(live):
        # Every row with the one so many rows on in its cell.
        other = live + step
        ok = np.bitwise_count(e[live] ^ e[other]).sum(1) <= distance
        u, v = live[ok], other[ok]
        exact = np.bitwise_count(f[u] ^ f[v]).sum(1) <= distance
        us.append(u[exact])
        vs.append(v[exact])
        step += 1
        live = live[after[live] >= step]
    u, v = np.concatenate(us), np.concatenate(vs)
    search = ~few | (np.bincount(at[u], minlength=len(first)) > 4 * size)
    plain = ~search[at[u]]
    us, vs = [u[plain]], [v[plain]]
    for c in np.flatnonzero(search).tolist():
        got = np.array(cell_links(f[first[c] : first[c] + size[c]], distance, block), dtype=np.int64).reshape(-1, 2) + first[c]
        us.append(got[:, 0])
        vs.append(got[:, 1])
    return np.concatenate(us), np.concatenate(vs)


def links(points: DataFrame, k: int, n: int, distance: int = DISTANCE, design: int = DESIGN, recall: float = RECALL) -> DataFrame:
    """(u, v): ids that join near points of every cell. Cells are brought together by one shuffle of plain rows and searched in Arrow batches."""
    if n >= GRIDS:
        raise ValueError(f"{n} grids")
    outer = [tuple(h % (1 << 64) for h in m) for m in grids(k, n)]
    rows = cells(points.select("id", "f1", "f2"), grids(k, n)).repartition("cell").sortWithinPartitions("cell")

    def near(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cell, ids, f = (np.concatenate(x) for x in zip(*parts))
        us, vs = [], []
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
            if b - a > 1:
                label = cell_groups(f[a:b], outer[int(cell[a]) & (GRIDS - 1)], k, n, distance, design, recall)
                at = np.flatnonzero(label != np.arange(b - a))
                us.append(ids[a + label[at]])
                vs.append(ids[a + at])
        u, v = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids, f1, f2 = (batch.column(n).to_numpy() for n in range(4))
            f = np.stack([f1, f2], axis=1).view(np.uint64)
            # The last cell may go on in the next batch.
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut or (held and held[-1][0][-1] != cell[-1]):
                yield near([*held, (cell[:cut], ids[:cut], f[:cut])])
                held = []
            held.append((cell[cut:].copy(), ids[cut:].copy(), f[cut:]))
        if held:
            yield near(held)

    return rows.mapInArrow(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of an edge. Nodes are numbers.

    Labels spread along edges and then jump to their own labels' labels, so the
    rounds grow with the logarithm of a group's diameter. Each round is
    checkpointed in the shared folder.
    """
    both = settle(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v").groupBy(F.col("u").alias("node")).agg(F.min("lv").alias("heard"))
        spread = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        now = settle(spread.join(jump, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved")))
        labels = now.select("node", "label")
        if now.where("moved").isEmpty():
            return labels


def group_points(points: DataFrame, distance: int = DISTANCE, design: int = DESIGN, recall: float = RECALL) -> DataFrame:
    """(f1, f2, label): distinct fingerprints with the least number of their group."""
    # Numbers are fixed by the checkpoint, so a lost executor can't renumber.
    points = settle(points.select("f1", "f2").distinct().withColumn("id", F.monotonically_increasing_id()))
    labels = components(links(points, *shape(points.count(), distance), distance, design, recall))
    got = points.join(labels.select(F.col("node").alias("id"), F.col("label").alias("new")), "id", "left")
    return got.select("f1", "f2", F.coalesce("new", "id").alias("label"))


def _decided(df: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[Intake, DataFrame]:
    """(doc, k1, k2) of rows with their id and size and whether they stay."""
    took = Intake(df, id_col, text_col)
    text = took[text_col].cast("string")
    rows = took.rows.where(text.isNotNull()).select(took[id_col].alias("doc"), *row_key(took[id_col], took[text_col]), text.alias("text"))
    printed = settle(fingerprint_rows(rows))
    grouped = settle(printed.join(group_points(printed, distance), ["f1", "f2"]).select("doc", "k1", "k2", "label"))
    least = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("null"), "doc", "k1", "k2")).alias("stays"), F.count(F.lit(1)).alias("size"))
    got = grouped.join(least, "label")
    same = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2"))
    return took, got.select("doc", "k1", "k2", F.col("stays.doc").alias("group"), "size", same.alias("keep"))


def near_duplicates(df: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, size, keep) of every row.

    The group's least id stays and names the group; a text without copies is a
    group of one. A null text is no copy of anything: group null, size 1, kept.
    Texts without a word are copies of equal texts only. Null ids come after all
    others; rows that repeat an id and text are shown each with keep true, as
    they can't be told apart (``drop_near_duplicates`` leaves one).
    """
    took, got = _decided(df, id_col, text_col, distance)
    out = got.select(F.col("doc").alias("doc_id"), F.col("group").alias("group_id"), "size", "keep")
    null = took.rows.where(took[text_col].isNull()).select(
        took[id_col].alias("doc_id"), F.lit(None).cast(out.schema["group_id"].dataType).alias("group_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("keep")
    )
    return out.unionByName(null)


def drop_near_duplicates(df: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group; all columns stay as they are, and rows with a null text stay."""
    took, got = _decided(df, id_col, text_col, distance)
    stays = got.where("keep").select(F.col("k1").alias("j1"), F.col("k2").alias("j2")).distinct()
    rows = took.rows.select("*", *row_key(took[id_col], took[text_col]))
    kept = rows.where(took[text_col].isNotNull()).join(stays, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left_semi").dropDuplicates(["k1", "k2"])
    return took.restore(kept.unionByName(rows.where(took[text_col].isNull())))
