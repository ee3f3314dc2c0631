"""Approximate nearest neighbours by a forest of hash prefixes (operator 8).

Each of TREES trees gives every vector a hash string: first a symbol, the coordinate that is largest in size after a random
rotation, and its sign; then binary digits, the sides of random planes. In sorted order strings with a common prefix lie together, and a
leaf holds those that agree in all of their length, which follows the table: about LEAF vectors have a leaf to themselves.
A query has a string per tree and symbol. From its leaf there it ascends to shorter prefixes, and to less likely
symbols, in all trees at once: it takes what agrees with it in a prefix of ``length`` digits where

    (its own coordinate for the symbol) + DIGIT * length >= level

so that lowering the level by DIGIT shortens every prefix in every tree by a digit. The level is fitted on a bounded sample:
exact neighbours of at most SAMPLE queries among all rows tell how low it must be to meet a share of TARGET of
them. So recall does not depend on the size or kind of the table; what random vectors cost is that the share of
the table that is met falls slowly. A query that still meets fewer than it is to return ascends further. What is met is ranked by 16-bit codes, the best of all trees then by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import runs
from .jaccard import BROADCAST_IDS
from .kernels import expand, tidy
from .state import materialise

TREES, AXES = 8, 64  # trees, coordinates that a symbol chooses from at most
LEAF, DIGITS = 1024, 16  # vectors of a leaf that strings are made long enough for, digits at most
DIGIT = 0.3  # what a digit of common prefix is worth, in standard deviations of a coordinate
SAMPLE, SAMPLE_BYTES = 256, 8 << 20  # queries, and bytes of them, whose exact neighbours fit the level
TARGET = 0.96  # share of the sample's neighbours that the level must meet
BLOCK = 1 << 16  # vectors of a leaf that one task compares with queries; a fuller leaf is dealt to several
MEET = 2048  # vectors that a query meets at least, or all there are
SLICE = 512  # rows hashed at once
TASK_BYTES = 8 << 20  # codes that tasks are made for
ENTRY = pa.schema([("cell", pa.int64()), ("ask", pa.bool_()), ("c", pa.int64()), ("code", pa.binary()), ("scale", pa.float32())])
LOWER, ROUNDS = 1.0, 4  # what the level falls by for queries that met too few, and how often before they search all
Plan = dict[int, tuple[int, float, float, int]]  # by vector length: digits of a string, largest norm, level, vectors


def usable(vector: str) -> Column:
    """Neither null, nor empty, nor zero, nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The random directions of all trees for vectors of one length.

    To let angles follow inner products, one more component gives all vectors the norm ``longest``; queries have 0 there.
    """

    def __init__(self, size: int, digits: int, longest: float, seed: int = 7):
        rng, axes = np.random.default_rng(seed), min(AXES, size + 1)
        self.size, self.digits, self.longest, self.axes = size, digits, longest, axes
        turned = [np.linalg.qr(rng.standard_normal((size + 1, axes)))[0] for _ in range(TREES)]
        self.axis = np.concatenate(turned, 1).astype(np.float32) * np.float32(np.sqrt(size + 1))
        self.plane = rng.standard_normal((size + 1, TREES * DIGITS)).astype(np.float32)

    def points(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, 1 - (v**2).sum(1) / self.longest**2))
        return np.concatenate([v / self.longest, lift[:, None]], 1).astype(np.float32)

    def asked(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v / np.sqrt((v**2).sum(1))[:, None], np.zeros((len(v), 1))], 1).astype(np.float32)

    def turned(self, points: np.ndarray) -> np.ndarray:
        """rows x trees x symbols: a coordinate and, after all coordinates, its opposite."""
        seen = (points @ self.axis).reshape(len(points), TREES, self.axes)
        return np.concatenate([seen, -seen], 2)

    def tails(self, points: np.ndarray) -> np.ndarray:
        """rows x trees: the digits of a string as a number."""
        side = (points @ self.plane).reshape(len(points), TREES, DIGITS)[:, :, : self.digits] > 0
        return side @ (1 << np.arange(self.digits)[::-1]).astype(np.int64)

    def cells(self, symbols: np.ndarray, tails: np.ndarray, trees: np.ndarray) -> np.ndarray:
        return (self.size * TREES + trees) << (8 + DIGITS) | symbols << DIGITS | tails

    def stored(self, v: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each vector."""
        p = self.points(v)
        return self.cells(self.turned(p).argmax(2), self.tails(p), np.arange(TREES))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Digits of the common prefix of two tails."""
        return self.digits - np.ceil(np.log2((a ^ b) + 1.0)).astype(np.int64)

    def visited(self, v: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all that the queries take at this level."""
        p = self.asked(v)
        seen, tails = self.turned(p), self.tails(p)
        row, tree, symbol = np.nonzero(seen + DIGIT * self.digits >= level)
        length = np.clip(np.ceil((level - seen[row, tree, symbol]) / DIGIT), 0, self.digits).astype(np.int64)
        wide = np.int64(1) << (self.digits - length)  # leaves below the prefix
        first = tails[row, tree] & -wide
        return np.repeat(row, wide), self.cells(np.repeat(symbol, wide), expand(first, wide), np.repeat(tree, wide))

    def level(self, asks: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The highest level at which each query meets the vector beside it."""
        p, x = self.asked(asks), self.points(found)
        symbol = self.turned(x).argmax(2)
        own = np.take_along_axis(self.turned(p), symbol[:, :, None], 2)[:, :, 0]
        return (own + DIGIT * self.common(self.tails(p), self.tails(x))).max(1)


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit components, scale) of each row."""
    scale = np.abs(v).max(1) / 32767
    return np.rint(v / scale[:, None]).astype("<i2"), scale


def _by_length(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, vectors, whether they ask) of slices of (c, v, ask), for the lengths that are planned."""
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        sizes = np.asarray(batch.column(1).value_lengths())
        for size in np.intersect1d(sizes, list(plan)).tolist():
            own = batch.filter(pa.array(sizes == size))
            v = np.asarray(own.column(1).flatten(), np.float64).reshape(own.num_rows, size)
            yield size, own.column(0).to_numpy(), v, np.asarray(own.column(2).to_numpy(zero_copy_only=False), bool)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of each row's ``keep`` largest scores, ties to the smaller id, rows ascending."""
    order = np.lexsort((ids, -scores, rows))
    first = runs(rows[order])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < keep]


def sampled_neighbours(classes: DataFrame, sample: dict[int, dict[int, np.ndarray]], k: int) -> DataFrame:
    """(q, c): for each query of sample[length][q] its k best classes among all, by doubles; a task sends k for each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)) for size in sample}
        for size, ids, v, _ in _by_length(batches, sample):
            names = np.array(list(sample[size]), np.int64)
            s = np.stack(list(sample[size].values())) @ v.T
            s[names[:, None] == ids[None]] = -np.inf
            n = min(k, len(ids))
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            q = np.concatenate([best[size][0], np.repeat(names, n)])
            c, s = np.concatenate([best[size][1], ids[top.ravel()]]), np.concatenate([best[size][2], np.take_along_axis(s, top, 1).ravel()])
            at = _best(q, c, s, k)
            best[size] = q[at], c[at], s[at]
        for q, c, s in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x[np.isfinite(s)]) for x in (q, c, s)], ["q", "c", "s"])

    each = classes.select("c", "v", "ask").mapInArrow(run, "q long, c long, s double")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "c"))), 1, k)
    return each.groupBy("q").agg(top.alias("top")).select("q", F.explode("top.c").alias("c"))


def fitted(classes: DataFrame, k: int) -> Plan:
    """The plan of each vector length that asks. A length without a query in the sample is searched whole, and so is one of at most MEET vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    lengths = classes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.max("ask").alias("asks")).where("asks").collect()
    digits = {r["size"]: min(DIGITS, max(0, int(np.log2(max(r.n, 1) / (2 * min(AXES, r["size"] + 1) * LEAF))))) for r in lengths}
    longest = {r["size"]: r.longest for r in lengths}
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * max([1, *digits]))))
    sample: dict[int, dict[int, np.ndarray]] = {}
    for r in classes.where("ask").orderBy(F.xxhash64(F.lit(3), "h"), "c").limit(most).select("c", "v").collect():
        sample.setdefault(len(r.v), {})[r.c] = np.array(r.v, np.float64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            for q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(x)
                if size not in made:
                    made[size] = Forest(size, digits[size], longest[size])
                at = made[size].level(sample[size][q][None], np.array([x], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array(at.astype(np.float64))], ["size", "level"])

    levels: dict[int, list[float]] = {}
    if sample:
        pairs = F.broadcast(sampled_neighbours(classes, sample, k))  # SAMPLE * k rows at most
        for r in classes.select("c", "v").join(pairs, "c").select("q", "v").mapInArrow(run, "size long, level double").collect():
            levels.setdefault(r["size"], []).append(r.level)
    fit = lambda found: sorted(found)[int((1 - TARGET) * len(found))] - 1e-6 if found else -np.inf
    return {r["size"]: (digits[r["size"]], r.longest, fit(levels.get(r["size"])) if r.n > MEET else -np.inf, r.n) for r in lengths}


def entries(classes: DataFrame, plan: Plan) -> DataFrame:
    """(cell, ask, c, code, scale): the leaves that vectors are in, and that queries take."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for size, ids, v, ask in _by_length(batches, plan):
            digits, longest, level, _ = plan[size]
            if size not in made:
                made[size] = Forest(size, digits, longest)
            code, scale = codes(v)
            asked = np.flatnonzero(ask)
            row, cell = made[size].visited(v[asked], max(level, -1e6))
            for who, leaf, asks in ((np.repeat(np.arange(len(ids)), TREES), made[size].stored(v).ravel(), False), (asked[row], cell, True)):
                blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * size), len(who), [None, pa.py_buffer(np.ascontiguousarray(code[who]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(np.full(len(who), asks)), pa.array(ids[who]), blobs, pa.array(scale[who].astype(np.float32))], schema=ENTRY)

    return classes.select("c", "v", "ask").mapInArrow(run, "cell long, ask boolean, c long, code binary, scale float")


def full_leaves(classes: DataFrame, plan: Plan, block: int) -> DataFrame:
    """(cell, parts) of the leaves with more than ``block`` vectors."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for size, _, v, _ in _by_length(batches, plan):
            if size not in made:
                made[size] = Forest(size, *plan[size][:2])
            cell, n = np.unique(made[size].stored(v), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counts = classes.select("c", "v", "ask").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))


def compared(index: DataFrame, keep: int) -> DataFrame:
    """(q, s, c): for each query of a task the ``keep`` best of the vectors in the leaves that it takes, by codes."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        cell = table["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, table = cell[order], table.take(pa.array(order))
        first = np.append(runs(cell), len(cell)).tolist()
        for a, b in zip(first, first[1:], strict=False):
            part = table.slice(a, b - a)
            ask, ids, scale = part["ask"].to_numpy(), part["c"].to_numpy(), part["scale"].to_numpy()
            base, asked = np.flatnonzero(~ask), np.flatnonzero(ask)
            if not len(base) or not len(asked):
                continue
            code = np.frombuffer(b"".join(part["code"].to_pylist()), "<i2").reshape(b - a, -1)
            own = code[base].astype(np.float32) * scale[base][:, None]
            for lot in np.array_split(asked, len(asked) * len(base) // (1 << 22) + 1):
                s = (code[lot].astype(np.float32) @ own.T) * scale[lot][:, None]
                n = min(keep, len(base))
                top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(base) else np.broadcast_to(np.arange(n), s.shape)
                out.append((np.repeat(ids[lot], n), ids[base][top.ravel()], np.take_along_axis(s, top, 1).ravel()))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        at = _best(q, c, s, keep)
        q, c, s = q[at], c[at], s[at]
        cut = np.append(runs(q), len(q)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (s, c)]
        return pa.table([pa.array(q[cut[:-1]]), *lists], names=["q", "s", "c"])

    return index.groupBy("lot", "part").applyInArrow(run, "q long, s array<float>, c array<long>")


def candidates(classes: DataFrame, plan: Plan, k: int, full: DataFrame | None) -> DataFrame:
    """(q, best): for each class that asks the best 2k + 1 of those that it meets at the plan's levels; full: leaves to deal to several tasks."""
    index = entries(classes, plan)
    if full is None:
        index = index.withColumn("part", F.lit(0))
    else:
        every, own = F.sequence(F.lit(0), F.col("parts") - 1), F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("ask"), every).otherwise(F.array(own))
        index = index.join(full, "cell", "left").withColumn("part", F.explode(parts)).drop("parts")
    size, n = max([0, *plan]), sum(x[3] for x in plan.values())
    lots = TREES * max(4, n * (2 * size + 16) // TASK_BYTES + 1)
    found = compared(index.withColumn("lot", F.pmod(F.xxhash64("cell"), F.lit(lots))), k + 1).groupBy("q").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("c")).alias("c"))
    order = F.sort_array(F.arrays_zip("s", "c"), False)
    return found.select("q", F.slice(F.array_distinct(F.transform(order, lambda x: x["c"])), 1, 2 * k + 1).alias("best"))


def met(classes: DataFrame, plan: Plan, k: int, block: int) -> DataFrame:
    """(q, c): the candidates of each class that asks. Those that meet fewer than k, where there are more, ascend again, at last to all."""
    full = materialise(full_leaves(classes, plan, block))
    crowded = full.limit(BROADCAST_IDS + 1).count()
    full = None if not crowded else F.broadcast(full) if crowded <= BROADCAST_IDS else full
    asking, rounds = classes, []
    for k_th in range(ROUNDS + 1):
        found = materialise(candidates(asking, plan, k, full))
        rounds.append(found.select("q", F.explode("best").alias("c")))
        enough = F.coalesce(*[F.when(F.size("v") == size, F.lit(min(k, x[3] - 1))) for size, x in plan.items()], F.lit(0))
        short = asking.where("ask").select("c", enough.alias("need")).join(found.select(F.col("q").alias("c"), F.size("best").alias("n")), "c", "left").where(F.coalesce("n", F.lit(0)) < F.col("need")).select("c", F.lit(True).alias("ask"))
        short = materialise(short)
        left = short.limit(BROADCAST_IDS + 1).count()
        if not left:
            break
        asking = classes.drop("ask").join(F.broadcast(short) if left <= BROADCAST_IDS else short, "c", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        plan = {size: (d, top, level - LOWER if k_th + 1 < ROUNDS else -np.inf, n) for size, (d, top, level, n) in plan.items()}
    return reduce(DataFrame.unionByName, rounds).distinct()


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row where ``queries`` holds.

    Equal vectors (by 128 bits of hash) are one class that is indexed with its k + 1 smallest ids: more can be in no answer.
    Each asking class is answered once, however many of its rows ask. All that a query meets is ranked by 16-bit codes, the
    best 2k + 1 classes then by the vectors as given, in doubles added from left to right, so that equal vectors tie. Ties go to
    the smaller vec_id, so does a repeated row's second score. A query is no candidate of its own id. Unusable vectors, null ids and
    vectors of another length than the query's take no part. Empty tables, and tables without queries, give none.
    A leaf of more than ``block`` vectors is dealt to several tasks.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable("v"))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    first = Window.partitionBy("h", "g").orderBy("vec_id")
    asked = rows.where("asks").select("h", "g", F.col("vec_id").alias("query_id"))
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    few = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    asking = asked.select("h", "g", F.lit(True).alias("ask")).distinct()
    classes = materialise(few.join(asking, ["h", "g"], "left").select(F.col("ids")[0].alias("c"), "ids", "v", F.coalesce("ask", F.lit(False)).alias("ask"), "h", "g"))

    plan = fitted(classes, k)
    pairs = met(classes, plan, k, block)

    near = pairs.join(classes.select("c", "ids", F.col("v").alias("x")), "c")
    both = near.join(classes.where("ask").select(F.col("c").alias("q"), "h", "g", "v"), "q")
    score = F.aggregate(F.zip_with("v", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = both.select("h", "g", score.alias("score"), F.explode("ids").alias("vec_id"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1)
    answers = scored.groupBy("h", "g").agg(ranked.alias("found"))
    own = asked.join(answers, ["h", "g"]).select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "f"))
    return own.select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
