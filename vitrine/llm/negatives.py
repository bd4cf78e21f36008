"""Hard negatives by inner product: ball trees, one for each part of the table, searched by branch and bound.

A ball tree's node holds a centre and a radius, so |anchor| * radius bounds how far any inner product below it lies from
the centre's, above and below. A node is left out if its bounds lie outside a query's score window, or strictly
beneath the query's k-th score so far. Trees are built where the rows are read and stored once; blocks of anchors then
meet every tree, first for the anchors' positives, then for the negatives of each positive.
"""

from __future__ import annotations

import math
import pickle
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import bound_batches, release, save

#: Most rows of a tree, and anchors of a block; a tree has at least LEAST_ROWS where the table allows.
TREE_ROWS, LEAST_ROWS, BLOCK_ROWS = 1 << 16, 1 << 10, 1 << 10
LEAF = 256
#: Scores and scaled components beyond this count as this.
MOST = 1 << 62
_NONE = -(1 << 63)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `a` with all of `x`, by the narrowest type that holds every partial sum."""
    limit = math.sqrt(float(np.max(np.einsum("ij,ij->i", a, a), initial=0)) * float(np.max(np.einsum("ij,ij->i", x, x), initial=0)))
    if limit < 1 << 24:
        return (a.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if limit < 1 << 53:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -MOST, MOST).astype(np.int64)


class BallTree:
    """Rows (id, label, vector) in the order of their leaves, by id within one."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.begin, self.end, self.child, centres, radii = [0], [len(ids)], [], [], []
        node = 0
        while node < len(self.begin):
            own = order[self.begin[node] : self.end[node]]
            rows = vectors[own]
            centre = rows.mean(axis=0) if len(rows) else np.zeros(vectors.shape[1])
            away = ((rows - centre) ** 2).sum(axis=1)
            radius = math.sqrt(away.max(initial=0))
            centres.append(centre)
            radii.append(radius * (1 + 1e-9))
            if len(own) <= LEAF or radius == 0 or not math.isfinite(radius):
                self.child.append(-1)
                order[self.begin[node] : self.end[node]] = own[np.argsort(ids[own], kind="stable")]
            else:
                one = rows[away.argmax()]
                two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                half = len(own) // 2
                order[self.begin[node] : self.end[node]] = own[np.argpartition(rows @ (two - one), half)]
                self.child.append(len(self.begin))
                self.begin += [self.begin[node], self.begin[node] + half]
                self.end += [self.begin[node] + half, self.end[node]]
            node += 1
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def search(self, anchors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each queries x k, best first, scores of _NONE where there are fewer.

        Query i asks for anchor of[i] the highest scores from low[i] to high[i] among rows whose label equals label[i]
        (`same`) or doesn't, the row id own[i] aside; ties by smaller id.
        """
        width = self.vectors.shape[1]
        fitted = np.zeros((len(anchors), width))
        fitted[:, : min(width, anchors.shape[1])] = anchors[:, :width]
        score, found = np.full((len(of), k), _NONE), np.full((len(of), k), np.iinfo(np.int64).max)
        floor, floor_id = low.astype(np.int64) - 1, np.full(len(of), -1)  # the k-th so far; below the window at first
        middle = fitted @ self.centre.T
        norm = np.sqrt((fitted**2).sum(axis=1))

        def scan(node: int, asked: np.ndarray) -> None:
            for a in range(self.begin[node], self.end[node], LEAF):
                part = slice(a, min(a + LEAF, self.end[node]))
                who, place = np.unique(of[asked], return_inverse=True)
                got = _products(fitted[who], self.vectors[part])[place]
                least, most = floor[asked][:, None], high[asked][:, None]
                ids = self.ids[part]
                good = (got <= most) & ((got > least) | ((got == least) & (ids < floor_id[asked][:, None])))
                good &= ((self.labels[part] == label[asked][:, None]) == same) & (ids != own[asked][:, None])
                row, col = np.nonzero(good)
                if not len(row):
                    continue
                touched = np.unique(row)
                q = np.concatenate([asked[row], np.repeat(asked[touched], k)])
                s = np.concatenate([got[row, col], score[asked[touched]].ravel()])
                i = np.concatenate([ids[col], found[asked[touched]].ravel()])
                order = np.lexsort((i, -np.maximum(s, _NONE + 1), q))
                q, s, i = q[order], s[order], i[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < k
                score[q[top], rank[top]], found[q[top], rank[top]] = s[top], i[top]
                full = asked[touched][score[asked[touched], k - 1] != _NONE]
                floor[full], floor_id[full] = score[full, k - 1], found[full, k - 1]

        # Each query's likeliest leaf first, so that its k-th score is high when the others are judged.
        at = np.zeros(len(of), dtype=np.int64)
        children = np.array(self.child)
        goal = np.where(np.abs(high) < MOST, high, MOST).astype(np.float64)
        while (inner := children[at] >= 0).any():
            left = np.where(inner, children[at], 0)
            right = np.where(inner, left + 1, 0)
            nearer = np.abs(middle[of, left] - goal) <= np.abs(middle[of, right] - goal)
            at = np.where(inner, np.where(nearer, left, right), at)
        for leaf in np.unique(at).tolist():
            scan(leaf, np.flatnonzero(at == leaf))
        stack = [(0, np.arange(len(of)))]
        while stack:
            node, asked = stack.pop()
            reach = norm[of[asked]] * self.radius[node]
            centre = middle[of[asked], node]
            slack = 1e-6 + 1e-9 * (np.abs(centre) + reach)
            asked = asked[(centre + reach + slack >= floor[asked]) & (centre - reach - slack <= high[asked])]
            if self.child[node] >= 0 and len(asked):
                stack += [(self.child[node] + 1, asked), (self.child[node], asked)]
            elif len(asked := asked[at[asked] != node]):
                scan(node, asked)
        return score, found


def _packed(thing) -> bytes:
    return zstandard.compress(pickle.dumps(thing, protocol=5), 1)


def _unpacked(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def _columns(batches, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, scaled vectors) of batches (id, label, vector); shorter vectors are filled with zeros."""
    ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
    labels = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
    sizes = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in batches])
    flat = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in batches])
    width = int(sizes.max(initial=0))
    vectors = np.zeros((len(ids), width))
    with np.errstate(over="ignore"):
        vectors[np.arange(width) < sizes[:, None]] = np.clip(np.floor(flat * scale), -float(MOST), float(MOST))
    return ids.astype(np.int64), labels.astype(np.int64), vectors


def _gathered(rows: int, scale: int, make):
    """mapInArrow: `make` of every `rows` rows of a task, and of those left, as (key, blob)."""

    def run(batches):
        held, count = [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([_packed(make(*_columns(held, scale)))], pa.binary())], names=["key", "blob"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == rows:
                    yield row()
                    held, count = [], 0
        if count:
            yield row()
        release()

    return run


def _flat(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if k == "block" else pa.array(np.asarray(v), pa.int32() if k in ("at", "nth") else pa.int64()) for k, v in columns.items()], names=list(columns))


def _searched(ask):
    """mapInArrow over (tree key, tree, block key, block, asked): what `ask` yields for each tree and block."""

    def run(batches):
        last = tree = None
        for batch in batches:
            for key, blob, block, anchors, asked in zip(*batch.columns, strict=True):
                if key.as_py() != last:
                    last, tree = key.as_py(), _unpacked(blob.as_py())
                yield from ask(tree, block.as_py(), _unpacked(anchors.as_py()), asked.as_py())
        release()

    return run


def _ask_positives(k: int):
    def ask(tree, block, anchors, _):
        ids, labels, vectors = anchors
        n = len(ids)
        score, found = tree.search(vectors, np.arange(n), np.full(n, -MOST), np.full(n, MOST), labels, ids, True, k)
        row, col = np.nonzero(score != _NONE)
        yield _flat({"block": [block] * len(row), "at": row, "score": score[row, col], "id": found[row, col]})

    return ask


def _ask_negatives(k: int, low: int, high: int):
    def ask(tree, block, anchors, asked):
        ids, labels, vectors = anchors
        if not asked:
            return
        at, nth, positive, p = (np.array([x[c] for x in asked]) for c in ("at", "nth", "id", "score"))
        # low * p <= 100 * score <= high * p, in whole numbers of any size
        least = np.array([max(-MOST, -(-low * int(v) // 100)) for v in p], dtype=np.int64)
        most = np.array([min(MOST, high * int(v) // 100) for v in p], dtype=np.int64)
        score, found = tree.search(vectors, at, least, most, labels[at], ids[at], False, k)
        row, col = np.nonzero(score != _NONE)
        yield _flat({"block": [block] * len(row), "at": at[row], "nth": nth[row], "anchor_id": ids[at[row]], "positive_id": positive[row], "positive_score": p[row], "score": score[row, col], "id": found[row, col]})

    return ask


def hard_negatives(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives.

    A component x counts as floor(scale * x); a score is the whole-number inner product with the anchor, exact. An anchor's
    positives are the `positives` best rows of its label; to each belong the `negatives` best rows of other labels
    whose score is from low to high percent of the positive's. Higher scores come first, ties by smaller id.

    Rows and anchors without an id, a label or a vector, or with a null or non-finite component take no part; an empty vector's
    scores are 0, of vectors of unequal length the common part counts. An anchor's own row, and all that share its id,
    are not its positives. Repeated rows count each; a repeated anchor gives repeated rows. Scores and scaled components beyond 2**62 count as
    that. Empty tables give an empty result. Other columns are left aside. Every row is searched, whatever the tree prunes.
    """
    spark = rows.sparkSession
    bound_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
        vector = F.col(f"`{vector_col}`").cast("array<double>")
        picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector")).where("id is not null and label is not null and vector is not null")
        return picked.where(F.forall("vector", number)).select("id", "label", "vector")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = clean(rows)
    count = held.count()
    each = min(TREE_ROWS, max(LEAST_ROWS, -(-count // (4 * tasks))))
    trees = save(held.coalesce(max(tasks, -(-count // TREE_ROWS))).mapInArrow(_gathered(each, scale, BallTree), "key string, blob binary"), "trees")
    asking = clean(anchors)
    blocks_wanted = max(1, -(-asking.count() // BLOCK_ROWS))
    blocks = save(asking.repartition(blocks_wanted, "id").mapInArrow(_gathered(BLOCK_ROWS, scale, lambda *x: x), "key string, blob binary").withColumnRenamed("key", "block"), "blocks")
    shares = max(1, trees.count())
    dealt = trees.select((F.pmod(F.xxhash64("key"), F.lit(shares))).alias("share"), "key", F.col("blob").alias("tree")).repartition(tasks, "share")

    def meet(asked: DataFrame, ask, schema: str) -> DataFrame:
        """Every block with every tree: a block goes to each share of trees once."""
        sent = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).repartition(tasks, "share")
        return dealt.join(sent.hint("merge"), "share").select("key", "tree", "block", "blob", "asked").mapInArrow(_searched(ask), schema)

    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "id")
    near = meet(blocks.withColumn("asked", F.lit(None).cast("array<struct<at:int,nth:int,id:long,score:long>>")), _ask_positives(positives), "block string, at int, score long, id long")
    top = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    per_block = top.groupBy("block").agg(F.collect_list(F.struct("at", "nth", "id", "score")).alias("asked"))  # at most BLOCK_ROWS * positives
    asked = save(blocks.join(per_block, "block"), "positives")
    schema = "block string, at int, nth int, anchor_id long, positive_id long, positive_score long, score long, id long"
    worst = Window.partitionBy("block", "at", "nth").orderBy(F.desc("score"), "id")
    ranked = meet(asked, _ask_negatives(negatives, low, high), schema).withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
