"""Near-duplicate grouping by SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, as_bytes, few, int64, mix, release, save, shingle_sets, text_rows
from vitrine.llm.components import components

SIZE, ROWS, BANDS = 128, 5, 25
#: Members of a bucket that one task compares with as many others.
BLOCK = 512


def superminhash(elements: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signatures (sets x size) of sets given as joined element hashes and their numbers.

    Each element walks its own random permutation of the positions; at step j it offers j + r (r uniform
    below 1, kept as 32 bits) to the position it reaches, and a position keeps the least offer. A set
    whose largest value is below the next step has settled and its elements stop.
    """
    count = len(sizes)
    table = np.full((count, size), np.iinfo(U64).max, dtype=U64)
    flat, owner = table.reshape(-1), np.repeat(np.arange(count), sizes)
    order: np.ndarray | None = None
    for j in range(size):
        draw = mix(elements + U64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        pick = j + (((draw & U64(0xFFFFFFFF)) * U64(size - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            row = np.arange(len(elements))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, j]
        np.minimum.at(flat, owner * size + place, (U64(j) << U64(32)) | (draw >> U64(32)))
        open_sets = table.max(axis=1) >= U64((j + 1) << 32)
        stay = open_sets[owner]
        if not stay.any():
            break
        elements, owner = elements[stay], owner[stay]
        if j == 0:
            place = place[stay]
            order = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
            order[np.arange(len(elements)), place] = 0
        else:
            order = order[stay]
    return table


def _signatures(words: int):
    def run(batches):
        for ids, texts in text_rows(batches, 1 << 20):
            elements, sizes = shingle_sets(texts, words)
            table = superminhash(elements, sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            pads = np.concatenate([[U64(0)], np.cumsum(elements)]), np.concatenate([[U64(0)], np.cumsum(mix(elements ^ U64(0x5851F42D4C957F2D)))])
            first, second = (p[bounds[1:]] - p[bounds[:-1]] for p in pads)
            keys = np.empty((len(ids), BANDS), dtype=U64)
            for b in range(BANDS):
                part = np.full(len(ids), U64(b + 1))
                for j in range(ROWS):
                    part = mix(part * U64(0x9E3779B97F4A7C15) + table[:, b * ROWS + j])
                keys[:, b] = part
            short = mix(table).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes),
                    int64(first),
                    int64(second),
                    pa.array([k.view(np.int64) if n else [] for k, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ],
                names=["id", "n", "d1", "d2", "bands", "short"],
            )
        release()

    return run


def _confirm(words: int, percent: int):
    """Keep the pairs whose full shingle sets meet the limit: 100 * intersection >= percent * union."""

    def run(batches):
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def of(key: int, text) -> np.ndarray:
            nonlocal held
            if key in cache:
                cache.move_to_end(key)
                return cache[key]
            got = cache[key] = shingle_sets(as_bytes([text]), words)[0]
            held += len(got)
            while held > 4_000_000 and len(cache) > 2:
                held -= len(cache.popitem(last=False)[1])
            return got

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = of(x, batch.column(2)[i].as_py()), of(y, batch.column(3)[i].as_py())
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    pairs = save(pairs, "pairs")
    nodes = save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    texts = save(docs.join(few(nodes), "id", "left_semi").dropDuplicates(["id"]), "texts")
    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    wide = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return save(wide.mapInArrow(_confirm(words, percent), "a long, b long"), "links")


def _compare(floor: int, words: int = 0, percent: int = 0):
    """Of one block against another: a spanning forest, over components, of the members that agree.

    Members agree if their short signatures do so in `floor` positions and, where `percent` is given, their
    full sets meet that limit. At most one row less than there are members comes out, however many agree.
    """

    def run(key, table):
        table = table.sort_by("id")
        ids, names, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        sign = np.frombuffer(b"".join(table.column("short").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        if percent:
            sets, sizes = shingle_sets(as_bytes(table.column("text").to_pylist()), words)
            ends = np.cumsum(sizes)
        group = np.unique(names, return_inverse=True)[1]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        out = []
        for i in left:
            near = right[((sign[right] == sign[i]).sum(axis=1) >= floor) & (group[right] != group[i])]
            if percent and len(near):
                own = sets[ends[i] - sizes[i] : ends[i]]
                other = np.concatenate([sets[ends[j] - sizes[j] : ends[j]] for j in near])
                same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), dtype=np.int64)
                near = near[100 * both >= percent * (sizes[i] + sizes[near] - both)]
            for j in near:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _in_blocks(members: DataFrame, key: str, blocks: DataFrame, run) -> DataFrame:
    """Edges (a, b) from `run` on every two blocks of the members of a key; blocks: (key, blocks)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = members.join(blocks, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    return spread.drop("own", "other", "blocks").groupBy(key, "i", "j").applyInArrow(run, "a long, b long")


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """(key, blocks) of the keys whose members are in several components."""
    sizes = members.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    return sizes.where("lo <> hi").select(key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: groups of documents linked by Jaccard >= percent / 100.

    Documents with equal sets are one class from the start. Classes that share a band of the signature are
    candidates. First each is confirmed on full sets against the best connected class of its bucket. Buckets
    that then still hold several components are compared by signature, block against block, which leaves
    clusters of similar classes; each cluster is confirmed on full sets, block against block. Blocks give a
    spanning forest, so rows stay in proportion to documents. With 25 bands of 5 a pair of likeness s shares no
    band with chance (1 - s**5)**25: 5e-5 at 0.80, 4e-7 at 0.85, less above; such a pair is linked only through others.

    Null or blank texts have no shingles and stand alone; rows with a null id come back with null
    component_id and kept false; repeated ids count as one document; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id is not null")
    schema = "id long, n long, d1 long, d2 long, bands array<long>, short binary"
    signed = save(known.mapInArrow(_signatures(words), schema), "signed")
    classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    joined = signed.join(classes, ["d1", "d2", "n"], "left")
    first = F.col("id") == F.col("rep")
    rows = save(joined.select("id", "n", F.coalesce("rep", "id").alias("rep"), F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("short")).alias("short")), "classes")
    reps = rows.where("bands is not null")

    bands = reps.select("id", F.explode("bands").alias("key")).distinct()
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = save(bands.join(sizes, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = save(members.join(degree, "id"), "ranked")
    hubs = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("least"))).alias("hub")).select("key", (-F.col("hub.least")).alias("hub"))
    star = members.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = _verified(known, star, words, percent)
    groups = components(links)

    held = save(members.join(groups, members.id == groups.node, "left").select("key", "id", F.coalesce("component", "id").alias("component")), "held")
    mixed = _blocks(held, "key")
    rest = save(held.join(mixed.select("key"), "key", "left_semi").join(reps.select("id", "short").distinct(), "id"), "rest")
    limit = percent / 100
    floor = int(SIZE * (limit - 5.5 * (limit * (1 - limit) / SIZE) ** 0.5))
    alike = save(_in_blocks(rest, "key", mixed, _compare(floor)), "alike")
    if not alike.isEmpty():
        nodes = save(rest.select("id", "component", "short").distinct(), "rest_nodes")
        named = [nodes.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
        clusters = components(alike.join(named[0], "a").join(named[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        near = save(nodes.join(clusters, nodes.component == clusters.node).select(clusters.component.alias("cluster"), "id", nodes.component, "short"), "clusters")
        texts = known.join(few(near.select("id")), "id", "left_semi").dropDuplicates(["id"])
        more = save(_in_blocks(near.join(texts, "id"), "cluster", _blocks(near, "cluster"), _compare(floor, words, percent)), "more")
        if not more.isEmpty():
            groups = components(links.unionByName(more))

    out = rows.join(groups, rows.rep == groups.node, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    lost = docs.where("id is null").mapInArrow(_signatures(words), schema).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    out = out.unionByName(lost)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
