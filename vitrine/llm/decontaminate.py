"""Benchmark decontamination by greedy string tiling of word sequences."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import BROADCAST_ROWS, NO_WORD, U64, as_bytes, few, int64, mix, save, text_rows, word_hashes

_words = partial(word_hashes, between=NO_WORD)
SEEDS = "id long, seed long, places long, words long"


class _Rolling:
    """Karp-Rabin hashes of all runs of n words, modulo 2**64 over mixed word hashes."""

    BASE = 0x9FB21C651E98DF25

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(self.BASE))]))
        down = U64(pow(self.BASE, -1, 1 << 64))
        self.down = np.cumprod(np.concatenate([[U64(1)], np.full(n, down)]))
        self.sums = np.concatenate([[U64(0)], np.cumsum(words * self.up[:n])])

    def __call__(self, n: int) -> np.ndarray:
        ends = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:ends]) * self.down[:ends]) if ends > 0 else self.sums[:0]


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (text place, item place, words): always the longest match left, none overlapping, of `least` words or more.

    The search length starts at the whole item and halves, as in running Karp-Rabin; runs of equal hash that
    touch no marked word are extended to both sides. The longest is marked first; what is left of a match that
    a tile cuts goes back among the others by its own length. Of equally long ones the first in the text, then
    in the item, is marked.
    """
    mark_text, mark_item = np.zeros(len(text) + 1, bool), np.zeros(len(item) + 1, bool)
    roll_text, roll_item = _Rolling(text), _Rolling(item)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(text))
    while length >= least:
        taken = [np.concatenate([[0], np.cumsum(m[:-1])]) for m in (mark_text, mark_item)]
        free = [np.flatnonzero(c[length:] == c[: len(c) - length]) for c in taken]
        here, there = roll_text(length)[free[0]], roll_item(length)[free[1]]
        where: dict[int, list[int]] = {}
        for key, i in zip(there.tolist(), free[1].tolist(), strict=True):
            where.setdefault(key, []).append(i)
        hits = np.flatnonzero(np.isin(here, there))
        found, done = [], {}
        for at, key in zip(free[0][hits].tolist(), here[hits].tolist(), strict=True):
            for i in where[key]:
                if at < done.get(at - i, -1):
                    continue
                a, b, n = at, i, length
                while a and b and not mark_text[a - 1] and not mark_item[b - 1] and text[a - 1] == item[b - 1]:
                    a, b, n = a - 1, b - 1, n + 1
                while a + n < len(text) and b + n < len(item) and not mark_text[a + n] and not mark_item[b + n] and text[a + n] == item[b + n]:
                    n += 1
                done[at - i] = a + n
                found.append((-n, a, b))
        heapq.heapify(found)
        while found:
            n, a, b = heapq.heappop(found)
            held = mark_text[a : a - n] | mark_item[b : b - n]
            if not held.any():
                mark_text[a : a - n] = mark_item[b : b - n] = True
                tiles.append((a, b, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[True], held, [True]])))
            for begin, end in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - begin >= length:
                    heapq.heappush(found, (begin - end, a + begin, b + begin))
        length = length - 1 if length <= 2 * least else max(least, length // 2)
    return tiles


def _seeds(least: int):
    """(id, seed, places, words): each run of `least` words of a text, by hash, how often it is there and the text's words."""

    def run(batches):
        for ids, texts in text_rows(batches):
            words, counts = _words(texts)
            keys = _Rolling(words)(least)
            out_id, out_key, out_many, out_words, at = [], [], [], [], 0
            for i, n in zip(ids, counts.tolist(), strict=True):
                own, many = np.unique(keys[at : at + n - least + 1] if n >= least else keys[:0], return_counts=True)
                out_id += [i] * len(own)
                out_words += [n] * len(own)
                out_key.append(own)
                out_many.append(many)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), int64(np.concatenate([keys[:0], *out_key])), pa.array(np.concatenate([np.zeros(0, np.int64), *out_many]), pa.int64()), pa.array(out_words, pa.int64())], names=["id", "seed", "places", "words"])

    return run


def _touched(seeds: np.ndarray, least: int):
    """Documents that share a seed with the given ones: (id, text, their shared seeds)."""

    def run(batches):
        for ids, texts in text_rows(batches):
            words, counts = _words(texts)
            keys = _Rolling(words)(least)
            at = np.minimum(np.searchsorted(seeds, keys), len(seeds) - 1)
            hit = np.flatnonzero(seeds[at] == keys)
            ends = np.cumsum(counts)
            owner = np.searchsorted(ends, hit, side="right")
            inside = hit + least <= ends[owner]
            hit, owner = hit[inside], owner[inside]
            rows = np.unique(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.int64()),
                    pa.array([texts[i] for i in rows], pa.binary()),
                    pa.array([np.unique(keys[hit[owner == i]]).view(np.int64) for i in rows], pa.list_(pa.int64())),
                ],
                names=["id", "text", "seeds"],
            )

    return run


def _tile(least: int):
    kind = pa.list_(pa.struct([("text_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, item, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = _words([text])[0], _words(as_bytes([wanted]))[0]
                tiles = greedy_tiles(a, b, least)
                rows.append((doc, item, len(b), sum(t[2] for t in tiles), [dict(zip(("text_at", "item_at", "words"), t, strict=True)) for t in tiles]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind), strict=True)], names=["doc_id", "item_id", "item_words", "covered_words", "tiles"])

    return run


def overlaps(docs: DataFrame, items: DataFrame, least: int = 5, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_seeds: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of every document that holds an item.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Documents and items that
    share a run of `least` words are tiled, in any order of the passages, and reported if the tiles cover
    `coverage` of the item's words or more. Texts travel only to items of which they share as many runs as that
    coverage takes at least. The items' runs go to all tasks while they number `most_seeds` or less, else they
    are joined by shuffle; both give the same rows.

    Null and empty texts and items of fewer than `least` words match nothing; rows with a null id are left
    out; repeated ids of equal text give one row per item; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id is not null").dropDuplicates()
    seeds = save(items.mapInArrow(_seeds(least), SEEDS).withColumnRenamed("id", "item_id").distinct(), "seeds")
    known = seeds.select("seed").distinct().limit(most_seeds + 1).toArrow().column(0)
    if len(known) <= most_seeds:
        sought = np.sort(known.to_numpy().view(U64)) if len(known) else np.zeros(1, U64)
        touched = save(docs.mapInArrow(_touched(sought, least), "id long, text binary, seeds array<long>"), "touched")
        shared = touched.select("id", F.explode("seeds").alias("seed"))
        texts = touched.select("id", "text")
    else:
        shared = docs.mapInArrow(_seeds(least), SEEDS).join(seeds.select("seed").distinct(), "seed", "left_semi").select("id", "seed")
        texts = docs.withColumn("text", F.encode("text", "utf-8"))
    # tiles of `least` words or more that cover c words hold c / least runs of `least` words at least
    wanted = F.ceil((F.lit(coverage) * F.col("words") - 1e-6) / least)
    met = shared.distinct().join(few(seeds), "seed").groupBy("id", "item_id", "words").agg(F.sum("places").alias("places"))
    pairs = save(met.where(F.col("places") >= wanted).select("id", "item_id").distinct(), "item_pairs")
    wide = few(pairs).join(texts.dropDuplicates(), "id").join(items, "item_id").select("id", "item_id", "text", "item_text")
    tiled = wide.mapInArrow(_tile(least), "doc_id long, item_id long, item_words int, covered_words int, tiles array<struct<text_at: int, item_at: int, words: int>>")
    share = F.col("covered_words") / F.col("item_words")
    return tiled.select("doc_id", "item_id", "item_words", "covered_words", share.alias("coverage"), "tiles").where(F.col("coverage") >= coverage)
