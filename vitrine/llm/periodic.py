"""Runs of periodic words: an all-lag scan of each text's word ids.

For every lag q up to n / min_exponent a text's ids are compared with themselves shifted by q; a stretch of equal
places long enough makes a run of period q. Most lags hold no such stretch, which is told first: the places that a
stretch of the least length can't miss are compared by hashes of several words, for all lags of an octave at once.
Only lags with an equal place get the whole comparison, and nothing is lost by it.

Texts of usual length are scanned where they are read, many in one buffer. A long text is dealt to several tasks, a
range of lags each; its runs meet again afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import _SPACE, U64, SpanHash, as_bytes, bound_batches, mix, release, slices

#: Bytes of a text from which its lags are dealt to several tasks, one for each so many bytes.
LONG_BYTES = 8 << 20
#: Most tasks of one text.
MOST_RANGES = 16
#: Lags below this are scanned by every task of a long text, so that multiples of short periods are known everywhere.
SHORT_LAG = 64
#: Text bytes scanned in one buffer.
BUFFER_BYTES = 1 << 19
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BASE = 0xD1342543DE82EF95


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): a 64-bit hash of every word; the words of text i are those from bounds[i] to bounds[i + 1]."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return SpanHash(data)(start, end), np.concatenate([[0], np.searchsorted(start, ends)])


def octaves(most: int) -> Iterator[tuple[int, int]]:
    """Lags 1 to `most` in ranges [low, high), each at most twice as far as it begins."""
    low = 1
    while low <= most:
        yield low, min(2 * low, most + 1)
        low *= 2


class Scan:
    """All-lag scan of word ids; texts between `bounds` are scanned apart."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int):
        # A word of its own after each text: no comparison goes on beyond it.
        sizes = np.diff(bounds)
        self.first = bounds[:-1] + np.arange(len(sizes))
        self.size, self.min_length, self.min_exponent = sizes, min_length, min_exponent
        self.ids = np.empty(len(ids) + len(sizes), dtype=U64)
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)
        ends = self.first + sizes
        inner = np.ones(len(self.ids), dtype=bool)
        inner[ends] = False
        self.ids[inner] = ids
        self.ids[ends] = mix(np.arange(1, len(sizes) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        n = len(self.ids)
        up = np.full(n, U64(_BASE), dtype=U64)
        down = np.full(n, U64(pow(_BASE, -1, 1 << 64)), dtype=U64)
        if n:
            up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate([[U64(0)], np.cumsum(self.ids * np.cumprod(up), dtype=U64)])
        self.covered, self.until = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.runs: list[dict[tuple[int, int], int]] = [{} for _ in sizes]

    def stretch(self, lag):
        """Least number of equal places that makes a run."""
        return np.maximum((self.min_exponent - 1) * lag, self.min_length - lag)

    def octave(self, low: int, high: int, keep: bool = True) -> None:
        """Find the runs of periods [low, high); `keep` false: only note what they cover."""
        least = max(1, int(self.stretch(np.arange(low, high)).min()))
        wide = (least + 1) // 2
        step, n = least - wide + 1, len(self.ids) - wide + 1
        if n <= low:
            return
        grams = (self.sums[wide:] - self.sums[:n]) * self.down[:n]
        places = np.arange(0, n - low, step)
        if not len(places):
            return
        padded = np.concatenate([grams, np.zeros(high - low, dtype=U64)])
        if len(places) * (high - low) < 1 << 22:
            shifted = np.lib.stride_tricks.sliding_window_view(padded, high - low)[low::step][: len(places)]
            row, lag = np.nonzero(shifted == grams[places][:, None])
        else:
            found = [(np.full(len(hit), k), hit) for k, p in enumerate(places) if len(hit := np.flatnonzero(padded[p + low : p + high] == grams[p]))]
            row, lag = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (places[:0], places[:0])
        at, lag = places[row], lag + low
        other = at + lag
        real = other < n
        at, lag, other = at[real], lag[real], other[real]
        # Both places in one text, the lag within its bound, and not a multiple of the period of a run that holds both.
        owner = self.text[at]
        good = (owner == self.text[other]) & (lag <= self.size[owner] // self.min_exponent)
        good &= ~((self.covered[at] > 0) & (lag % np.maximum(self.covered[at], 1) == 0) & (other < self.until[at]))
        for pair in np.unique(lag[good] * len(self.size) + owner[good]).tolist():
            self._compare(pair % len(self.size), pair // len(self.size), keep)

    def _compare(self, text: int, q: int, keep: bool) -> None:
        """The runs of one text at one lag, from the whole comparison with its shift."""
        first, n = int(self.first[text]), int(self.size[text])
        ids = self.ids[first : first + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        enough = end - start >= int(self.stretch(q))
        known = self.runs[text]
        for s, e in zip(start[enough].tolist(), (end[enough] + q).tolist(), strict=True):
            if (s, e) in known:  # a shorter period has the same words
                continue
            known[s, e] = q if keep else -q
            part = slice(first + s, first + e)
            farther = self.until[part] < first + e
            self.covered[part][farther] = q
            self.until[part][farther] = first + e

    def found(self, text: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of a text's runs by start, then period."""
        return sorted(((s, e - s, q) for (s, e), q in self.runs[text].items() if q > 0), key=lambda r: (r[0], r[2]))


def _collapsed(raw: bytes, runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by one space, that no run contains after its first period."""
    words = raw.split()  # at the same six bytes
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for s, length, q in runs:
            keep[s + q : s + length] = False
        words = compress(words, keep.tolist())
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _scanned(at: int, names: list[str], min_length: int, min_exponent: int):
    """mapInArrow: rows with their number of words, runs and collapsed text."""

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
            for a, b in slices(sizes, BUFFER_BYTES):
                part = batch.slice(a, b - a)
                texts = as_bytes(part.column(at).cast(pa.large_binary()).to_pylist())
                ids, bounds = word_ids(texts)
                # Texts of like length share a buffer: its lags go as far as its longest text needs.
                counts = np.diff(bounds)
                runs: list = [[] for _ in texts]
                classes = np.frexp(counts)[1]
                for c in np.unique(classes[counts >= max(min_length, min_exponent)]):
                    own = np.flatnonzero((classes == c) & (counts >= max(min_length, min_exponent)))
                    scan = Scan(np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in own]), np.concatenate([[0], np.cumsum(counts[own])]), min_length, min_exponent)
                    for low, high in octaves(int(counts[own].max()) // min_exponent):
                        scan.octave(low, high)
                    for k, i in enumerate(own.tolist()):
                        runs[i] = scan.found(k)
                yield _result(part, names, counts, runs, [_collapsed(raw, r) for raw, r in zip(texts, runs, strict=True)])
        release()

    return run


def _result(part: pa.RecordBatch, names: list[str], counts, runs: list, short: list[str]) -> pa.RecordBatch:
    listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(RUN))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(counts, dtype=np.int64)), listed, pa.array(short, pa.string())], names=names)


def _range_runs(min_length: int, min_exponent: int):
    """mapInArrow over (key, share, shares, text): the runs of a text's range of lags, every `shares`-th octave."""

    def run(batches):
        for batch in batches:
            for key, share, shares, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, bounds = word_ids(as_bytes([text]))
                scan = Scan(ids, bounds, min_length, min_exponent)
                for k, (low, high) in enumerate(octaves(len(ids) // min_exponent)):
                    # The upper octaves hold most lags: each is cut into as many parts as there are tasks.
                    cuts = np.linspace(low, high, shares + 1).astype(int) if low >= SHORT_LAG else [low, high]
                    parts = [(share, True)] if low >= SHORT_LAG else [(0, share == 0)]
                    for p, keep in parts:
                        if cuts[p] < cuts[p + 1]:
                            scan.octave(int(cuts[p]), int(cuts[p + 1]), keep)
                listed = [{"start": s, "length": n, "period": q} for s, n, q in scan.found(0)]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([listed], pa.list_(RUN))], names=["key", "runs"])
        release()

    return run


def _rejoined(at: int, names: list[str]):
    """mapInArrow over rows with `parts`, the runs of all ranges of their text: the rows with runs and collapsed text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = as_bytes(row.column(at).cast(pa.large_binary()).to_pylist())
                best: dict[tuple[int, int], int] = {}
                for part in row.column(batch.num_columns - 1)[0].as_py() or ():
                    for r in part:
                        best[r["start"], r["length"]] = min(r["period"], best.get((r["start"], r["length"]), r["period"]))
                runs = sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))
                kept = pa.RecordBatch.from_arrays(row.columns[:-1], names=batch.schema.names[:-1])
                yield _result(kept, names, [len(raw[0].split())], [runs], [_collapsed(raw[0], runs)])
        release()

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12, min_exponent: int = 2, long_bytes: int = LONG_BYTES, words_col: str = "n_words", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """The documents with their number of words, their runs (start, length, period by start, then period) and the text without repetitions.

    Words are runs of characters other than space and U+0009 to U+000D, compared as they are written, by 64-bit hashes. A run
    is a stretch of at least max(min_length, min_exponent * q) words with smallest period q that no neighbouring word
    extends; min_exponent is 2 or more. The collapsed text is the words, one space between them, that no run contains after its first q words.

    Null, empty and blank texts: no words, no runs, an empty collapsed text. Rows are judged by themselves: repeated
    rows and ids give repeated results, null ids are kept, other columns stay; columns of the made names are replaced.
    Texts over `long_bytes` have their lags scanned by several tasks (at most 16 copies of such a text travel), with the same results.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    bound_batches(docs.sparkSession)
    made = {words_col, runs_col, collapsed_col}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    at = rows.columns.index(text_col)
    names = [*rows.columns, words_col, runs_col, collapsed_col]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), f"`{words_col}` long, `{runs_col}` array<struct<start:long,length:long,period:long>>, `{collapsed_col}` string"])
    size = F.octet_length(F.col(f"`{text_col}`"))
    usual = rows.where(size.isNull() | (size <= long_bytes)).mapInArrow(_scanned(at, names, min_length, min_exponent), schema)
    long = rows.where(size > long_bytes)
    text = F.col(f"`{text_col}`")
    shares = F.least(F.lit(MOST_RANGES), F.floor(F.octet_length("text") / F.lit(max(1, long_bytes))) + 1).cast("int")
    keyed = long.select(F.sha2(text, 256).alias("key"), text.alias("text")).dropDuplicates(["key"]).withColumn("shares", shares)
    dealt = keyed.select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "shares", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt.repartition(tasks, "key", "share").mapInArrow(_range_runs(min_length, min_exponent), "key string, runs array<struct<start:long,length:long,period:long>>")
    found = parts.groupBy("key").agg(F.collect_list("runs").alias("__parts"))
    met = long.join(found, F.sha2(text, 256) == F.col("key"), "left").select(*[long[f"`{c}`"] for c in rows.columns], "__parts")
    return usual.unionByName(met.mapInArrow(_rejoined(at, names), schema))
