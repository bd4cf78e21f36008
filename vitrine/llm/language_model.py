"""Deleted interpolation: bigram, unigram and uniform estimates mixed by how often the context was seen.

Counts cover all training documents. The mixture weights of each context-frequency bucket come from
expectation-maximisation on deleted counts: every training document is scored with its own counts taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.chunks import answers_by_chunk, chunked, decode, from_documents, pack_array, pack_sorted, range_bounds, ranges, unpack_array, unpack_sorted
from vitrine.llm.common import U64, as_bytes, mix, save, word_hashes

CHUNK_BYTES, RANGE_BYTES = 2_000_000, 16 << 20
END, START = U64(0x51ED270B1F2A3C4D), U64(0x2545F4914F6CDD1D)
#: Context buckets by powers of two, and half powers of two in which the two estimates are told apart for the weights.
BUCKETS, STEPS_TWO, STEPS_ONE = 24, 64, 80


class Tokens:
    """Token and context numbers of a chunk's documents, and their different keys in order."""

    def __init__(self, texts: list[bytes]):
        words, counts = word_hashes(texts)
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes) - 1
        token = np.empty(len(words) + len(texts), U64)
        is_end = np.zeros(len(token), dtype=bool)
        is_end[ends] = True
        token[is_end], token[~is_end] = END, words
        context = np.concatenate([[START], token[:-1]])
        context[np.concatenate([[0], ends[:-1] + 1])] = START
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.ones, index = np.unique(np.append(token, START), return_inverse=True)
        self.token, start = index[:-1], index[-1]
        self.context = np.concatenate([[start], self.token[:-1]])
        self.context[np.concatenate([[0], ends[:-1] + 1])] = start
        self.start = start
        self.twos, self.pair = np.unique(mix(context * U64(0x9FB21C651E98DF25) + token * U64(0xA24BAED4963EE407)), return_inverse=True)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the different tokens (of START: documents) and pairs."""
        use = train[self.owner]
        ones = np.bincount(self.token[use], minlength=len(self.ones))
        ones[self.start] = train.sum()
        return ones, np.bincount(self.pair[use], minlength=len(self.twos))

    def within(self, index: np.ndarray, different: int) -> np.ndarray:
        """How often the own document has each entry's number."""
        _, inverse, counts = np.unique(self.owner * different + index, return_inverse=True, return_counts=True)
        return counts[inverse]


def _columns(blob: bytes) -> tuple[list, list[bytes], np.ndarray]:
    rows = decode(blob)
    return rows.column(0).to_pylist(), as_bytes(rows.column(1).to_pylist()), np.array(rows.column(2).to_pylist(), dtype=bool)


def _ask(parts: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, texts, train = _columns(blob)
                tokens = Tokens(texts)
                for kind, (keys, counts) in enumerate(zip((tokens.ones, tokens.twos), tokens.counts(train), strict=True)):
                    bounds = range_bounds(keys, parts)
                    used = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                    cut = [slice(bounds[p], bounds[p + 1]) for p in used]
                    n = len(used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(used, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([pack_sorted(keys[c]) for c in cut], pa.binary()), pa.array([pack_array(counts[c].astype(np.uint32)) for c in cut], pa.binary())],
                        names=["part", "kind", "chunk", "keys", "counts"],
                    )

    return run


def _answer(key, table):
    """Total training counts for each request; the first row also tells the range's tokens and different tokens."""
    keys = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    different, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack_array(b, np.uint32) for b in table.column("counts").to_pylist()])
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    answers = np.split(total[inverse].astype(np.uint32), np.cumsum(sizes)[:-1])
    word = different != START
    first = table.column("kind")[0].as_py() == 0
    tokens, kinds = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if first:
        tokens[0], kinds[0] = total[word].sum(), (total[word] > 0).sum()
    return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "part": table.column("part"), "data": pa.array([pack_array(a) for a in answers], pa.binary()), "tokens": tokens, "types": kinds})


def _known(tokens: Tokens, answers: list) -> tuple[np.ndarray, np.ndarray]:
    data = [{a["part"]: a["data"] for a in answers or [] if a["kind"] == kind} for kind in (0, 1)]
    got = [np.concatenate([np.zeros(0, np.uint32), *[unpack_array(d[p], np.uint32) for p in sorted(d)]]).astype(np.int64) for d in data]
    if (len(got[0]), len(got[1])) != (len(tokens.ones), len(tokens.twos)):
        raise RuntimeError("a chunk was read again with other rows; store the documents first")
    return got[0], got[1]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(count + 1)).astype(np.int64))


def _statistics(total: int, types: int):
    """Held-out evidence for the weights: numbers of tokens by context bucket and sizes of both estimates."""

    def place(p: np.ndarray, steps: int) -> np.ndarray:
        return np.where(p > 0, 1 + np.minimum(steps - 2, (-2 * np.log2(np.maximum(p, 1e-300))).astype(np.int64)), 0)

    def run(batches):
        for batch in batches:
            for blob, answers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                _, texts, train = _columns(blob)
                t = Tokens(texts)
                ones, twos = _known(t, answers)
                use = train[t.owner]
                one = (ones[t.token] - t.within(t.token, len(t.ones)))[use]
                seen = (ones[t.context] - np.where(t.context == t.start, 1, t.within(t.context, len(t.ones))))[use]
                two = (twos[t.pair] - t.within(t.pair, len(t.twos)))[use]
                p1 = one / np.maximum(1, total - t.sizes[t.owner][use])
                p2 = np.where(seen > 0, two / np.maximum(1, seen), 0.0)
                cell = (_bucket(np.maximum(seen, 0)) * STEPS_TWO + place(p2, STEPS_TWO)) * STEPS_ONE + place(p1, STEPS_ONE)
                cells, inverse, n = np.unique(cell, return_inverse=True, return_counts=True)
                logs = [np.bincount(inverse, weights=np.log(np.maximum(p, 1e-300)), minlength=len(cells)) for p in (p2, p1)]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n, pa.int64()), *[pa.array(x, pa.float64()) for x in logs]], names=["cell", "n", "log_two", "log_one"])

    return run


def mixture_weights(cells: np.ndarray, n: np.ndarray, log_two: np.ndarray, log_one: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """(BUCKETS x 3) weights of bigram, unigram and uniform estimate by expectation-maximisation; unseen buckets share."""
    bucket = cells // (STEPS_TWO * STEPS_ONE)
    p = np.stack([np.where((cells // STEPS_ONE) % STEPS_TWO > 0, np.exp(log_two / n), 0), np.where(cells % STEPS_ONE > 0, np.exp(log_one / n), 0), np.full(len(cells), 1 / (types + 1))], axis=1) if len(cells) else np.zeros((0, 3))
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + 1e-3
        weights = total / total.sum(axis=1, keepdims=True)
    weights[0, 0] = 0  # a context never seen has no bigram estimate
    weights[0] /= weights[0].sum()
    return weights


def _score(total: int, types: int, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for blob, answers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, texts, train = _columns(blob)
                t = Tokens(texts)
                ones, twos = _known(t, answers)
                one, seen, two = ones[t.token], ones[t.context], twos[t.pair]
                w = weights[_bucket(seen)]
                p = w[:, 0] * two / np.maximum(1, seen) + w[:, 1] * one / max(1, total) + w[:, 2] / (types + 1)
                base = (one + 0.5) / (total + 0.5 * (types + 1))
                n = len(texts)
                by_doc = [np.bincount(t.owner, weights=x, minlength=n) for x in ((one > 0).astype(float), np.log10(base), np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(~train), pa.array(t.sizes, pa.int64()), pa.array(by_doc[0].astype(np.int64)), pa.array(np.full(n, total)), pa.array(by_doc[1]), pa.array(by_doc[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text under a model of the rows that aren't held_out.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): tokens are words with A-Z
    lower-cased, and one end for each text; base_score is that of add-half unigrams.

    Null and empty texts are one end; a null held_out counts as training; repeated rows count each; without
    training rows every token has the uniform estimate; an empty table gives no rows; other columns are
    ignored. docs must give the same rows in the same order when read again (a stored table does).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), ~F.coalesce(held_out, F.lit(False)).alias("train"))
    rows = rows.toDF("id", "text", "train")
    parts = ranges(rows, "text", RANGE_BYTES)
    chunks = chunked(rows, "text", CHUNK_BYTES)
    asked = from_documents(rows, "text", CHUNK_BYTES, _ask(parts), "part int, kind int, chunk long, keys binary, counts binary")
    answers = save(asked.groupBy("part", "kind").applyInArrow(_answer, "chunk long, kind int, part int, data binary, tokens long, types long"), "counts")
    total, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    told = chunks.join(answers_by_chunk(answers), "chunk", "left").select("chunk", "blob", "answers")
    cells = told.mapInArrow(_statistics(total, types), "cell int, n long, log_two double, log_one double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("log_two").alias("log_two"), F.sum("log_one").alias("log_one"))
    table = cells.orderBy("cell").toArrow()
    weights = mixture_weights(*(table.column(c).to_numpy() for c in ("cell", "n", "log_two", "log_one")), types)
    return told.mapInArrow(_score(total, types, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
