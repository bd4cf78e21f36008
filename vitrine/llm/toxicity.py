"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a hashed word vector, the mean of its hashed character 5-gram vectors and three
associations with the label (of the word, and the strongest of its 3- and 5-grams). The network reads
overlapping windows; a document scores as its highest window.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import _LOWER, NO_WORD, U64, SpanHash, as_bytes, bound_batches, release, slices

WINDOW, STRIDE = 64, 48
#: Labelled documents of each class that training may use, and how often it goes through them, whatever their number.
MOST_POSITIVE, MOST_NEGATIVE, EPOCHS = 1000, 2000, 8
WORD_BITS, GRAM_BITS, WIDTH, HIDDEN = 16, 16, 8, 16
GAIN = 4.0
_LUT = np.random.default_rng(7).integers(0, 1 << 32, (8, 256), dtype=np.uint32)


class Words:
    """The words of some texts as bucket numbers, and of each word's bytes the 3- and 5-gram buckets."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b"     ", dtype=np.uint8)].copy()
        blank = NO_WORD[data]
        data[blank] = 32
        edge = np.flatnonzero(np.diff(blank.astype(np.int8)))
        start, end = edge[0::2] + 1, edge[1::2] + 1
        ends = np.cumsum([len(t) + 1 for t in texts]) + 1
        self.counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        self.word = (SpanHash(data)(start, end) >> U64(64 - WORD_BITS)).astype(np.uint16)
        at = np.flatnonzero(~blank)
        self.length = end - start
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        last = np.repeat(end, self.length)
        near = [data[at + k] for k in range(-1, 4)]
        three = _LUT[0][near[0]] + _LUT[1][near[1]] + _LUT[2][near[2]]
        five = _LUT[3][near[0]] + _LUT[4][near[1]] + _LUT[5][near[2]] + _LUT[6][near[3]] + _LUT[7][near[4]]
        shift, odd = np.uint32(32 - GRAM_BITS), np.uint32(0x9E3779B1)
        self.three = ((three * odd) >> shift).astype(np.uint16)
        self.five = ((five * odd) >> shift).astype(np.uint16)
        self.five[at + 4 > last] = 0

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        out = cls.__new__(cls)
        for name in ("counts", "word", "length", "three", "five"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        out.first = np.concatenate([[0], np.cumsum(out.length)])
        return out

    def strongest(self, table: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(table[grams], self.first[:-1]) if len(self.word) else table[:0]

    def known(self, assoc: list[np.ndarray]) -> np.ndarray:
        """The three associations of each word."""
        return np.stack([assoc[0][self.word], self.strongest(assoc[1], self.three), self.strongest(assoc[2], self.five)], axis=1)

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words `at`: their bytes' numbers one after another, and their lengths."""
        length = self.length[at]
        return np.repeat(self.first[at] - np.cumsum(length) + length, length) + np.arange(length.sum()), length

    def inputs(self, p: dict, known: np.ndarray, at: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """A row for each of the words `at`: associations, word vector and mean of the 5-gram vectors."""
        out = np.empty((len(at), 2 * WIDTH + 3), np.float32)
        out[:, :3] = known[at]
        out[:, 3 : 3 + WIDTH] = p["words"][self.word[at]]
        for k in range(0, len(at), block):
            bytes_, length = self.bytes_of(at[k : k + block])
            total = np.add.reduceat(p["grams"][self.five[bytes_]], np.cumsum(length) - length)
            out[k : k + block, 3 + WIDTH :] = total / length[:, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and words of every window; a text without words has one empty window."""
        number = np.maximum(1, -(-(self.counts - WINDOW) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(number)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        begin = np.concatenate([[0], np.cumsum(self.counts)])[owner] + place * STRIDE
        return owner, begin, np.clip(self.counts[owner] - place * STRIDE, 0, WINDOW)


def association(features: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Correlation of a bucket's presence in a document with the label, for each bucket."""
    one, all_ = np.zeros(size), np.zeros(size)
    for ids, y in zip(features, toxic, strict=True):
        all_[ids] += 1
        if y:
            one[ids] += 1
    n, n1 = max(1, len(toxic)), max(1, int(toxic.sum()))
    n0 = max(1, n - n1)
    share = (all_ + 0.5) / (n + 1)
    return (GAIN * (one / n1 - (all_ - one) / n0) / np.sqrt(share * (1 - share)) * np.sqrt(n1 * n0) / n).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Fresh parameters; W, U, b of a direction hold update, reset and candidate side by side."""
    h, d = HIDDEN, 2 * WIDTH + 3
    p = {"words": rng.normal(0, 0.02, (1 << WORD_BITS, WIDTH)), "grams": rng.normal(0, 0.02, (1 << GRAM_BITS, WIDTH))}
    for way in ("f", "b"):
        p |= {f"W{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"U{way}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
    p |= {"A": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)), "v": rng.normal(0, h**-0.5, h), "w": rng.normal(0, (2 * h) ** -0.5, 2 * h), "bias": np.full(1, -2.0)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def forward(p: dict, x: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: inputs times W plus c, (time x window x 3 hidden) for each direction; mask: (time x window)."""
    steps, n = mask.shape
    h = HIDDEN
    states, tape = {}, {"f": [], "b": []}
    for way in ("f", "b"):
        now, u, out = np.zeros((n, h), np.float32), p[f"U{way}"], np.empty((steps, n, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = now @ u
            zr = _sigmoid(x[way][t][:, : 2 * h] + g[:, : 2 * h])
            cand = np.tanh(x[way][t][:, 2 * h :] + zr[:, h:] * g[:, 2 * h :])
            z = (1 - zr[:, :h]) * mask[t][:, None]
            if keep:
                tape[way].append((t, now, zr, cand, g[:, 2 * h :]))
            now = now + z * (cand - now)
            out[t] = now
        states[way] = out
    both = np.concatenate([states["f"], states["b"]], axis=2)
    inner = np.tanh(both @ p["A"])
    score = np.where(mask > 0, inner @ p["v"], np.float32(-30))
    weight = np.exp(score - score.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logit = pooled @ p["w"] + p["bias"][0]
    return (logit, (tape, both, inner, weight, pooled)) if keep else logit


def backward(p: dict, x: dict, mask: np.ndarray, saved, d_logit: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the dense parameters, and of x."""
    tape, both, inner, weight, pooled = saved
    h = HIDDEN
    grad = {"w": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["w"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnh,nh->tn", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["v"] = np.einsum("tn,tnk->k", d_score, inner)
    d_inner = d_score[:, :, None] * p["v"] * (1 - inner**2)
    grad["A"] = np.einsum("tnh,tnk->hk", both, d_inner)
    d_both = d_both + d_inner @ p["A"].T
    dx = {}
    for k, way in enumerate(("f", "b")):
        u, d_out = p[f"U{way}"], d_both[:, :, k * h : (k + 1) * h]
        grad[f"U{way}"], dx[way] = np.zeros_like(u), np.empty_like(x[way])
        later = np.zeros((mask.shape[1], h), np.float32)
        for t, before, zr, cand, g in reversed(tape[way]):
            d = d_out[t] + later
            live = mask[t][:, None]
            z, r = zr[:, :h], zr[:, h:]
            d_cand = d * (1 - z) * live * (1 - cand**2)
            d_z = -d * (cand - before) * live * z * (1 - z)
            d_r = d_cand * g * r * (1 - r)
            dx[way][t] = np.concatenate([d_z, d_r, d_cand], axis=1)
            d_g = np.concatenate([d_z, d_r, d_cand * r], axis=1)
            grad[f"U{way}"] += before.T @ d_g
            later = d * (1 - (1 - z) * live) + d_g @ u.T
        grad[f"c{way}"] = dx[way].sum(axis=(0, 1))
    return grad, dx


def _spread(begin: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(time x window) word numbers, `total` where a window has ended, and the mask."""
    t = np.arange(max(1, int(size.max(initial=1))))[:, None]
    mask = t < size
    return np.where(mask, begin + t, total), mask.astype(np.float32)


def logits(p: dict, inputs, begin: np.ndarray, size: np.ndarray, at_once: int = 1024, run: int = 4096) -> np.ndarray:
    """Logits of windows, in word order `run` at a time, of these windows of like length together.

    inputs(low, high) gives the rows of these words; only those of one run are held.
    """
    out = np.empty(len(begin), np.float32)
    for k in range(0, len(begin), run):
        low, high = begin[k], int((begin + size)[k : k + run].max())
        words = inputs(low, high)
        rows = {w: np.concatenate([words @ p[f"W{w}"] + p[f"c{w}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for w in "fb"}
        order = k + np.argsort(size[k : k + run], kind="stable")
        for j in range(0, len(order), at_once):
            part = order[j : j + at_once]
            where, mask = _spread(begin[part] - low, size[part], high - low)
            out[part] = forward(p, {w: rows[w][where] for w in "fb"}, mask)
    return out


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict:
    """A model {p, assoc} from labelled texts.

    Associations for training come from the half of the documents that a document isn't in, so that the
    network learns how far to trust them on new texts; the model carries those of all documents. Each epoch
    reads all windows and takes every document's highest one, and some more of clean documents, as examples of
    their label.
    """
    rng = np.random.default_rng(seed)
    docs = [Words([t]) for t in texts]
    half = np.arange(len(docs)) % 2
    seen = [[np.unique(f) for f in fs] for fs in zip(*((d.word, d.three, d.five) for d in docs), strict=True)] if docs else [[], [], []]
    sizes = (1 << WORD_BITS, 1 << GRAM_BITS, 1 << GRAM_BITS)

    def assoc_of(chosen: np.ndarray) -> list[np.ndarray]:
        tables = [association([f[i] for i in chosen], toxic[chosen], n) for f, n in zip(seen, sizes, strict=True)]
        tables[2][0] = tables[2].min(initial=0)
        return tables

    p, full = initial(rng), assoc_of(np.arange(len(docs)))
    if not toxic.any() or toxic.all():
        p["w"][:] = 0
        p["bias"][:] = 4.0 if toxic.any() else -4.0
        return {"p": p, "assoc": full}
    other = [assoc_of(np.flatnonzero(half != k)) for k in (0, 1)]
    all_words = Words.joined(docs)
    del docs
    owner, begin, size = all_words.windows()
    doc_of_word = np.repeat(np.arange(len(texts)), all_words.counts)
    fixed = np.where((half[doc_of_word] == 0)[:, None], *[all_words.known(o) for o in other])
    del doc_of_word, other, seen

    def inputs(low: int, high: int) -> np.ndarray:
        return all_words.inputs(p, fixed, np.arange(low, high))

    dense = [k for k in p if k not in ("words", "grams")]
    first, second = ({k: np.zeros_like(p[k]) for k in dense} for _ in range(2))
    squares = {k: np.full(len(p[k]), 1e-6, np.float32) for k in ("words", "grams")}
    step = 0
    for _ in range(epochs):
        score = logits(p, inputs, begin, size, run=1024)
        best = np.lexsort((score, owner))
        best = best[np.append(owner[best][1:] != owner[best][:-1], True)]
        clean = np.flatnonzero(toxic[owner] == 0)
        chosen = np.concatenate([best, rng.choice(clean, min(len(clean), len(texts) // 3), replace=False)])
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            part = chosen[k : k + batch]
            where, mask = _spread(begin[part], size[part], 0)
            live = mask > 0
            words = np.zeros((*mask.shape, 2 * WIDTH + 3), np.float32)
            words[live] = all_words.inputs(p, fixed, where[live])
            x = {w: words @ p[f"W{w}"] + p[f"c{w}"] for w in "fb"}
            logit, saved = forward(p, x, mask, keep=True)
            grad, dx = backward(p, x, mask, saved, (_sigmoid(logit) - toxic[owner[part]].astype(np.float32)) / len(part))
            d_words = np.zeros_like(words)
            for w in "fb":
                grad[f"W{w}"] = np.einsum("tnd,tng->dg", words, dx[w])
                d_words += dx[w] @ p[f"W{w}"].T
            step += 1
            for name in dense:
                first[name] += 0.1 * (grad[name] - first[name])
                second[name] += 0.001 * (grad[name] ** 2 - second[name])
                p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            at, d = where[live], d_words[live]
            byte, length = all_words.bytes_of(at)
            for name, ids, g in (("words", all_words.word[at], d[:, 3 : 3 + WIDTH]), ("grams", all_words.five[byte], np.repeat(d[:, 3 + WIDTH :] / length[:, None], length, axis=0))):
                if not len(ids):
                    continue
                order = np.argsort(ids, kind="stable")
                head = np.flatnonzero(np.diff(ids[order].astype(np.int32), prepend=-1))
                rows, total = ids[order][head], np.add.reduceat(g[order], head)
                squares[name][rows] += (total**2).mean(axis=1)
                p[name][rows] -= (0.02 * total / np.sqrt(squares[name][rows])[:, None]).astype(np.float32)
    return {"p": p, "assoc": full}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """Score of each text: the logistic of its highest window."""
    words = Words(texts)
    owner, begin, size = words.windows()
    known = words.known(model["assoc"])
    got = logits(model["p"], lambda low, high: words.inputs(model["p"], known, np.arange(low, high)), begin, size).astype(np.float64)
    return 1 / (1 + np.exp(-np.maximum.reduceat(got, np.searchsorted(owner, np.arange(len(texts))))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> dict:
    """Train on the texts of at most `most_positive` and `most_negative` labelled ids, chosen by a hash of the id, in one task.

    Labels of null or without a document are left out; of several labels of an id the highest counts, of
    several texts the first in order; null texts count as empty. Without rows of both labels the score is
    constant: near 1 if all are positive, else near 0. Scores are set to the shares of all labels.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    shift = _prior_shift(known.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)).first(), most_positive, most_negative)
    known = known.orderBy(F.xxhash64("id", F.lit(5)), "id")
    chosen = known.where("y = 1").limit(most_positive).unionByName(known.where("y <> 1").limit(most_negative))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y", "id")
    got = rows.coalesce(1).sortWithinPartitions(F.xxhash64("id", F.lit(5)), "id").mapInArrow(_trained, "model binary").first()
    model = pickle.loads(got.model) if got else train([], np.zeros(0, np.int64))
    model["p"]["bias"] += shift
    return model


def _prior_shift(counts, most_positive: int, most_negative: int) -> np.float32:
    """What turns log odds learned on the chosen labels into those at the shares of all labels."""
    positive, negative = (max(1, n) for n in counts)
    return np.float32(np.log(positive / negative) - np.log(min(positive, most_positive) / min(negative, most_negative)))


def _trained(batches):
    """One row: the model of all rows (text, y), a bounded number, in this task."""
    texts, labels = [], []
    for batch in batches:
        texts += [b"" if t is None else t.encode() for t in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(labels, dtype=np.int64)))], pa.binary())], names=["model"])
    del texts, labels
    release()


def with_score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with their score: all windows of the whole text are read.

    Null and empty texts get the network's score of no words; each row is scored by its own text, repeated and
    null ids too; an empty table gives no rows; an input column of the score's name is replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
            for a, b in slices(sizes, 1 << 18):
                part = batch.slice(a, b - a)
                scores = score_texts(shared.value, as_bytes(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*batch.schema.names, name])
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, as with_score gives it; a null id stays null; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select(F.col("id").alias(id_col), "score")
