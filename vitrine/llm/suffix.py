"""Removal of repeated byte strings: sampled suffixes, deep-shallow sorted with common-prefix lengths.

A repeated string of `span` bytes holds, at the same place in each copy, its least-hash k-gram, so it is
enough to compare the surroundings of such anchors. Anchors of equal k-gram whose whole surroundings are
equal settle by digest; one copy of every other surrounding is sorted, rightwards and leftwards, and common
prefix lengths on both sides tell which windows over the anchor occur twice.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.chunks import answers_by_chunk, chunked, decode, from_documents, pack_array, pack_sorted, range_bounds, ranges, text_buffer, unpack_array, unpack_sorted
from vitrine.llm.common import U64, SpanHash, as_bytes, few, int64, mix, release, save

GRAM, SHALLOW = 40, 24
RANGE_BYTES, CHUNK_BYTES = 16 << 20, 1_000_000
#: Different surroundings of one k-gram beyond which windows are counted across tasks instead of sorted in one.
HOT = 50_000
COVERED, SHIP = 2, 1


def _sliding(values: np.ndarray, width: int, of: np.ufunc, pad) -> np.ndarray:
    """`of` (minimum or maximum) over every run of `width` values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.concatenate([values, np.full(-n % width, pad, dtype=values.dtype)]).reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).reshape(-1)
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return of(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], span: int, gram: int) -> dict[str, np.ndarray]:
    """Anchor positions in the joined texts with key, surroundings' bounds and digest, ordered by key and digest.

    Anchors have the least hashes of their windows, so the key is mixed once more: else all fall into the lowest range.
    """
    data, begins = text_buffer(texts)
    n = len(data)
    top = np.iinfo(np.uint32).max
    if n < span:
        at = np.zeros(0, np.int64)
        return {"at": at, "key": at.view(U64), "lo": at, "hi": at, "digest": at.view(U64)}
    hashed = SpanHash(data)
    key = hashed.every(gram)
    value = np.minimum((key >> U64(32)).astype(np.uint32), top - 1)
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):  # k-grams over an end, and short texts
        value[end - gram + 1 if end - begin >= span else begin : end] = top
    width = span - gram + 1
    least = _sliding(value, width, np.minimum, top)
    around = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    at = np.flatnonzero((_sliding(around, width, np.maximum, 0) == value) & (value != top))
    owner = np.searchsorted(begins, at, side="right") - 1
    lo = np.maximum(begins[owner], at - (span - gram))
    hi = np.minimum(begins[owner + 1], at + span)
    digest = hashed(lo, hi) + (at - lo).astype(U64) * U64(0x9E3779B97F4A7C15)
    key = mix(key[at] ^ U64(0x5851F42D4C957F2D))
    order = np.lexsort((digest, key))
    return {"at": at[order], "key": key[order], "lo": lo[order], "hi": hi[order], "digest": digest[order]}


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _ask(text_at: int, span: int, gram: int, parts: int):
    """Requests of each chunk: its different (key, digest) pairs with their counts."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = anchors(as_bytes(decode(blob).column(text_at).to_pylist()), span, gram)
                head = np.flatnonzero(_heads(found["key"], found["digest"]))
                key, digest = found["key"][head], found["digest"][head]
                counts = np.minimum(np.diff(np.append(head, len(found["key"]))), 2).astype(np.uint8)
                bounds = range_bounds(key, parts)
                used = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                cut = [slice(bounds[p], bounds[p + 1]) for p in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([chunk] * len(used), pa.int64()),
                        pa.array([pack_sorted(key[c]) for c in cut], pa.binary()),
                        pa.array([pack_array(digest[c]) for c in cut], pa.binary()),
                        pa.array([pack_array(counts[c]) for c in cut], pa.binary()),
                    ],
                    names=["part", "chunk", "keys", "digests", "counts"],
                )

    return run


def _answer(key, table):
    """For each request, a code per pair: COVERED if the same surroundings occur twice, SHIP for one copy of each of several."""
    table = table.sort_by("chunk")
    keys = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    digests = np.concatenate([unpack_array(b, U64) for b in table.column("digests").to_pylist()])
    counts = np.concatenate([unpack_array(b, np.uint8) for b in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.lexsort((digests, keys))
    k, d, c = keys[order], digests[order], counts[order]
    new_key, new_pair = _heads(k), _heads(k, d)
    pair = np.cumsum(new_pair) - 1
    total = np.bincount(pair, weights=c)[pair]
    several = (np.bincount(np.cumsum(new_key) - 1, weights=new_pair) > 1)[np.cumsum(new_key) - 1]
    codes = np.empty(len(keys), np.uint8)
    codes[order] = np.where(total >= 2, COVERED, 0) | np.where(several & new_pair, SHIP, 0)
    cut = np.split(codes, np.cumsum(sizes)[:-1])
    n = len(sizes)
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * n, pa.int32()), "part": table.column("part"), "data": pa.array([pack_array(x) for x in cut], pa.binary())})


def _codes(answers: list) -> np.ndarray:
    """The chunk's codes in its own order; answers to repeated requests are merged."""
    by_part: dict[int, np.ndarray] = {}
    for a in answers or []:
        got = unpack_array(a["data"], np.uint8)
        by_part[a["part"]] = by_part[a["part"]] | got if a["part"] in by_part else got
    return np.concatenate([by_part[p] for p in sorted(by_part)]) if by_part else np.zeros(0, np.uint8)


def _known(texts: list[bytes], answers: list, span: int, gram: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Anchors, the first of each different pair, and the pair's code."""
    found = anchors(texts, span, gram)
    head = np.flatnonzero(_heads(found["key"], found["digest"]))
    codes = _codes(answers)
    if len(codes) != len(head):
        raise RuntimeError("a chunk was read again with other rows; store the documents first")
    return found, head, codes


def _ship(text_at: int, span: int, gram: int):
    """One copy of the surroundings of each pair marked SHIP."""

    def run(batches):
        for batch in batches:
            for chunk, blob, answers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                texts = as_bytes(decode(blob).column(text_at).to_pylist())
                found, head, codes = _known(texts, answers, span, gram)
                data = b"".join(texts)
                pick = np.flatnonzero(codes & SHIP)
                at, lo, hi = (found[c][head[pick]].tolist() for c in ("at", "lo", "hi"))
                yield pa.RecordBatch.from_arrays(
                    [
                        int64(found["key"][head[pick]]),
                        pa.array([chunk] * len(pick), pa.int64()),
                        pa.array(pick.astype(np.int32)),
                        pa.array((codes[pick] & COVERED) > 0),
                        pa.array([data[a:b] for a, b in zip(lo, at, strict=True)], pa.binary()),
                        pa.array([data[a:b] for a, b in zip(at, hi, strict=True)], pa.binary()),
                    ],
                    names=["key", "chunk", "pair", "covered", "before", "after"],
                )

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of strings that share `depth` bytes, by a trie that keeps branching places only.

    A node is [place, children by next byte]; a leaf is a list of equal strings' numbers under place -1.
    Each string walks down without reading what nodes skip, is compared once with the leaf it meets, and
    branches off where the two part.
    """
    root: list = [-1, [group[0]]]
    for i in group[1:]:
        s = strings[i]
        path, node = [], root
        while node[0] >= 0:
            path.append(node)
            node = node[1].get(s[node[0] : node[0] + 1]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        part = common_prefix(s, other, depth)
        if part == len(s) == len(other):
            node[1].append(i)
            continue
        leaf = [-1, [i]]
        above, node = None, root
        for step in path:
            if step[0] >= part:
                break
            above, node = step, step[1].get(s[step[0] : step[0] + 1])
        if node is not None and node[0] == part:
            node[1][s[part : part + 1]] = leaf
            continue
        fork = [part, {other[part : part + 1]: node, s[part : part + 1]: leaf}]
        if above is None:
            root = fork
        else:
            above[1][s[above[0] : above[0] + 1]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW, step: int = 8) -> list[int]:
    """Order of the strings: multikey quicksort by `step` bytes down to `shallow`, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += _blind_trie(strings, group, depth)
        else:
            keys = [strings[i][depth : depth + step] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, same, more = [], [], []
            for i, k in zip(group, keys, strict=True):
                (same if k == pivot else less if k < pivot else more).append(i)
            below = depth + step if len(pivot) == step else shallow  # a shorter pivot ends: its strings are equal
            stack += [(more, depth), (same, below), (less, depth)]
    return out


def _ranks(strings: list[bytes], skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and common prefix with the one before, less `skip`; negative for the first."""
    order = deep_shallow_sort(strings)
    lcp = [-1] + [common_prefix(strings[a], strings[b]) - skip for a, b in zip(order, order[1:])]  # noqa: B905
    return np.array(order, dtype=np.int64), np.array(lcp[: len(order)], dtype=np.int64)


def repeated_windows(keys: list[bytes], before: list[bytes], after: list[bytes], span: int, gram: int) -> np.ndarray:
    """Matrix (offset x surrounding): whether the `span`-byte window that begins `offset` before the anchor occurs with another."""
    n = len(keys)
    right, right_lcp = _ranks([k + x for k, x in zip(keys, after, strict=True)], 8)
    left, left_lcp = _ranks([k + x[::-1] for k, x in zip(keys, before, strict=True)], 8)
    room_left, room_right = (np.array([len(x) for x in side]) for side in (before, after))
    out = np.zeros((span - gram + 1, n), dtype=bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(span - gram + 1):
        a[left] = np.cumsum(left_lcp < o)
        b[right] = np.cumsum(right_lcp < span - o)
        fits = np.flatnonzero((room_left >= o) & (room_right >= span - o))
        if len(fits) > 1:
            _, inverse, counts = np.unique(a[fits] * (n + 1) + b[fits], return_inverse=True, return_counts=True)
            out[o, fits] = counts[inverse] > 1
    return out


def _compare(span: int, gram: int):
    """Runs of repeated window offsets of each surrounding in one range of keys."""

    def run(key, table):
        keys = [k.to_bytes(8, "big", signed=True) for k in table.column("key").to_pylist()]
        hit = repeated_windows(keys, table.column("before").to_pylist(), table.column("after").to_pylist(), span, gram)
        hit[:, table.column("covered").to_numpy()] = False
        edge = np.diff(np.concatenate([np.zeros((1, hit.shape[1]), np.int8), hit.astype(np.int8), np.zeros((1, hit.shape[1]), np.int8)]), axis=0).T
        which, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        return pa.table({"chunk": table.column("chunk").to_numpy()[which], "pair": table.column("pair").to_numpy()[which], "first": pa.array(first, pa.int32()), "last": pa.array(last - 1, pa.int32())})

    return run


def _windows(span: int, gram: int):
    """Every window over the anchor as a digest; for k-grams with very many surroundings."""

    def run(batches):
        for batch in batches:
            for key, chunk, pair, covered, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, at = before + after, len(before)
                offsets = [o for o in range(span - gram + 1) if o <= at and span - o <= len(after)]
                marks = [blake2b(whole[at - o : at - o + span], digest_size=16, salt=o.to_bytes(8, "big"), key=key.to_bytes(8, "big", signed=True)).digest() for o in offsets]
                n = len(marks)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([pair] * n, pa.int32()), pa.array([covered] * n), pa.array(offsets, pa.int32()), pa.array(marks, pa.binary())], names=["chunk", "pair", "covered", "offset", "mark"])

    return run


def _remove(text_at: int, span: int, gram: int, whole_chars: bool, made_names: tuple[str, str]):
    def run(batches):
        for batch in batches:
            for blob, answers, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rows = decode(blob)
                texts = as_bytes(rows.column(text_at).to_pylist())
                found, head, codes = _known(texts, answers, span, gram)
                data, begins = text_buffer(texts)
                change = np.zeros(len(data) + 1, np.int64)
                pair = np.cumsum(_heads(found["key"], found["digest"])) - 1
                sure = ((codes[pair] & COVERED) > 0) & (found["hi"] - found["lo"] >= span)
                np.add.at(change, found["lo"][sure], 1)
                np.add.at(change, found["hi"][sure], -1)
                if runs:
                    which, first, last = (np.array([r[c] for r in runs]) for c in ("pair", "first", "last"))
                    at = found["at"][head[which]]
                    np.add.at(change, at - last, 1)
                    np.add.at(change, at - first + span, -1)
                gone = np.cumsum(change[:-1]) > 0
                fresh = np.zeros(len(data) + 1, dtype=bool)
                fresh[begins] = True
                start = np.flatnonzero(gone & (fresh[:-1] | ~np.concatenate([[False], gone[:-1]])))
                end = np.flatnonzero(gone & (fresh[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                if whole_chars and len(start):
                    inside = np.append((data & 0xC0) == 0x80, False)
                    while (x := inside[start] & (start < end)).any():
                        start = start + x
                    while (x := inside[end] & (start < end)).any():
                        end = end - x
                    start, end = start[start < end], end[start < end]
                owner = np.searchsorted(begins, start, side="right") - 1
                spans: list[list] = [[] for _ in texts]
                for o, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
                    spans[o].append((a - int(begins[o]), b - int(begins[o])))
                kept = []
                for text, cut in zip(texts, spans, strict=True):
                    parts, at = [], 0
                    for a, b in cut:
                        parts.append(text[at:a])
                        at = b
                    kept.append(b"".join([*parts, text[at:]]))
                names = [*rows.schema.names, *made_names]
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                made = pa.RecordBatch.from_arrays([*rows.columns, pa.array(kept, pa.binary()), pa.array([[{"begin": a, "end": b} for a, b in cut] for cut in spans], kind)], names=names)
                for a in range(0, made.num_rows, 1000):
                    yield made.slice(a, 1000)

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", span: int = 200, gram: int = GRAM, whole_chars: bool = False, hot: int = HOT, kept_col: str = "kept", spans_col: str = "spans") -> DataFrame:
    """All rows and columns of docs with the remaining bytes (kept_col) and the removed runs in bytes of the input (spans_col).

    Removed is each byte of the UTF-8 text that a `span`-byte string covers which also starts anywhere else, in
    the same text or another. With whole_chars a run shrinks to whole characters, so that what is left decodes.

    Null texts count as empty; shorter texts keep all; repeated rows count as copies; an empty table gives no
    rows. docs must give the same rows in the same order when read again (a stored table does). Input columns
    named as the two made here are replaced, others of any name are kept.
    """
    docs = docs.drop(kept_col, spans_col)
    parts, at = ranges(docs, text_col, RANGE_BYTES), docs.columns.index(text_col)
    chunks = chunked(docs, text_col, CHUNK_BYTES)
    asked = from_documents(docs, text_col, CHUNK_BYTES, _ask(at, span, gram, parts), "part int, chunk long, keys binary, digests binary, counts binary")
    answers = save(answers_by_chunk(asked.groupBy("part").applyInArrow(_answer, "chunk long, kind int, part int, data binary")), "codes")
    told = chunks.join(answers, "chunk", "left").select("chunk", "blob", "answers")
    shipped = save(told.mapInArrow(_ship(at, span, gram), "key long, chunk long, pair int, covered boolean, before binary, after binary"), "surroundings")
    often = few(save(shipped.groupBy("key").count().where(F.col("count") > hot).select("key"), "often"))
    runs = shipped.join(often, "key", "left_anti").groupBy(F.pmod(F.xxhash64("key"), F.lit(4 * parts))).applyInArrow(_compare(span, gram), "chunk long, pair int, first int, last int")
    if not often.isEmpty():
        wide = shipped.join(often, "key", "left_semi").mapInArrow(_windows(span, gram), "chunk long, pair int, covered boolean, offset int, mark binary")
        twice = wide.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
        runs = runs.unionByName(wide.where("not covered").join(twice, "mark").select("chunk", "pair", F.col("offset").alias("first"), F.col("offset").alias("last")))
    runs = save(runs.groupBy("chunk").agg(F.collect_list(F.struct("pair", "first", "last")).alias("runs")), "runs")
    schema = T.StructType([*docs.schema.fields, T.StructField(kept_col, T.BinaryType()), T.StructField(spans_col, T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])
    return told.join(runs, "chunk", "left").select("chunk", "blob", "answers", "runs").mapInArrow(_remove(at, span, gram, whole_chars, (kept_col, spans_col)), schema)
