"""Packing of tokenised documents into fixed-length training sequences by bounded-space best fit."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import release, save, slices

#: Tokens that one packing task takes, and the bins that it holds open.
TASK_TOKENS, OPEN_BINS = 1 << 24, 4096
#: Words, and parts of each of two generations, that a Python worker remembers (about 200 bytes each).
CACHE_WORDS, CACHE_PARTS = 100_000, 250_000
_LOADED: dict = {}

# The steps of a tokenizer, as its file lists them, under which words can be encoded one by one.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_CONTROL = re.compile("[\x1c-\x1f]")
# Letters, numbers and white space among the first 384 characters, and these characters without those that the steps above
# treat in ways of their own: U+001C-U+001F, and U+0130, whose lower case is two characters.
_L, _N, _S = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_LATIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u017f]*")
#: The split of WORD_STEPS for lower-cased texts of these characters; no two branches but those at an apostrophe begin alike.
_PART = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")
#: Letters that stay single letters in lower case (U+0130 doesn't), then marks that no letter joins.
_PLAIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?]+)")


def _byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in byte-level models: visible characters stand for themselves, the others follow from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + n for n, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class WordTokens:
    """Token ids of texts, as little-endian 32-bit bytes, equal to the tokenizer's own.

    Where the tokenizer takes the steps of WORD_STEPS, white space always ends a token, so a text's ids are
    those of its words in a row. Texts of Latin letters are split as the tokenizer splits them and their parts
    looked up; of others, the words; parts and words of two generations are remembered. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        spaced = any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in steps["added_tokens"])
        self.by_word = all(steps[k] == v for k, v in WORD_STEPS.items()) and not spaced
        self.words: dict[str, bytes] = {}  # of words, and of the parts of words that were cut
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # parts of the generation before
        self.literals = tuple(t["content"] for t in steps["added_tokens"])

    def _all(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, part: str) -> bytes:
        got = self.words.get(part)
        if got is None:
            got = self.words[part] = np.array([k.id for k in self.whole.model.tokenize(part)], dtype="<u4").tobytes() if part.isascii() and part.isalpha() and part.islower() else self._all(part)
        return got

    def _learn(self, words: list[str]) -> list[bytes]:
        out, known = [], self.words
        for w in words:
            got = known.get(w)
            if got is None:
                cut = _PLAIN_WORD.fullmatch(w)
                if cut and len(w) < 256:
                    got = self._encode(cut[1].lower() if cut[1].isascii() else cut[1]) + self._encode(cut[2])
                    known[w] = got
                else:
                    got = self._encode(w.lower() if w.isascii() and w.isalpha() else w)
                    known[w] = got
            out.append(got)
        return out

    def _parts(self, text: str) -> bytes:
        found = _PART.findall(text.lower())
        try:
            return b"".join([self.parts[p] for p in found])
        except KeyError:
            pass
        out = []
        for p in found:
            got = self.parts.get(p)
            if got is None:
                if len(self.parts) >= CACHE_PARTS:
                    self.older, self.parts = self.parts, {}
                got = self.parts[p] = self.older.get(p) or self._encode_part(p)
            out.append(got)
        return b"".join(out)

    def _encode_part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return np.array([k.id for k in self.whole.model.tokenize(mapped)], dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.by_word and _LATIN.fullmatch(text) and not any(t in text for t in self.literals):
            return self._parts(text)
        if not self.by_word or _CONTROL.search(text):  # Python alone takes these for white space
            return self._all(text)
        words = text.split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            return b"".join(self._learn(words))


def _pieces(path: str, length: int, end_id: int):
    """Rows (document, piece, start, length, checksum) of each text's ids, cut every `length` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            tokens = _LOADED.get(path) or _LOADED.setdefault(path, WordTokens(path))
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, 1 << 22):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids = (tokens(text) if text else b"") + end
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return run


class BestFit:
    """Online best fit over at most `most` open bins of `room`, found by a bitset keyed by free space."""

    def __init__(self, room: int, most: int, first: int):
        self.room, self.most, self.next = room, most, first
        self.levels: list[list[int]] = [[] for _ in range(room + 1)]
        self.bits = self.open = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset): the open bin that the item fills best, else a new bin."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = self.levels[free]
            which = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            if self.open >= self.most:
                least = (self.bits & -self.bits).bit_length() - 1
                self.levels[least].pop()
                if not self.levels[least]:
                    self.bits ^= 1 << least
                self.open -= 1
            which, free = self.next, self.room
            self.next += 1
        left = free - size
        if left:
            self.levels[left].append(which)
            self.bits |= 1 << left
            self.open += 1
        return which, self.room - free


def _pack(room: int, most: int):
    """Place one partition's pieces; sequence numbers are the partition's number and a running one."""

    def run(batches):
        from pyspark import TaskContext

        bins = BestFit(room, most, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces of `length`."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_pieces(tokenizer_path, length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Place every document's token pieces in sequences of at most `length` tokens, one row per piece.

    Only documents of more than `length` ids are cut. Pieces are dealt to as many tasks as `task_tokens`
    asks for; each packs its share longest first, online, with `open_bins` open sequences, of which the
    fullest closes when another is needed. Sequences hold pieces of one task only, so each task leaves at
    most one under-filled tail of open bins, whatever the size of the input. Ids are the tokenizer's own,
    literals of its added tokens included.

    Null or empty texts are the end id alone; repeated ids or rows give their own pieces; a null id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    pieces = save(token_pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32") % (64 * tasks)).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(_pack(length, open_bins), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
