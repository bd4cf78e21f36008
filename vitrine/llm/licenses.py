"""License scans: a set-similarity join of text blocks with license templates, by containment.

Blocks are windows of words of three widths, each begun at half of the one before, so that any passage of half a
width lies whole in one. A template belongs to the least width that is twice its words or more. The words of all
templates are ordered by the number of documents that hold them, rarest first, counted over the whole corpus. A
block of which a template's share is to be found must have, among its first words in that order, one of the
template's first words (prefix filter), enough words (length filter), and enough words left after the shared one in
both (positional filter). Blocks that pass the prefix filter are joined with the templates' prefixes on the word, and
what the other filters leave is verified on whole sets. The order decides the work, never the result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import NO_WORD, few, int64, release, save, text_rows, word_hashes

#: Words of a block of each kind.
WIDTHS = (16, 64, 256)


@dataclass(frozen=True)
class Template:
    """A notice's words; `required` ones must all be there, none of `without`."""

    label: str
    text: str
    required: str = ""
    without: str = ""

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.text.split()))

    @property
    def width(self) -> int:
        return next(w for w in WIDTHS if 2 * len(self.text.split()) <= w)


# Wording of common license notices, lower case, without marks.
TEMPLATES = (
    Template("mit", "under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "granted software"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache 2"),
    Template("gpl-2", "gnu general public license version 2", "gnu general public 2", "lesser affero"),
    Template("gpl-3", "gnu general public license version 3", "gnu general public 3", "lesser affero"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser public"),
    Template("agpl", "gnu affero general public license", "gnu affero public"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution permitted"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission distribute fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative noncommercial"),
    Template("cc0", "creative commons zero public domain dedication", "creative zero"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "unauthorized prohibited"),
)
# Phrases that mean a license wherever their words stand one after another.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes([" ".join(words).encode()], NO_WORD)[0]


class Vocabulary:
    """The templates' words and their hashes; tokens are places in `words`."""

    def __init__(self, templates):
        self.words = sorted({w for t in templates for part in (t.text, t.required, t.without) for w in part.split()})
        hashes = _hashes(self.words)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.token = {w: i for i, w in enumerate(self.words)}

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The token of each hash, -1 for other words."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _counts(vocabulary: Vocabulary):
    """mapInArrow over (id, text): documents of the task that hold each token."""

    def run(batches):
        total = np.zeros(len(vocabulary.words), dtype=np.int64)
        for _, texts in text_rows(batches):
            hashes, sizes = word_hashes(texts, NO_WORD)
            tokens = vocabulary.tokens(hashes)
            text = np.repeat(np.arange(len(texts)), sizes)[tokens >= 0]
            total += np.bincount(np.unique(text * len(total) + tokens[tokens >= 0]) % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([int64(np.arange(len(total))), int64(total)], names=["token", "n"])
        release()

    return run


def _places(hashes: np.ndarray, bounds: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word number) of the places where a phrase stands."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return bounds[:0], bounds[:0]
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[hashes[at + j] == phrase[j]]
    text = np.searchsorted(bounds, at, side="right") - 1
    inside = at + len(phrase) <= bounds[text + 1]
    return text[inside], at[inside] - bounds[text[inside]]


_BLOCK = pa.struct([("start", pa.int64()), ("width", pa.int32()), ("tokens", pa.list_(pa.int32()))])


def _scanned(vocabulary: Vocabulary, rank: np.ndarray, phrases, first: dict[int, np.ndarray], need: dict[int, int]):
    """mapInArrow over (id, text): counts, places of the phrases, and the blocks that have a prefix token of a template.

    rank: of each token; first: by width, which tokens are in a prefix; need: by width, the least words that any template needs.
    """

    def blocks_of(tokens: np.ndarray) -> list[dict]:
        out = []
        for width in need:
            half = width // 2
            hit = np.flatnonzero((tokens >= 0) & first[width][tokens])
            for k in np.unique(np.concatenate([hit // half, hit // half - 1])).tolist():
                if k < 0:
                    continue
                own = tokens[k * half : k * half + width]
                own = np.unique(own[own >= 0])
                own = own[np.argsort(rank[own])]
                if len(own) >= need[width] and first[width][own[: len(own) - need[width] + 1]].any():
                    out.append({"start": k * half, "width": width, "tokens": own.tolist()})
        return out

    def run(batches):
        for ids, texts in text_rows(batches):
            hashes, sizes = word_hashes(texts, NO_WORD)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            tokens = vocabulary.tokens(hashes)
            n, low, high = np.zeros(len(texts), np.int64), np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
            labels: list[set] = [set() for _ in texts]
            for label, phrase in phrases:
                text, at = _places(hashes, bounds, phrase)
                np.add.at(n, text, 1)
                np.minimum.at(low, text, at)
                np.maximum.at(high, text, at)
                for i in np.unique(text).tolist():
                    labels[i].add(label)
            spans = [blocks_of(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex for _ in texts]), pa.array(ids, pa.int64()), int64(sizes.astype(np.int64)), int64(n), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(spans, pa.list_(_BLOCK))],
                names=["row", "id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
            )
        release()

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """For each row its id, n_words, n_base, first_word, last_word, base (labels of phrases), found and score.

    Words are runs of letters, digits and whatever isn't ASCII, A-Z lower-cased. n_base counts the places where a phrase's
    words stand one after another, first_word and last_word are their smallest and largest start, null without any.
    found: for each label of a template that a block holds to `threshold` or more of its distinct words, with all required
    and none of the excluded ones, the label, the highest containment and the first word of the first such block; by label. score: the
    highest containment of all, 0 without.

    Null, empty and wordless texts have no words, places or labels. Rows are judged by themselves: repeated ids and rows
    give repeated results, null ids are kept. Only the id and the text are read. Templates and phrases are few, a parameter: their
    words are kept in memory. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    vocabulary = Vocabulary(templates)
    counted = rows.mapInArrow(_counts(vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row for each template word
    held = np.zeros(len(vocabulary.words), dtype=np.int64)
    for r in counted:
        held[r.token] = r.n
    rank = np.empty(len(held), dtype=np.int64)
    rank[np.lexsort((np.arange(len(held)), held))] = np.arange(len(held))
    token_list = lambda text: sorted((vocabulary.token[w] for w in text.split()), key=lambda t: rank[t])
    made, need = [], {}
    first = {w: np.zeros(len(held) + 1, dtype=bool) for w in WIDTHS}  # the last place answers for token -1
    for t in templates:
        tokens = token_list(" ".join(t.words))
        least = math.ceil(threshold * len(tokens) - 1e-9)
        first[t.width][tokens[: len(tokens) - least + 1]] = True
        need[t.width] = min(need.get(t.width, least), least)
        made.append((t.label, t.width, tokens, least, token_list(t.required), token_list(t.without)))
    phrase_hashes = [(label, _hashes(text.split())) for label, text in phrases]
    scanned = save(rows.mapInArrow(_scanned(vocabulary, rank, phrase_hashes, first, need), "row string, id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<start:long,width:int,tokens:array<int>>>"), "licenses")

    known = spark.createDataFrame(made, "label string, width int, words array<int>, need int, required array<int>, without array<int>")
    prefixes = known.select("*", F.posexplode(F.expr("slice(words, 1, size(words) - need + 1)")).alias("place", "token"))
    blocks = scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.start", "b.width", "b.tokens")
    least = F.lit(min(need.values(), default=1))
    starts = blocks.select("*", F.posexplode(F.slice("tokens", 1, F.size("tokens") - least + 1)).alias("at", "token"))
    size, words = F.size("tokens"), F.size("words")
    able = (size >= F.col("need")) & (F.col("at") <= size - F.col("need")) & (1 + F.least(size - F.col("at") - 1, words - F.col("place") - 1) >= F.col("need"))
    both = F.size(F.array_intersect("tokens", "words"))
    holds = (both >= F.col("need")) & (F.size(F.array_except("required", "tokens")) == 0) & ~F.arrays_overlap("without", "tokens")
    matched = starts.join(few(prefixes), ["width", "token"]).where(able).where(holds)
    per_label = matched.groupBy("row", "label").agg(F.max(both / words).alias("containment"), F.min("start").alias("start"))
    found = per_label.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "containment", "start"))).alias("found"), F.max("containment").alias("score"))
    empty = F.array().cast("array<struct<label:string,containment:double,start:bigint>>")
    return scanned.join(found, "row", "left").select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("found", empty).alias("found"), F.coalesce("score", F.lit(0.0)).alias("score"))


def sql(templates: tuple[Template, ...] = TEMPLATES, phrases=PHRASES, percent: int = 80) -> str:
    """The query's rows in DuckDB: every block against every template of its width."""
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]::VARCHAR[]"
    t = ", ".join(f"('{t.label}', {t.width}, {listed(' '.join(t.words))}, {listed(t.required)}, {listed(t.without)})" for t in templates)
    p = ", ".join(f"('{label}', {listed(text)})" for label, text in phrases)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT * FROM (VALUES {t}) v(label, width, words, required, excluded)),
p AS (SELECT * FROM (VALUES {p}) v(label, words)),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
base AS (SELECT d.r, count(*) AS n, min(w.i) AS a, max(w.i) AS z, list(DISTINCT p.label) AS labels FROM w JOIN p ON p.words[1] = w.word JOIN d ON d.r = w.r AND list_slice(d.ws, w.i + 1, w.i + len(p.words)) = p.words GROUP BY d.r),
k AS (SELECT r, width, list_distinct(list_slice(ws, s * (width // 2) + 1, s * (width // 2) + width)) AS ws FROM (SELECT r, ws, width, unnest(range(0, (len(ws) + width // 2 - 1) // (width // 2))) AS s FROM d, (SELECT DISTINCT width FROM t))),
m AS (SELECT k.r, t.label, len(list_intersect(k.ws, t.words)) / len(t.words) AS c FROM k JOIN t ON t.width = k.width AND len(k.ws) * 100 >= len(t.words) * {percent} WHERE 100 * len(list_intersect(k.ws, t.words)) >= {percent} * len(t.words) AND list_has_all(k.ws, t.required) AND NOT list_has_any(k.ws, t.excluded)),
f AS (SELECT r, max(c) AS score, list(DISTINCT label) AS labels FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.z AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(f.labels, [])))), ',') AS labels, coalesce(f.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN f USING (r)"""
