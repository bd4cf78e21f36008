import random
import re

import duckdb
import pytest

from vitrine.llm import licenses, queries
from vitrine.llm.common import save
from vitrine.llm.licenses import PHRASES, TEMPLATES, WIDTHS, scan_licenses

NOTES = [t.text for t in TEMPLATES] + ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License", "CC-BY-NC 4.0", "GNU Lesser General Public License, version 3", "gnu gnu general public license version 3", "All rights are reserved"]


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(text, threshold=0.8):
    ws = [w.decode() for w in words_of(text)]
    places = [(i, label) for label, p in PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found = {}
    for t in TEMPLATES:
        for s in range(0, len(ws), t.width // 2):
            block = set(ws[s : s + t.width])
            part = len(block & set(t.words)) / len(t.words)
            if part >= threshold - 1e-12 and set(t.required.split()) <= block and not set(t.without.split()) & block:
                old = found.get(t.label, (0.0, s))
                found[t.label] = (max(part, old[0]), min(s, old[1]))
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), sorted((k, *v) for k, v in found.items()), max((v[0] for v in found.values()), default=0.0)


def samples():
    r = random.Random(4)
    vocabulary = sorted({w for t in TEMPLATES for w in t.words}) + [f"w{i}" for i in range(60)] + ["ÜBER", "été"]
    out = [None, "", " .,\n", "cc", "CC BY-NC", "cc by\x00nc cc by nc", "under the mit license " * 300, "x " * 5000 + "under the MIT-license"]
    for _ in range(250):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(3)):
            note = r.choice(NOTES).split()
            for _ in range(r.randrange(3)):
                note[r.randrange(len(note))] = r.choice(vocabulary)
            at = r.randrange(len(words) + 1)
            words[at:at] = note
        out.append(r.choice([" ", "\n", ", "]).join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = samples()
    rows = [(None if i == 20 else i, t, "x", 1) for i, t in enumerate([*texts, texts[6]])] + [(3, texts[6], "x", 1)]
    return save(spark.createDataFrame(rows, "doc_id long, text string, row string, n_words int").repartition(3), "test")


def test_equals_brute_force(docs):
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(brute(r.text))
    got = {}
    for r in scan_licenses(docs).collect():
        found = [tuple(x) for x in r.found]
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base, found, r.score))
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    assert sum(bool(x[5]) for v in got.values() for x in v) > 60


def test_each_template_is_found_whole_and_with_words_lost(spark):
    rows = [(i, "w " * 37 + t.text + " w" * 50) for i, t in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(TEMPLATES):
        assert t.width in WIDTHS and t.label in [x.label for x in got[i].found] and got[i].score == 1.0


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_licenses(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    said = con.execute(queries.oracle_sql()["op13_licenses"])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, said.fetchall()))
    assert licenses.sql() == queries.oracle_sql()["op13_licenses"]
