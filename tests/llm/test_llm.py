import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import decontaminate, fingerprint, html, language_model, minhash, packing, suffix, toxicity, urls, warc
from vitrine.llm.common import U64, as_bytes, save
from vitrine.llm.components import components
from vitrine.llm.queries import URL_RULES

WORDS = [f"w{i}" for i in range(400)]


def stored(spark, rows, schema):
    return save(spark.createDataFrame(rows, schema).repartition(3), "test")


def texts_with_copies(seed: int, count: int = 60) -> list[str]:
    r = random.Random(seed)
    out = []
    for _ in range(count):
        if out and r.random() < 0.4:
            words = r.choice(out).split()
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            out.append(" ".join(words))
        else:
            out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(20, 90))))
    return out


def docs_of(spark, texts, extra=True):
    """Documents with a null, an empty and a repeated text, and columns whose names operators use inside."""
    more = [None, "", "  ", texts[0], "ab"] if extra else []
    rows = [(i, t, "x", i) for i, t in enumerate([*texts, *more])]
    return stored(spark, rows, "doc_id long, text string, key string, part long")


def brute_groups(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = docs_of(spark, texts_with_copies(1))
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    for i, (n, group) in enumerate(brute_groups(texts, 3, 85)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, group, group == i)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 900).astype(U64)
    a, b = pool[:600], pool[150:750]
    table = minhash.superminhash(np.concatenate([a, b]), np.array([600, 600]), 256)
    assert abs((table[0] == table[1]).mean() - 450 / 750) < 0.12
    assert minhash.superminhash(pool[:1], np.array([1])).max() < np.iinfo(U64).max


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (205, 203), (203, 209)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 203: 203, 205: 203, 209: 203}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_fingerprints_equal_brute_force(spark):
    docs = docs_of(spark, [*texts_with_copies(2, 30), "é" * 9, "x"])
    rows = docs.orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    got = {r.doc_id: r for r in fingerprint.with_next(docs, task_bytes=500).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)], len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == n
        assert [got[k].fingerprint, got[k].edited_fingerprint] == fingerprint.digests([t.encode(), edited.encode()])
    long = [g for g in got.values() if g.n_chars > 150]
    assert sum(g.near_edited > g.near_next for g in long) > 0.9 * len(long)
    assert fingerprint.with_next(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 1500])
def test_language_model_counts_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", size)
    monkeypatch.setattr(language_model, "RANGE_BYTES", size)
    docs = docs_of(spark, texts_with_copies(3))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = {r.doc_id: r for r in language_model.score(docs, fold).collect()}
    tokens = {r.doc_id: [*(r.text or "").lower().split(), None] for r in docs.collect()}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    counts, total = Counter(w for i in train for w in tokens[i]), sum(len(tokens[i]) for i in train)
    for i, words in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i not in train, len(words), sum(counts[w] > 0 for w in words), total)
        assert got[i].base_score == pytest.approx(base) and math.isfinite(got[i].score)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_mixture_weights_prefer_what_predicts():
    cell = (5 * language_model.STEPS_TWO + 3) * language_model.STEPS_ONE + 20
    weights = language_model.mixture_weights(np.array([cell]), np.array([1000]), np.array([1000 * math.log(0.5)]), np.array([1000 * math.log(0.001)]), 100)
    assert weights[5, 0] > 0.9 and np.allclose(weights.sum(axis=1), 1)


def test_main_text():
    page = '<html><head><title>x</title></head><body><nav>n</nav><header>H</header><article><header><h1>A &amp; B</h1></header><p>one<b>two</b> three<br>four<p>five<ul><li>a<li>b</ul><div class="comments"><p>c</p></div></article><aside>z</aside><script>"</p>"</script>'
    assert html.main_text(html.parse(page)) == "A & B onetwo three four five a b"
    assert html.main_text(html.parse('<div id="cookie-notice">c</div><p>hi &lt;b&gt;</p> a < b <p cl')) == "hi <b> a < b"
    assert html.main_text(html.parse("")) == ""


def test_recurring_subtrees_go(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><div><p>Our site</p></div><div>text {i}</div></body>") for i in range(8)]
    rows += [(20, None, None), (21, "http://other.com/", "<div><p>Our site</p></div>")]
    got = {r.page_id: r.main_text for r in html.extract(stored(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}" for i in range(8)}, 20: "", 21: "Our site"}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/\r\n4", ""), (5, "http://a/5", "é" * 70_000), (6, "u", "same")]
    got = {r.id: r for r in warc.round_trip(stored(spark, rows, "page_id long, url string, html string")).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for i, _, t in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((t or "").encode()), digest(t or ""))
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 6, 4)] == [("response", None), ("revisit", 1), ("revisit", 1), ("revisit", 3)]
    assert bytes(got[5].payload).decode() == rows[4][2]
    folder = warc.scratch(spark, "warc")
    index = warc.write_archives(stored(spark, rows, "page_id long, url string, html string"), f"file://{folder}", least=1)
    assert sorted(r.id for r in warc.read_records(index.where("id in (2, 5)"), f"file://{folder}").collect()) == [2, 5]


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in toxicity.initial(rng).items()}
    words, mask = rng.normal(size=(5, 3, 2 * toxicity.WIDTH + 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    out = np.array([1.0, -2, 0.5])
    x = lambda q: {w: words @ q[f"W{w}"] + q[f"c{w}"] for w in "fb"}
    grad, _ = toxicity.backward(p, x(p), mask, toxicity.forward(p, x(p), mask, keep=True)[1], out)
    for name in ("Uf", "Ub", "cf", "cb", "A", "v", "w", "bias"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        ends = []
        for step in (0.01, -0.01):
            q = {**p, name: p[name].copy()}
            q[name][at] += step
            ends.append(toxicity.forward(q, x(q), mask).astype(float) @ out)
        assert (ends[0] - ends[1]) / 0.02 == pytest.approx(grad[name][at], rel=0.02, abs=1e-5)


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        words = [r.choice(WORDS) for _ in range(r.randint(10, 150))]
        bad = i % 3 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words))] = "vile" + r.choice(["", "st", "ly"]) + r.choice(["", ".", ","])
        rows.append((i, " ".join(words), int(bad)))
    docs = stored(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0) >= 57


def test_every_window_is_read():
    words = toxicity.Words([b" ".join([b"w"] * n) for n in (0, 1, 64, 65, 400)])
    owner, begin, size = words.windows()
    first = np.concatenate([[0], np.cumsum(words.counts)])
    for d, n in enumerate((0, 1, 64, 65, 400)):
        seen = {k for b, s in zip(begin[owner == d], size[owner == d]) for k in range(b - first[d], b - first[d] + s)}  # noqa: B905
        assert seen == set(range(n))


def test_greedy_tiles_are_maximal():
    r = random.Random(5)
    for _ in range(200):
        a, b = (np.array([r.randint(0, 3) for _ in range(r.randint(0, n))], dtype=U64) for n in (60, 30))
        used_a, used_b = set(), set()
        for x, y, n in decontaminate.greedy_tiles(a, b, 3):
            assert n >= 3 and (a[x : x + n] == b[y : y + n]).all()
            assert not used_a & set(range(x, x + n)) and not used_b & set(range(y, y + n))
            used_a |= set(range(x, x + n))
            used_b |= set(range(y, y + n))
        runs = [{tuple(w[i : i + 3].tolist()) for i in range(len(w) - 2) if not used & {i, i + 1, i + 2}} for w, used in ((a, used_a), (b, used_b))]
        assert not runs[0] & runs[1]


@pytest.mark.parametrize("most", [100, 0])
def test_benchmark_passages_are_found(spark, most):
    r = random.Random(6)
    item = [r.choice(WORDS) + str(k) for k in range(30)]
    other = texts_with_copies(7, 5)
    texts = [" ".join([*other[0].split(), *item, "end"]), " ".join([*item[15:], "and", *item[:15]]).upper(), " ".join(item[:8]), other[1], None, ""]
    docs = stored(spark, list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item) + "."), (2, "too short"), (3, None)], "item_id long, text string")
    got = decontaminate.overlaps(docs, items, most_seeds=most).collect()
    assert sorted((g.doc_id, g.item_id, g.covered_words) for g in got) == [(0, 1, 30), (1, 1, 30)]


def test_url_verdicts(spark):
    cases = [("http://a.example.com/x", "com/", "allow"), ("https://m.EXAMPLE.com/en/1?q", "example.com/en/", "block"), ("http://www.example.com/en/1", "www.example.com/en/", "allow"), ("http://x.net/es/", "net/es/", "block"), ("nothing", None, "allow"), (None, None, "allow"), ("http://cheap-pills.example.org/en/5", None, "block"), ("http://notexample.org/en", None, "allow")]
    rows = [(i, u) for i, (u, _, _) in enumerate(cases)]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string"), URL_RULES, urls.fit(urls.labelled_urls(spark))).collect()
    for g in got:
        assert (g.rule, g.verdict) == cases[g.page_id][1:], g


def test_url_table_holds_no_site_of_the_test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    parts = {w for r in pages.select(urls.host_of(F.col("url")).alias("h")).distinct().collect() for w in r.h.split(".")} - {"www", "m", "blog", "example", "com", "org", "net"}
    assert len(parts) > 50 and not parts & {x for word, name, _ in urls.labelled_names() for x in (word, name)}


def test_url_method_on_names_outside_its_table(spark):
    names = urls.labelled_names()
    model = urls.fit(urls.labelled_urls(spark, [n for k, n in enumerate(names) if k * 7 % 5]))
    rows = urls.judge(urls.labelled_urls(spark, [n for k, n in enumerate(names) if not k * 7 % 5]), [], model)
    got = {(r.blocked, r.verdict): r["count"] for r in rows.groupBy("blocked", "verdict").count().collect()}
    assert got[1.0, "block"] > 0.6 * (got[1.0, "block"] + got[1.0, "allow"])
    assert got.get((0.0, "block"), 0) < 0.05 * got[0.0, "allow"]


def test_url_judging_takes_any_columns_and_empty_tables(spark):
    model = urls.fit(urls.labelled_urls(spark, [n for k, n in enumerate(urls.labelled_names()) if k % 20 == 0]))
    rows = spark.createDataFrame([(1, "http://a.net/es/", "x", "y", "z"), (1, "http://a.net/es/", "x", "y", "z"), (None, None, None, None, None)], "page_id int, url string, _rule string, host string, features string")
    got = urls.judge(rows, URL_RULES, model)
    assert sorted((r.page_id or 0, r.host, r._rule, r.verdict) for r in got.collect())[1:] == [(1, "a.net", "x", "block")] * 2
    assert got.columns == ["page_id", "url", "_rule", "features", "host", "path", "rule", "verdict", "block_score"]
    assert urls.judge(rows.limit(0), URL_RULES, model).count() == 0


def test_templates_go_by_absolute_counts_and_within_articles(spark):
    side, notice = "<div><p>Advice of the section</p></div>", "<p>All rights kept by us.</p>"
    rows = [(i, f"http://big.com/{i}", f"<body>{side if i % 20 == 0 else ''}<div>text {i}</div></body>") for i in range(400)]
    rows += [(1000 + i, "http://art.com/x", f"<article><h2>About {i}</h2><p>own {i} <b>bold</b></p>{notice}</article>") for i in range(30)]
    rows += [(2000 + i, "http://copy.com/x", f"<article><div>same</div></article>") for i in range(30)]
    got = {r.page_id: r.main_text for r in html.extract(stored(spark, rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" for i in range(400))
    assert all(got[1000 + i] == f"About {i} own {i} bold" and got[2000 + i] == "same" for i in range(30))


def brute_repeats(texts, span):
    data = as_bytes(texts)
    seen = Counter(x[i : i + span] for x in data for i in range(len(x) - span + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(c for c, g in zip(x, gone) if not g))  # noqa: B905
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 9000)
    r = random.Random(8)
    base = ["".join(r.choice("abcdé ") for _ in range(600)) for _ in range(6)]
    texts = []
    for _ in range(120):
        t = ""
        for _ in range(r.randint(0, 5)):
            x, a = r.choice(base), r.randint(0, 500)
            t += x[a : a + r.randint(10, 400)] + "z" * (r.randint(0, 300) if r.random() < 0.3 else 0)
        texts.append(t)
    texts += ["q" * 500, "ab" * 250]
    docs = docs_of(spark, texts)
    rows = {x.doc_id: x for x in suffix.remove_repeats(docs, hot=hot).collect()}
    expected = brute_repeats([x.text for x in docs.orderBy("doc_id").collect()], 200)
    assert [bytes(rows[i].kept) for i in range(len(expected))] == expected
    assert suffix.remove_repeats(docs, whole_chars=True).where(F.decode("kept", "utf-8").isNull()).count() == 0


def test_deep_shallow_sort():
    r = random.Random(9)
    for _ in range(200):
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 40))]
        strings += [s[: r.randint(0, 60)] for s in strings]
        order = suffix.deep_shallow_sort(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Don't stop, it's 2 a.m.!", "ÉAU naïve ﬁn x", "a\x1cb c", "x" * 3000, None, "", "Straße İstanbul ΟΔΟΣ", *texts_with_copies(10, 20), " ".join(WORDS * 8)]
    docs = stored(spark, list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, path, length=256, task_tokens=4096).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = [(k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i) == pieces
    for number in {r.sequence_id for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r.sequence_id == number), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 256


def test_packing_keeps_literals_of_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    for mark in ("<|endoftext|>", "<|startoftext|>"):
        assert len(tokenizer.encode(mark, add_special_tokens=False).ids) == 1
        for text in (mark, f"hello {mark} world", f"ab{mark}cd", f"{mark}{mark}.", f"É{mark},x", f"a\x1c{mark}", mark.upper(), f"Two {mark}\nlines{mark}!"):
            assert np.frombuffer(tokens(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]  # 8 closes bin 1, 4 closes bin 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = docs
        docs = save(stage(spark, docs, sf), name)
        assert docs.columns == columns
        if name == "near_duplicates":
            kept = {r.doc_id for r in docs.collect()}
            texts = [r.text for r in before.orderBy("doc_id").collect()]
            ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
            assert kept == {ids[i] for i, (_, g) in enumerate(brute_groups(texts, 5, 80)) if g == i}
        if name == "repeats":
            before = before.orderBy("doc_id").collect()
            after = {r.doc_id: r.text for r in docs.collect()}
            for r, e in zip(before, brute_repeats([r.text for r in before], 200), strict=True):
                assert len(e) <= len(after[r.doc_id].encode()) <= len(e) + 6 * r.n_chars / 200 + 6


def test_empty_tables(spark):
    docs = stored(spark, [], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert suffix.remove_repeats(docs).count() == 0
    assert language_model.score(docs, F.lit(False)).count() == 0
    import public_tokenizers

    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontaminate.overlaps(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    pages = stored(spark, [], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0 and warc.round_trip(pages).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def brute_tiles(a, b, least):
    """Always the longest common run that touches no tile, the first in the text, then in the item."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = min(best, (-n, i, j))
        if -best[0] < least:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_greedy_tiles_equal_brute_force():
    r = random.Random(11)
    for _ in range(150):
        a, b = ([r.randint(0, 2) for _ in range(r.randint(0, n))] for n in (40, 25))
        assert decontaminate.greedy_tiles(np.array(a, dtype=U64), np.array(b, dtype=U64), 3) == brute_tiles(a, b, 3)


def brute_digest(text: bytes) -> str:
    counts = [0] * fingerprint.BUCKETS
    for at in range(len(text)):
        for k, (i, j) in enumerate(fingerprint.TRIPLETS):
            if at >= max(i, j):
                t = fingerprint._TABLE[k].astype(int)
                key = (t[0][text[at]] + t[1][text[at - i]] + t[2][text[at - j]]) * 0x9E35 % 65536
                counts[key >> 9] += 1
    ordered = sorted(counts)
    q = [ordered[fingerprint.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    packed = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4)]
    top = max(q[2], 1)
    head = [min(255, round(math.log1p(len(text)) * 12)), min(15, 16 * q[0] // top) << 4 | min(15, 16 * q[1] // top)]
    return bytes(head + packed).hex()


def test_digests_and_likeness_equal_brute_force():
    r = random.Random(12)
    texts = [b"", b"a", b"ab", "Öl und é".encode(), *[bytes(r.choice(b"abcdefgh ") for _ in range(r.randint(3, 400))) for _ in range(20)]]
    texts.append(texts[-1][:-3] + b"xyz")
    made = fingerprint.digests(texts)
    assert made == [brute_digest(t) for t in texts]

    def code(d, k):
        return [int(d[4:], 16) >> 2 * (fingerprint.BUCKETS - 1 - k) & 3, int(d[:2], 16), int(d[2], 16), int(d[3], 16)]

    for a, b in zip(made, made[1:] + made[:1], strict=True):
        steps = sum((0, 1, 2, 6)[abs(code(a, k)[0] - code(b, k)[0])] for k in range(fingerprint.BUCKETS))
        (_, la, a1, a2), (_, lb, b1, b2) = code(a, 0), code(b, 0)
        cost = steps + min(24, max(0, abs(la - lb) - 1)) + (abs(a1 - b1) + abs(a2 - b2)) // 2
        assert fingerprint.likeness([a], [b])[0] == pytest.approx(min(1, max(0, 1 - cost / (1.75 * fingerprint.BUCKETS))))
    assert fingerprint.likeness(made[-2:-1], made[-1:])[0] > 0.8


def test_token_ids_of_any_text_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    assert tokens.by_word
    r = random.Random(13)
    parts = ["İ", "i\u0307", "a", "B", "é", "e\u0301", "\u0301", "ß", "Σ", "ς", "\u0958", "\u093c", "1", "½", "ª", ".", ",", "!", "?;", "'s", "'LL", "-", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\t", "\n", "\xa0", "\u2003", "\x1c", "\x85", "\u200b", "word", "Haus", "été", "中文", "\uac00", "🙂", "ſ", "\u212a", "\x00"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert np.frombuffer(tokens(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_wastes_little(spark):
    import public_tokenizers

    r = random.Random(14)
    docs = stored(spark, [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(5, 400)))) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048).collect()
    assert len({x.sequence_id for x in rows}) <= 1.02 * math.ceil(sum(x.length for x in rows) / 2048) + 1


def test_names_and_recurrence_keep_article_text(spark):
    page = '<article><div class="post-header"><h1>Title</h1></div><section id="related-work">Work</section><p class="social">Social</p><div class="notice-period">Notice</div><p>plain</p><div class="ad-slot">advert</div><div class="comments">c</div></article>'
    assert html.main_text(html.parse(page)) == "Title Work Social Notice plain"
    words = [" ".join(random.Random(k).choice(WORDS) for k in range(100 * n, 100 * n + 60)) for n in range(6)]
    copies = [(i, "http://a.com/", f"<article><h1>{'About ' + WORDS[i]}</h1>" + "".join(f"<p>{w}</p>" for w in words) + f"<p>own {WORDS[i]} end</p></article>") for i in range(60)]
    rows = html.extract(stored(spark, copies, "page_id long, url string, main_text string").withColumnRenamed("main_text", "html").withColumn("_host", F.lit("x")).withColumn("removed", F.lit(1)))
    got = {x.page_id: x.main_text for x in rows.collect()}
    assert all(got[i] == " ".join([f"About {WORDS[i]}", *words, f"own {WORDS[i]} end"]) for i in range(60))
    assert rows.columns == ["page_id", "url", "_host", "main_text", "removed"]


def test_pipeline_judges_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(15)
    item = " ".join(f"q{k}" for k in range(30))
    text = lambda: " ".join(r.choice(WORDS) for _ in range(60))
    same = text()
    rows = [(1, same, "a"), (None, same, "b"), (None, text() + " " + item, "c"), (3, text(), "d"), (None, text(), "e"), (4, None, "f"), (None, None, "g")]
    docs = stored(spark, rows, "doc_id long, text string, kept string").withColumn("spans", F.lit(1))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    alone = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(x.kept for x in alone.collect()) == ["a", "c", "d", "e", "f", "g"] and alone.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(x.kept for x in clean.collect()) == ["a", "b", "d", "e", "f", "g"] and clean.columns == docs.columns
    cut = corpus_pipeline.cut_repeats(spark, save(docs, "docs"), str(tmp_path))
    assert {x.kept: x.text for x in cut.collect()}["d"] == rows[3][1] and cut.columns == docs.columns
    assert {x.kept for x in cut.where("text = ''").collect()} == {"a", "b"}


def test_pipeline_runs_end_to_end(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {x.doc_id for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) > 50 and {x.doc_id for x in rows} <= ids
    used = Counter()
    for x in rows:
        used[x.sequence_id] += x.length
    assert max(used.values()) <= 2048
