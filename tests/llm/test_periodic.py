import hashlib
import random
import zlib

import pytest

from vitrine.llm import queries
from vitrine.llm.common import save
from vitrine.llm.periodic import periodic_runs


def brute(words, least=12, exponent=2):
    """Runs by trying every lag and every stretch, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def cut(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples():
    r = random.Random(5)
    out = [None, "", " \t\n", "one", "a " * 40, "a b " * 30 + "c " + "a b " * 30, " x y z " * 20]
    for letters in (2, 3, 30):
        for _ in range(25):
            out.append(" ".join(f"w{r.randrange(letters)}" for _ in range(r.randrange(10, 200))))
    for _ in range(30):
        words = []
        while len(words) < 250:
            piece = [f"w{r.randrange(50)}" for _ in range(r.randrange(1, 30))]
            words += (piece * r.randrange(1, 8))[: r.randrange(1, 150)]
        out.append("  ".join(words))
    fib = ["a", "a b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + " " + fib[-2])
    out.append(fib[-1])
    out.append(" ".join("ab"[bin(i).count("1") % 2] for i in range(600)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = samples()
    rows = [(None if i % 9 == 8 else i, t, i, "x") for i, t in enumerate([*texts, texts[4], texts[-3]])]
    return save(spark.createDataFrame(rows, "doc_id long, text string, n long, runs string").repartition(3), "test")


@pytest.mark.parametrize("long_bytes", [1 << 20, 300])
@pytest.mark.parametrize("least, exponent", [(12, 2), (5, 3), (2, 2)])
def test_runs_equal_brute_force(docs, long_bytes, least, exponent):
    got = periodic_runs(docs, min_length=least, min_exponent=exponent, long_bytes=long_bytes).collect()
    assert len(got) == docs.count()
    for row in got:
        words = (row.text or "").encode().split()
        words = [w.decode() for w in words]
        runs = brute(words, least, exponent)
        assert [tuple(x) for x in row.runs] == runs, row.n
        assert (row.n_words, row.collapsed) == (len(words), cut(words, runs))


def test_empty_table(spark):
    got = periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and got.collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 120))) for _ in range(150)] + [None, ""]
    save(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string"), "t").write.parquet(f"{tmp_path}/documents.parquet")
    got = {row.doc_id: row for row in queries.op11_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    repeats = 0
    for i, t in enumerate(texts):
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        repeats += bool(runs)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        row = got[i]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2]))
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(cut(words, runs).encode()).hexdigest()
    assert repeats > 5
