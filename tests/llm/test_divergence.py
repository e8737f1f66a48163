import random
import re

import duckdb
import numpy as np
import pytest

from cohortry.llm import catalog, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top=10):
    rows = [tuple(v or "" for v in r) for r in rows]
    out = []
    for lang in sorted({r[0] for r in rows}):
        docs = [(s, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t)]) for g, s, t in rows if g == lang]
        seen = {}
        for i, (_, words) in enumerate(docs):
            for w in words:
                seen.setdefault(w, set()).add(i)
        kept = [w for w, d in seen.items() if len(d) >= least]
        times = {s: {} for s, _ in docs}
        for s, words in docs:
            for w in words:
                times[s][w] = times[s].get(w, 0) + 1
        whole = {w: sum(t.get(w, 0) for t in times.values()) for w in kept}

        def shares(t):
            n = sum(t.get(w, 0) for w in kept)
            return {w: 1 + 10**9 * (t.get(w, 0) + 2) // (n + 2 * len(kept)) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(t) for s, t in times.items()}, shares(whole)
        for s in times:
            found = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in times if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(found, 1)]
            found = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if times[s].get(w) and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(found[:top], 1)]
    return sorted(out)


def table(rng, n=150):
    words = ["".join(rng.choice("abcdéßж") for _ in range(rng.choice([1, 2, 4, 5, 8, 9, 13, 40]))) for _ in range(120)]
    words += [w + rng.choice("xyz") for w in words] + [w.upper() for w in words[:20]]
    rows = []
    for _ in range(n):
        text = rng.choice([" ", "1", "_\n", "\x00"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", None]), text))
    return rows + rows[:9] + [("en", "lonely", ""), ("en", "none", None), ("xx", "a", "rare word"), ("xx", "b", None), ("en", "long", ("word " + "q" * 3000 + " ") * 40)]


@pytest.mark.parametrize("least,block,sources", [(10, 1 << 20, 128), (4, 800, 2), (1, 1, 128), (10**6, 1 << 20, 128)])
def test_equals_brute_force(spark, monkeypatch, least, block, sources):
    """Also with a block a document, with sources compared two at a time, and with no kept term."""
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", 50)
    rows = table(random.Random(least))
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int").repartition(4)
    got = divergence.audit(df, least, block_bytes=block)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, least)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rows = table(random.Random(7), 400)
    df = spark.createDataFrame([(i, t, g, s, 0) for i, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["op11_source_divergence"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['op11_source_divergence']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20


def test_terms_in_pieces(monkeypatch):
    text = "Ab cd  ÉF-gh ".encode() * 50
    whole = divergence.counted(text)
    assert whole == {b"ab": 50, b"cd": 50, "Éf".encode(): 50, b"gh": 50}
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert divergence.counted(text) == whole


def test_exact_shares():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(0, total + 1)
        assert int(divergence.share(np.array([n]), total)[0]) == 1 + 10**9 * n // total
