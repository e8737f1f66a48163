import random

import numpy as np
import pytest

from cohortry.llm import repeats


def brute(texts, length):
    """Per text (n_bytes, n_removed, n_spans, kept) by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(rng, length):
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(k)) for k in (10, 25, 40, 80)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice([rng.choice(passages), ""]) + parts[2])
    near = list(texts[0] + passages[3])
    for _ in range(12):  # near copies, one letter changed in each
        copy = near.copy()
        copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts + [texts[5]] * 4 + [None, "", "a" * 700, "b" + "a" * 300, "ab" * 400, "xyz" * 5, "a" * length, "é" * length]


@pytest.mark.parametrize("length,bundle", [(24, 1 << 20), (64, 1 << 20), (64, 3000), (97, 600), (400, 1 << 20)])
def test_equals_brute_force(spark, length, bundle):
    """Also with bundles so small that grams are split down to single strings."""
    texts = corpus(random.Random(length), length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.removed(df, length, bundle).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        got, runs, letters = repeats.longest_matches(parts)
        at = 0
        for p in parts:
            for i in range(len(p)):
                best = 0
                for other in parts:
                    for j in range(len(other)):
                        if other is not p or i != j:
                            k = 0
                            while i + k < len(p) and j + k < len(other) and p[i + k] == other[j + k]:
                                k += 1
                            best = max(best, k)
                assert got[at + i] == best
            at += len(p) + 1
        assert runs <= letters == at


def test_index_of_copies_has_few_runs():
    rng = random.Random(4)
    text = bytes(rng.randrange(256) for _ in range(2000))
    _, runs, letters = repeats.longest_matches([text] * 50)
    assert letters == 50 * 2001 and runs < letters / 15


def test_parts_of_a_long_text_lose_no_string(monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", 500)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(k)) for k in (3000, 64, 63, 0, 700, 1, 499, 2000)]
    found = list(repeats.segments(texts, 64, 32))
    starts = sorted((t, s) for t, a, _, b in found for s in range(a, b - 64 + 1))
    assert starts == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 63)]
    assert all(a <= o and o + 32 <= a + 64 and b - 64 <= o for _, a, o, b in found)


def test_null_and_repeated_ids_clashing_columns_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(None, text, "k"), (1, text, "k"), (1, None, "k"), (1, "q" + text[:300], None)], "doc_id long, text string, key string")
    rows = sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in repeats.removed(df, 100).collect())
    size = len(text)
    assert rows == [(False, 0, 0), (False, 301, 300), (False, size, size), (True, size, size)]
    assert repeats.removed(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        repeats.removed(df, 8)
