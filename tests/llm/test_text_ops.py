"""Tokenizers, packing, id files, archives and shards against their definitions."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm import bpe, idfile, packing, sharding, tokens, warc
from cohortry.llm.common import new_folder
from cohortry.llm.encoders import SpaceLed, WordEnded

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.lists(st.sampled_from(list("ab ,.'sé\n\t\xa0日1=İ☃\u0308!*%\u0958") + ["  ", "the", "<|endoftext|>"]), max_size=40).map("".join)
ODD = [None, "", " ", "a", "a", "  a  b\n\n c \n d", "x" * 5000, "=-" * 3000, " " * 3000 + "y", "the cat. The\ncat, sat.\nOn", "é ñ 日本 ☃ İ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i // 2 if i in (4, 5) else i, t, "s", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, size int").drop("ids")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_chunks_encode_as_whole_texts(text):
    if not ENC:
        ENC.update(byte=SpaceLed(P.path("byte_bpe_50k.json")), word=WordEnded(P.path("word_bpe_49k.json")), own=bpe.TextEncoder(MULTI, P.PATTERN), ref=reference())
    for enc in (ENC["byte"], ENC["word"]):
        assert enc.encode([text])[0] == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ENC["own"].encode([text])[0] == np.array(ENC["ref"].encode_ordinary(text), "<u4").tobytes()


ENC: dict = {}


def test_backtracking_equals_merging():
    rnd = random.Random(4)
    b = bpe.ByteBpe(bpe.read_ranks(MULTI))
    for _ in range(400):
        s = "".join(rnd.choice("abcdetionsr \xc3\xa9") for _ in range(rnd.randint(1, 25)))
        assert b.piece(s) == ([b.rank[s]] if s in b.rank else b.merged(s))


def test_bpe_round_trip(spark, docs):
    ids = bpe.encode(docs, MULTI, P.PATTERN)
    assert ids.columns == ["doc_id", "size", "ids"]
    rows = bpe.decode(ids, MULTI).collect()
    ref = reference()
    want = Counter((i, np.array(ref.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(ODD))
    assert Counter((r["size"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert bpe.encode(docs.limit(0), MULTI, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("size", "ids"), MULTI, P.PATTERN)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(60):
        w = rnd.choice([7, 16, 30])
        lengths = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, w + 1), rnd.randint(1, w))}
        rooms = []
        for s in sorted(lengths, reverse=True):
            for _ in range(lengths[s]):
                fits = [i for i, r in enumerate(rooms) if r >= s]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= s
                else:
                    rooms.append(w - s)
        runs, windows = packing.plan(lengths, w)
        sizes = [s for s in sorted(lengths, reverse=True) for _ in range(lengths[s])]
        seq, off = packing.place_of(runs, np.arange(len(sizes)))
        used = [set() for _ in range(windows)]
        for s, q, o in zip(sizes, seq, off):
            assert not used[q] & set(range(o, o + s))
            used[q] |= set(range(o, o + s))
        assert all(u == set(range(len(u))) for u in used)
        assert sorted(w - len(u) for u in used) == sorted(rooms)
    assert packing.plan({}, 8)[1] == 0


def test_pack(spark, docs):
    path = P.path("byte_bpe_50k.json")
    ids = tokens.encoded(docs, SpaceLed, path, end_id=0, width=2)
    rows = packing.pack(ids, window=64, width=2).collect()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in ODD)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    parts = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["start"]))
    for r in parts:
        assert len(r["ids"]) == 4 * r["length"]
    repeated = [r["doc_id"] for r in docs.collect()]
    for d in {x for x in repeated if repeated.count(x) == 1}:
        by_doc[d] = b"".join(bytes(r["ids"]) for r in parts if r["doc_id"] == d)
    assert not Counter(by_doc.values()) - want
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 * k for x, k in want.items())
    assert packing.pack(ids.limit(0), 64, 2).count() == 0
    seqs = packing.sequences(packing.pack(ids, 64, 2), 9, 64).collect()
    assert all(len(s["ids"]) // 4 in (64, s["length"]) and (len(s["ids"]) == 256 or s["length"] & (s["length"] - 1) == 0) for s in seqs)


def test_ranks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        r = np.r_[rng.integers(0, 1 << 32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)].astype("<u4")
        assert (idfile.unpack_ranks(*idfile.pack_ranks(r), n) == r).all()
    with pytest.raises(ValueError):
        idfile._read(b"RVB1" + bytes(40))


def test_id_files(spark, docs):
    path, folder = P.path("word_bpe_49k.json"), new_folder(spark, "t")
    idfile.write(tokens.encoded(docs, WordEnded, path, end_id=1, width=2), folder, width=2, file_ids=50)
    rows = sorted(idfile.read(spark, folder).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in ODD)
    assert Counter(bytes(r["ids"]) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    assert spark.read.parquet(f"{folder}/manifest").count() > 1
    empty = new_folder(spark, "t")
    idfile.write(tokens.encoded(docs.limit(0), WordEnded, path, end_id=1, width=2), empty, width=2)
    assert idfile.read(spark, empty).count() == 0


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "http://a", big), (5, None, big), (3, "http://b\r\nX: 1", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "é" * 700), (9, "u", "é" * 700), (9, "u", "é" * 700)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    folders = [new_folder(spark, "t") for _ in range(2)]
    for f in folders:
        warc.write(pages, f, shard_bytes=3000, file_bytes=300)
    got = warc.read(spark, folders[0]).collect()
    last = {big: 5, "é" * 700: 9}
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = last.get(h) if p is not None and last.get(h, p) != p else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, None if to else data))
    assert Counter(want) == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    both = [sorted((r["path"].rsplit("/", 1)[1], bytes(r["content"])) for r in spark.read.format("binaryFile").load(f + "/data").collect()) for f in folders]
    assert both[0] == both[1] and len(both[0]) > 2
    assert all(zlib.decompressobj(31).decompress(c).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for _, c in both[0])
    warc.write(pages.limit(0), empty := new_folder(spark, "t"))
    assert warc.read(spark, empty).count() == 0


def test_shards(spark, docs):
    rows = sharding.assign(docs, 3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    group = {}
    for r in rows:
        assert group.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in ODD)
    assert sharding.assign(docs.limit(0), 3).count() == 0


def test_shard_plan():
    rnd = random.Random(3)
    for _ in range(40):
        sizes = {rnd.randint(1, 300): rnd.randint(1, 60) for _ in range(rnd.randint(1, 60))}
        n = rnd.randint(1, 12)
        runs = sharding.plan(sizes, n)
        seen, load = Counter(), Counter()
        for s, a, b, shard in runs:
            seen.update((s, i) for i in range(a, b))
            load[shard] += s * (b - a)
            assert 0 <= shard < n
        assert seen == Counter((s, i) for s, k in sizes.items() for i in range(k))
        total, top = sum(s * k for s, k in sizes.items()), max(sizes)
        assert max(load.values()) <= max(top, -(-total // n) + top)


def test_tree_is_a_sorted_set():
    rnd, tree, held = random.Random(2), sharding.Rooms(), set()
    for _ in range(3000):
        key = (rnd.randint(0, 50), rnd.randint(0, 8))
        if key in held:
            tree.remove(key)
            held.remove(key)
        else:
            tree.add(key)
            held.add(key)
        need = rnd.randint(0, 55)
        assert tree.tightest(need) == min((k for k in held if k[0] >= need), default=None)
