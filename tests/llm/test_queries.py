"""Every registered query on a small set of tables, against its SQL or a brute-force version of its contract."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from check import compare, connect

from sepet.llm.pieces import MODEL, decode_pieces, encode_pieces
from sepet.llm.queries import REGISTRY
from sepet.llm.sql import SQL

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, name, key="doc_id"):
    found = REGISTRY[name](spark, SF_DIR).collect()
    by_key = {r[key]: r for r in found}
    assert len(by_key) == len(found)
    return by_key


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def component(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_query_is_tested():
    here = globals()
    assert all(n in SQL or f"test_{n.split('_')[0]}" in here for n in REGISTRY)


def test_op2(spark, docs):
    got = rows(spark, "op2_toxicity")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, 3) == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_op3(spark, docs):
    got = rows(spark, "op3_pitman_yor")
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in docs.items()}
    count = collections.Counter(w for i, ws in tokens.items() if remainder(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    assert got.keys() == docs.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0


def test_op4(spark, docs):
    got = rows(spark, "op4_quality_rules")
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        words = WORD.findall(text or "")
        windows = list(zip(words, words[1:], words[2:]))
        seen = collections.Counter(windows)
        repeated = len({j for k, w in enumerate(windows) if seen[w] > 1 for j in (k, k + 1, k + 2)})
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * repeated > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op6(spark, con):
    got = rows(spark, "op6_rp_forest", "vec_id")
    vectors = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    ids = sorted(i for i, v in vectors.items() if v is not None and any(v))
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)]
    links = collections.Counter(i for pair in pairs for i in pair)
    reach = component(vectors, pairs)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (links[i], reach[i], reach[i] == i) for i in vectors}


def test_op7(spark, docs):
    got = rows(spark, "op7_simhash")
    prints = {}
    for i, text in docs.items():
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3]
    reach = component(ids, pairs)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", reach[i]) for i in ids}


def test_op8(spark, docs):
    got = rows(spark, "op8_suffix_dedup")
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = np.frombuffer(b, np.uint8)[~gone[: len(b)]].tobytes()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.skipif(not os.path.exists(MODEL), reason="public vocabulary not here")
def test_op9(spark, docs):
    found = REGISTRY["op9_pieces"](spark, SF_DIR)
    assert found.count() == len(docs) and found.filter("not restored or score > 0 or losses[0] <> 0").isEmpty()
    assert {r["ident"]: r["text"] for r in decode_pieces(found, "ids", "doc_id").collect()} == {i: t or "" for i, t in docs.items()}


def test_op9_gives_its_n_best_segmentations(spark, docs):
    def after(ids, made):
        for c in reversed(made):
            ids = [*ids[: c["at"]], *c["ids"], *ids[c["at"] + c["n"] :]]
        return ids

    whole = encode_pieces(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), "text", "doc_id", alternatives=True)
    want = {r["ident"]: r["n_best"] for r in whole.collect()}
    for r in REGISTRY["op9_pieces"](spark, SF_DIR).collect():
        each = [after(r["ids"], made) for made in r["changes"]]
        assert each == want[r["doc_id"]] and each[0] == r["ids"] and len(each) == len(r["losses"]) == len({*map(tuple, each)})
    back = decode_pieces(whole.selectExpr("ident", "explode(n_best) as ids"), "ids", "ident").collect()
    assert len(back) > len(docs) and all(r["text"] == (docs[r["ident"]] or "") for r in back)


def test_op10(spark, docs):
    got = rows(spark, "op10_license_scan")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        starts = sorted(k for k, _ in places)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), *((starts[0], starts[-1]) if starts else (None, None)))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and 0 <= r["score"] <= 1
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(base) <= set(labels)
