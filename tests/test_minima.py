"""Smallest digests against hashlib, and pairs of signatures against all pairs."""

import hashlib
import random
import re

import pytest

from lexiforge.operators import dedup as D
from lexiforge.operators import minima as M
from lexiforge.plans import QUERIES


@pytest.mark.parametrize("few", [1, 512])
def test_first_words_of_every_length(monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "LANES", 64)
    r = random.Random(1)
    strings = [r.randbytes(n) for n in [*range(200), 0, 0, 55, 56, 1000]]
    prefixes = [b"0", b"31337", b"94011", b"125348", b"1002784", b"3102363", b"", b"12:"]
    got = M.first_words(strings, prefixes)
    assert [[int(x) for x in row] for row in got] == [[int.from_bytes(hashlib.md5(p + s).digest()[:4], "big") for s in strings] for p in prefixes]


def test_ties_in_the_first_bits_are_told_apart(monkeypatch):
    monkeypatch.setattr(M, "first_words", lambda strings, prefixes: M.np.zeros((len(prefixes), len(strings)), M.np.uint32))
    sets = [[b"a", b"b", b"c"], [b"c"], [b"b", b"d"]]
    assert [[x.tobytes() for x in one] for one in M.smallest(sets, [b"1", b"22"])] == [[min(hashlib.md5(p + s).digest() for s in one) for p in (b"1", b"22")] for one in sets]


def brute(text, prefixes, digits, k=5):
    w = text.lower().split()
    runs = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}
    return [min(hashlib.md5((p + s).encode()).hexdigest()[:digits] for s in runs) for p in prefixes]


def test_signatures_by_hand(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice(["Ab", "é", "😀x", "long" * 20, "c"]) for _ in range(n)) + end for n in (1, 3, 4, 5, 6, 40, 300) for end in ("", " \n")] + ["", " ", "same words here again " * 500]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "idx int, text string").repartition(2)
    got = D.minhash(docs, 40)
    assert got.dtypes == [("idx", "int"), ("signature", "array<string>")]
    assert {x.idx: x.signature for x in got.collect()} == {i: brute(t, [str(31337 * s) for s in range(40)], 32) for i, t in enumerate(texts)}  # a text that is null has none, as in the SQL
    assert {x.idx: x.signature for x in D.minhash_prefixed(docs, 12).collect()} == {i: brute(t, [f"{s}:" for s in range(12)], 16) for i, t in enumerate(texts)}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # not one call of md5 for each seed and shingle
    assert D.minhash(docs.limit(0)).count() == 0


def test_signature_pairs_by_hand(spark):
    """All pairs, with copies by their first row; signatures do not travel through the join of bands."""
    r = random.Random(3)
    base = [[f"{r.getrandbits(40):x}" for _ in range(100)] for _ in range(4)]
    rows = [[x if r.random() > share else f"{r.getrandbits(40):x}" for x in b] for b in base for share in (0, 0.02, 0.08, 0.1, 0.15)] + base
    first = [i for i, s in enumerate(rows) if rows.index(s) == i]
    want = {(i, j, sum(a == b for a, b in zip(rows[i], rows[j], strict=True)) / 100) for i in first for j in first if i < j}
    want = {x for x in want if x[2] >= 0.8} | {(rows.index(s), i, 1.0) for i, s in enumerate(rows) if rows.index(s) != i}
    got = D.signature_pairs(spark.createDataFrame(list(enumerate(rows)), "idx long, signature array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "signature" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_digests_by_the_jvm(spark):
    """Texts of one shingle to many tiles, messages of one md5 block to many, prefixes of all lengths; equal runs count once."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["ab", "é", "😀x", "long" * 20, "c", "w" * 300, f"v{r.randrange(99)}"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 60, 261, 1200)] + ["x" * n for n in range(44, 130)] + ["one two three four five " * 40]
    prefixes = [b"", b"7", b"31337", b"94011", b"125348", b"3102363", b"123456789:"]
    docs = spark.createDataFrame(list(enumerate([t.strip() for t in texts])), "idx int, text string").repartition(3)
    got = D._minima(docs, prefixes, 32, 5)
    assert {x.idx: x.signature for x in got.collect()} == {i: brute(t, [p.decode() for p in prefixes], 32) for i, t in enumerate(texts)}
    assert "lexiforge_minima" in got._jdf.queryExecution().optimizedPlan().toString()  # not left to NumPy
    other = spark.newSession()
    again = D.minhash_prefixed(other.createDataFrame([(1, "a b")], "idx int, text string"), 3)
    assert again.head().signature == brute("a b", ["0:", "1:", "2:"], 16)


def test_fingerprints_by_hand(spark):
    """SimHash with repeated, long and no words, double spaces of its form; shingles are counted once; nothing is exploded to words."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["Ab", "é", "😀", "w" * 300, "x" * 60, f"v{r.randrange(9)}", "a.b-c", "&"]) for _ in range(n)) for n in (1, 2, 5, 40, 700, 3000)] + ["a & b", "b", "same words here again " * 50]
    docs = spark.createDataFrame([*enumerate(texts), (98, "&"), (99, None)], "idx int, text string").repartition(3)

    def votes(text):
        words = re.sub(r"[^\w\s.-]", "", text.lower()).split()
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        return words and (bits - 2**64 if bits >= 2**63 else bits)

    want = {i: votes(t) for i, t in enumerate(texts) if votes(t)}
    assert {x.idx: x.simhash for x in D.simhashes(docs).collect()} == want
    got = D.fingerprints(docs)
    runs = lambda w: len({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {""})
    assert {x.idx: (x.shingles, x.simhash) for x in got.collect()} == {i: (runs(texts[i].split()), s) for i, s in want.items()}
    assert "bit_or" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan


@pytest.mark.parametrize("members", [2, 500])
def test_similar_rows_are_all_in_pairs(spark, monkeypatch, members):
    """Rows of one signature, whose texts may differ, meet each other and all rows that are similar, once each."""
    monkeypatch.setattr(D, "MEMBERS", members)
    r = random.Random(4)
    base = [[f"{r.getrandbits(40):x}" for _ in range(100)] for _ in range(3)]
    near = [[x if r.random() > share else f"{r.getrandbits(40):x}" for x in b] for b in base for share in (0, 0.08, 0.15)]
    rows = [s for i, s in enumerate(near) for _ in range(1 + 5 * (i % 3 == 0))] + near[1:2]
    want = {(i, j, sum(a == b for a, b in zip(rows[i], rows[j], strict=True)) / 100) for i in range(len(rows)) for j in range(i + 1, len(rows))}
    signatures = spark.createDataFrame(list(enumerate(rows)), "idx long, signature array<string>").repartition(3)
    got = [(min(x.a.idx, x.b.idx), max(x.a.idx, x.b.idx), x.similarity) for x in D.similar_rows(signatures, signatures.selectExpr("idx", "idx + 7 AS other")).collect()]
    assert sorted(got) == sorted(x for x in want if x[2] >= 0.8) and len(got) > 50


def test_combined_similarity_leaves_no_pair_out(spark, tmp_path):
    """Texts of one signature that differ in their repeats, and so in length and SimHash."""
    text = " ".join(f"w{i}" for i in range(60))
    texts = [text, f"{text} {text}", text, f"{text} {text} {text}", text.upper(), "another text of its own"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    signatures = [brute(t, [str(31337 * s) for s in range(100)], 32) for t in texts]
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if sum(a == b for a, b in zip(signatures[i], signatures[j], strict=True)) >= 80}
    got = QUERIES["combined_similarity"](spark, str(tmp_path)).collect()
    assert len(want) == 10 and sorted((x.x, x.y) for x in got) == sorted(want)
    assert {x.similarity for x in got if (x.x, x.y) in {(0, 2), (0, 4), (2, 4)}} == {1.0}
    assert all(x.similarity < 1 for x in got if 1 in (x.x, x.y))
