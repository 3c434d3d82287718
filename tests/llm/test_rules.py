"""op4, op8 and op9 against plain Python versions."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lexiforge.llm import ctw, mixing, quality
from lexiforge.llm.words import blocks, hashes, words

import pyarrow as pa

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(seed=1, n=300):
    r = random.Random(seed)
    parts = ["alpha", "beta", "The", "é", "x#y", "***", "😀", "|", "gamma."]
    return ["".join(r.choice(parts) + r.choice([" ", " ", "\n", "  ", "\t", "\v"]) for _ in range(r.randint(0, 120))) for _ in range(n)]


def base_quality(t):
    ws = SPLIT.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if count[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_shape(spark, hard):
    texts = [*texts_of(), None, "", "a b c " * 40, "line\nline\n \n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(docs, labels, buckets=1 << 12).collect()}
    for i, t in enumerate(texts):
        want = base_quality(t or "")
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judge(hard, labels, buckets=1 << 12).count() == hard.count()
    assert quality.judge(hard.limit(0), labels.limit(0), buckets=1 << 12).count() == 0


def python_score(texts, target, prior=quality.PRIOR):
    """Scores by exact n-grams, each its own bucket, without the operator's hashes."""
    grams = [[*(w := SPLIT.findall(t)), *zip(w, w[1:], strict=False)] for t in texts]
    raw, good = collections.Counter(g for k in grams for g in k), collections.Counter(g for i in target for g in grams[i])
    scale, prior = good.total() / raw.total(), prior * good.total()
    return [sum(math.log((good[g] + prior) / (raw[g] * scale + prior)) for g in k) / max(len(k), 1) for k in grams]


def good_and_junk(n_good, n_junk, seed=5):
    r = random.Random(seed)
    good = [" ".join(r.choice("the of and house tree walks on a day in town under rain with old friends who sing at night".split()) for _ in range(80)) + f" {i}" for i in range(n_good)]
    return good + [" ".join(r.choice("BUY!! $$$ WIN## now the CLICK here best price >>> free pills www cash deal hot offer today only you".split()) for _ in range(80)) + f" {i}" for i in range(n_junk)]


def test_quality_score_by_hand(spark):
    texts = good_and_junk(60, 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(60, 66)] + [(1, 1, 1), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    parts = {r.doc_id: r.part for r in quality.labelled(labels).collect()}
    assert set(parts) == {*range(0, 60, 2), *range(60, 66)} and all((parts[i] == 2) == (i >= 60) for i in parts)  # toxic ones are not trusted
    rows = {x.doc_id: x for x in quality.judge(docs, labels).collect()}
    want = python_score(texts, [i for i, p in parts.items() if p == 0])
    assert all(abs(rows[i].score - x) < 1e-4 for i, x in enumerate(want))
    assert all(rows[i].kept == (i < 60) for i in rows)
    assert not any(x.kept for x in quality.judge(docs, labels, threshold=9.0).collect())


def test_verdict_is_alike_at_every_size(spark):
    for n_good, step in ((250, 5), (3000, 1)):  # 50 labels, 3000 labels
        texts = good_and_junk(n_good, n_good // 10)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        for bad in (range(n_good, n_good + n_good // 20), ()):
            labels = spark.createDataFrame([(i, 1, 0) for i in range(0, n_good, step)] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int")
            kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
            assert len(kept & set(range(n_good))) >= 0.99 * n_good and not kept - set(range(n_good))


def test_cut():
    assert quality.best_cut(np.array([1.0, 2, 3]), np.array([-3.0, -1])) == 0
    assert quality.best_cut(np.array([1.0, 2, 3]), np.array([])) < 1 and quality.best_cut(np.array([]), np.array([1.0])) == -np.inf
    r = np.random.default_rng(2)
    good, bad = r.normal(1, 1, 300), r.normal(-1, 1, 200)
    cut = quality.best_cut(good, bad)
    shares = lambda x: (good >= x).mean() + (bad < x).mean()
    assert shares(cut) == pytest.approx(max(shares(x) for x in np.concatenate([good, bad])))


def test_all_labels_count(spark, monkeypatch):
    many = spark.range(120_001).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    assert {r.part: r["count"] for r in quality.labelled(many.selectExpr("doc_id", "quality", "toxic")).withColumn("part", quality.F.expr("IF(part = 2, 2, 0)")).groupBy("part").count().collect()} == {0: 60_000, 2: 60_001}
    # one score of many documents counts as often as it occurs, also beyond a thousand
    r = np.random.default_rng(4)
    good, bad, n_good, n_bad = r.normal(1, 1, 50).round(2), r.normal(-1, 1, 60).round(2), r.integers(1, 5000, 50), r.integers(1, 5000, 60)
    assert quality.best_cut(good, bad, n_good, n_bad) == quality.best_cut(np.repeat(good, n_good), np.repeat(bad, n_bad))
    low, middle = np.quantile(np.repeat(good, n_good), [0.01, 0.5])
    assert quality.best_cut(good, np.array([]), n_good) == pytest.approx(2 * low - middle)
    # labels beyond what is sent to the executors are joined by an exchange, to the same verdicts
    texts = good_and_junk(120, 40)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int")
    sent = sorted(map(tuple, quality.judge(docs, labels).collect()), key=str)
    monkeypatch.setattr(quality, "MOST_SENT", 0)
    assert sorted(map(tuple, quality.judge(docs, labels).collect()), key=str) == sent and len(sent) == 162


def test_kept_rows_with_clashing_columns(spark, hard):
    texts = good_and_junk(40, 10)
    docs = spark.createDataFrame([(i % 30, t, "k", 1.5, 7, ["a"]) for i, t in enumerate(texts)], "doc_id long, text string, kept string, score double, n_words int, own0 array<string>")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality.kept_rows(docs, labels)
    assert got.columns == docs.columns and got.count() > 0 and got.where("kept <> 'k' OR score <> 1.5 OR n_words <> 7 OR own0[0] <> 'a'").isEmpty()
    assert quality.judge(docs, labels).count() == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = [None, "b", "a", "zz", "é", "tiny"]
    rows = [(i if i % 7 else 5, None if i == 3 else "w " * r.randint(0, 40), r.choices(names, [1, 9, 5, 3, 2, 0.2])[0]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mixing.ORACLE).fetchdf()
    key = lambda f: sorted((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in f.itertuples())
    got_rows = [tuple(v) for v in got.itertuples(index=False)]
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in got_rows) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False))
    assert (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() - got["size"].sum()) <= 40 * 3 * len(names)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns
    assert kept.selectExpr("sum(size(filter(split(text, ' '), x -> x <> '')))").first()[0] == got.taken.sum()


def test_targets_are_met_whatever_the_ids(spark):
    """Rows without an id, of one id, and equal in everything: no source misses its target by more than half a row."""
    rows = [(None, f"w{i} " * (1 + i % 20), "a") for i in range(1000)] + [(7, f"v{i} " * 10, "b") for i in range(700)] + [(None, "same words of it", "c")] * 900 + [(i, "x " * (i % 30), None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "s").withColumnRenamed("s", "source").repartition(5)
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert len(got) == 4 and all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1e-6 for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    clash = docs.selectExpr("*", "'h' AS hash", "1 AS times", "2 AS repeats", "3 AS row", "4 AS edge_rows", "5 AS _hash")
    kept = mixing.mixed(clash)
    assert kept.columns == clash.columns and kept.where("hash <> 'h' OR times <> 1 OR row <> 3").isEmpty()
    assert kept.where("source = 'c'").count() == mixing.mix(docs).where("source = 'c'").selectExpr("sum(times)").first()[0]


def test_mixing_of_hard_rows(hard, empty):
    assert mixing.mix(hard).count() == hard.count() and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(hard).columns == hard.columns


def test_many_sources_are_joined_with_salts(spark, monkeypatch):
    from lexiforge.llm import shared

    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 5}" if i % 3 else None) for i in range(120)], "doc_id long, text string, source string")
    sent = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(shared, "MOST_SENT", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sent


def kt(bits):
    p, n = 1.0, [0, 0]
    for b in bits:
        p *= (n[b] + 0.5) / (n[0] + n[1] + 1)
        n[b] += 1
    return p


def test_estimates_by_hand():
    assert np.exp(ctw.kt_log(np.array([0, 3, 2]), np.array([0, 1, 2]))) == pytest.approx([1.0, kt([0, 0, 0, 1]), kt([0, 1, 0, 1])])
    assert ctw._lgamma(np.array([0.5, 1.0, 7.5, 300.5])) == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 7.5, 300.5)], abs=1e-10)
    symbols = np.zeros((1, 256), np.int64)
    symbols[0, [97, 98]] = [3, 2]
    zeros, ones = ctw.bit_counts(symbols)
    assert (zeros[0, 0], ones[0, 0]) == (5, 0) and zeros[0].sum() + ones[0].sum() == 5 * 8


def test_model_is_a_distribution_and_mixes(spark):
    texts = ["abracadabra " * 30, "the cat sat on the mat " * 20, "", None]
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    counted = docs.selectExpr("true AS train", "text").mapInArrow(ctw._count, "kind byte, key long, n long")
    counts = counted.where("kind = 0").groupBy("key").sum("n").toDF("key", "n")
    model = ctw.fit_model(counts, depth=3, share=0.0)
    assert np.allclose((10.0 ** model.log10.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    # one context by hand: at depth 0 the first decision mixes its own estimate with that of its children
    known = {r.key: r.n for r in counts.collect()}
    total = collections.Counter()
    for key, n in known.items():
        total[(key >> 8) & 255, key & 255] += n
    flat = ctw.fit_model(counts, depth=0, share=0.0)
    symbols = np.zeros((1, 256), np.int64)
    for (_, s), n in total.items():
        symbols[0, s] += n
    zeros, ones = ctw.bit_counts(symbols)
    node, bits = 1, []
    for shift in range(7, -1, -1):
        bit = (97 >> shift) & 1
        c = (zeros, ones)[bit][0, node - 1]
        bits.append((c + 0.5) / (zeros[0, node - 1] + ones[0, node - 1] + 1))
        node = 2 * node + bit
    assert flat.log10[0, 97] == pytest.approx(math.log10(math.prod(bits)), abs=1e-5)
    one = next(blocks(pa.array(["abracadabra", "qzxqzx"])))
    good, bad = model.score(one) / np.array([12, 7])
    assert good > bad and model.score(one)[0] > flat.score(one)[0]


def test_scores(spark):
    texts = [*texts_of(3, 200), None, "", "Unseen-word-here only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in ctw.score_documents(docs, frequent=3).collect()}
    split = {i: [*SPLIT.findall((t or "").translate(LOW)), None] for i, t in enumerate(texts)}
    train = [i for i in split if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in split[i])
    n, v = sum(count.values()), len(count)
    for i, ws in split.items():
        r = rows[i]
        assert r.held_out == (i not in set(train)) and r.n_tokens == len(ws) and r.train_tokens == n and r.n_known == sum(count[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    held = [i for i in split if i not in set(train) and len(texts[i] or "") > 100]
    assert sum(-rows[i].score * math.log2(10) for i in held) / sum(len(texts[i].encode()) + 1 for i in held) < 4


def test_scores_of_hard_rows(hard, empty):
    assert ctw.score_documents(hard).count() == hard.count() and ctw.score_documents(empty).count() == 0


class PlainTree:
    """Context-tree weighting as the definition reads: a dict of nodes a decision, weights by recursion in logarithms."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, collections.defaultdict(lambda: [0, 0])
        for t in texts:
            for context, node, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.counts[node, context[:d]][bit] += 1
        self.longer = collections.defaultdict(list)
        for node, context in self.counts:
            if context:
                self.longer[node, context[:-1]].append(context)
        self.weights = {}

    def decisions(self, t):
        data = t.encode() + b"\xff"
        for i, c in enumerate(data):
            context = tuple(data[i - d] if i >= d else 0 for d in range(1, self.depth + 1))  # the nearest byte first
            node = 1
            for shift in range(7, -1, -1):
                bit = (c >> shift) & 1
                yield context, node, bit
                node = 2 * node + bit

    def kt(self, zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weight(self, node, context):
        if (node, context) not in self.weights:
            own = self.kt(*self.counts[node, context])
            if len(context) < self.depth:
                below = sum(self.weight(node, c) for c in self.longer[node, context])
                own = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
            self.weights[node, context] = own
        return self.weights[node, context]

    def score(self, t):
        """log10 of the probability; a context without training text is a leaf whose estimate is a half."""
        total = 0.0
        for context, node, bit in self.decisions(t):
            p, reach = 0.0, 1.0
            for d in range(self.depth + 1):
                zeros, ones = self.counts[node, context[:d]] if (node, context[:d]) in self.counts else (0, 0)
                stop = 1.0
                if d < self.depth and zeros + ones:
                    stop = math.exp(self.kt(zeros, ones) - math.log(2) - self.weight(node, context[:d]))
                elif d < self.depth:
                    stop = 0.5
                p += reach * stop * ((zeros, ones)[bit] + 0.5) / (zeros + ones + 1)
                reach *= 1 - stop
            total += math.log10(p)
        return total


def test_scores_by_the_definition(spark):
    r = random.Random(12)
    texts = ["".join(r.choice(["ab", "ra", "cad", " ", "é", "Zx", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "unseen QQ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lower = [(t or "").translate(LOW) for t in texts]
    tree = PlainTree([t for i, t in enumerate(lower) if zlib.crc32(str(i).encode()) % 10], ctw.DEPTH)
    rows = {x.doc_id: x.score for x in ctw.score_documents(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == pytest.approx([tree.score(t) for t in lower], rel=1e-5, abs=1e-5)


def test_shards_keep_every_context(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 400))) for _ in range(150)]
    texts += [None, "", "a퟿b 😀", "zebra quagga okapi " * 3] + ["common words here " * 200] * 30  # rare contexts beside very common ones
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    counted = spark.createDataFrame([(True, texts[i] or "") for i in train], "train boolean, text string").mapInArrow(ctw._count, "kind byte, key long, n long")
    whole = ctw.fit_model(counted.where("kind = 0").groupBy("key").sum("n").toDF("key", "n"), share=0.0)
    want = [float(whole.score(next(blocks(pa.array([t or ""]))))[0]) for t in texts]
    for sent in (0, 50, 1 << 20):  # what is sent changes no score
        rows = {x.doc_id: x.score for x in ctw.score_documents(docs, frequent_grams_sent=sent).collect()}
        assert [rows[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_nodes_grow_with_the_corpus(spark):
    """A context that held less than 1/32768 of the training bytes was no node: its text could not become likelier."""
    rare = "wolds pray velmo nisare"
    filler = [" ".join(r.choice(["some", "very", "plain", "words"]) for _ in range(3000)) for r in map(random.Random, range(100))]
    n = len(filler)
    texts = [*filler, *[f"{rare} {rare}"] * 12, rare]
    ids = [i for i in range(10 * len(texts)) if zlib.crc32(str(i).encode()) % 10][: n + 12] + [next(i for i in range(10**6, 10**6 + 1000) if not zlib.crc32(str(i).encode()) % 10)]
    rows = {x.doc_id: x for x in ctw.score_documents(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert rows[ids[-1]].held_out and -rows[ids[-1]].score * math.log2(10) / (len(rare) + 1) < 0.4  # 0.57 with the share, 0.29 without
