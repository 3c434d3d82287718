"""op5, op7 and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import graph, nearcopies, topk
from lexiforge.llm.graph import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = SPLIT.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    groups = collections.defaultdict(list)
    for i in range(n):
        groups[label[i]].append(rows[i][0])
    return [(rows[i][0], min((x for x in groups[label[i]] if x is not None), default=None), len(links[i])) for i in range(n)]


def corpus(seed, n=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(5, 120))] + (shared if r.random() < 0.4 else [])
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice(["  ", " ", "\n"]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    return texts


def test_near_copies(spark, monkeypatch):
    texts = [*corpus(1), *corpus(2), None, "", " ", "two words", "Two  Words", "one", "one"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in nearcopies.near_copies(docs).collect())
    assert got == sorted(brute(rows))
    monkeypatch.setattr(nearcopies, "CHUNK", 3)  # every group is cut into cells
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in nearcopies.near_copies(docs).collect()) == got


def test_near_copies_of_hard_rows(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in nearcopies.near_copies(hard).collect()), key=key)
    want = brute(rows)
    # rows without shingles stand alone
    assert got == sorted(((i, c if shingles(t) else i, n) for (i, t), (_, c, n) in zip(rows, want, strict=True)), key=key)
    assert nearcopies.near_copies(empty).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        depth = nearcopies.enough_depth(similarity)
        reached = lambda d: 1 - (1 - similarity**d) ** nearcopies.TREES  # noqa: B023, E731
        assert reached(depth) >= nearcopies.TARGET_RECALL and (depth == nearcopies.LEVELS or reached(depth + 1) < nearcopies.TARGET_RECALL)
        shallow = min(nearcopies.SHALLOW, depth)
        r = np.random.default_rng(1)
        for crowded in (1, 5, 32):
            sizes = np.sort(r.integers(1, 5000, (crowded, nearcopies.LEVELS - shallow + 1)), axis=1)[:, ::-1]
            depths = nearcopies.asked_depths(sizes, shallow, similarity)
            total = nearcopies.missed(similarity, depths).sum() + (nearcopies.TREES - crowded) * nearcopies.missed(similarity, shallow)
            assert 1 - np.exp(total) >= nearcopies.TARGET_RECALL and (shallow <= depths).all()
    crowd = lambda trees, n: nearcopies.asked_depths(np.full((trees, nearcopies.LEVELS - 3), n), 4, 0.8).tolist()
    assert crowd(32, 9) == [4] * 32  # nodes stay small
    assert crowd(4, 100_000) == [8] * 4  # the other trees reach the recall
    assert crowd(32, 100_000) == [nearcopies.enough_depth(0.8)] * 32


def test_other_similarities(spark):
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    for similarity in (0.6, 0.9):
        want = [sum(j != i and len(a & b) >= similarity * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
        got = {r.doc_id: r.n_links for r in nearcopies.near_copies(docs, similarity).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_crowded_tries(spark, monkeypatch):
    """A group of many different near copies, so that prefixes are crowded, cells are cut and parts are small."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = [*corpus(7)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nearcopies, "CHUNK", 16)
    monkeypatch.setattr(nearcopies, "PART_BYTES", 4000)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in nearcopies.near_copies(docs).collect()) == sorted(brute(rows))


@pytest.mark.parametrize("counted", [True, False])
def test_growing_tables_are_not_broadcast(spark, monkeypatch, counted):
    """The driver holds only what has a bound: the ids of wanted texts up to a number, and the sets that many rows share."""
    plans, write = [], nearcopies.materialise

    def seen(df, name, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, **options)

    for module in (nearcopies, graph):
        monkeypatch.setattr(module, "materialise", seen)
    monkeypatch.setattr(nearcopies, "CHUNK", 4)
    monkeypatch.setattr(nearcopies, "MOST_WANTED", 0)
    rows = list(enumerate(corpus(7)))
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), counted=counted)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got.collect()) == sorted((i, c, n if counted else min(n, 1)) for i, c, n in brute(rows))
    assert len(plans) > 10 and [name for name, plan in plans if "Broadcast" in plan] == []
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2  # weight * 1000 > rows


def test_classes_without_counts(spark, monkeypatch):
    """Large groups by stars: one of near copies, one whose ends are no near copies of each other, and texts with common words."""
    r = random.Random(12)
    texts = [*corpus(7)]
    base, chain, shared = ([f"{k}{i}" for i in range(150)] for k in "wcs")
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        texts += [" ".join(w), " ".join(chain[i:] + [f"d{k}" for k in range(i)]), " ".join(shared[:100] + [f"y{r.randrange(10**6)}" for _ in range(40)])]
    rows = list(enumerate([*texts, texts[5], None, "two words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((i, c, min(n, 1)) for i, c, n in brute(rows))
    for chunk in (4, 20, 512):
        monkeypatch.setattr(nearcopies, "CHUNK", chunk)
        assert sorted((x.doc_id, x.class_id, x.n_links) for x in nearcopies.near_copies(docs, counted=False).collect()) == want
    for rounds in (0, 1):
        monkeypatch.setattr(nearcopies, "CHUNK", 4)
        monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
        assert sorted((x.doc_id, x.class_id, x.n_links) for x in nearcopies.near_copies(docs, counted=False).collect()) == want


def test_nodes_of_a_crowd_are_found_once_a_path(spark, monkeypatch):
    """Texts that share paths in many trees: prefixes of each depth meet their sizes by path, not by text."""
    r = random.Random(21)
    rows = []
    for i in range(400):
        s = bytearray(r.randbytes(1)[0] if r.random() < 0.02 else k % 251 for k in range(nearcopies.TREES * nearcopies.LEVELS))
        rows.append((i + 1, 100, bytes(s)))
    classes = spark.createDataFrame(rows, "rep long, size int, signature binary").repartition(4)
    made, join = [], nearcopies.salted_join

    def counting(rows, table, keys, how="inner", salts=16):
        out = join(rows, table, keys, how, salts)
        made.append((keys, out.count()))
        return out

    monkeypatch.setattr(nearcopies, "salted_join", counting)
    cells, depths = nearcopies.forest_cells(classes, 0.8)
    by_node = [n for keys, n in made if keys == ["place", "prefix"]]
    assert sum(by_node[:-1]) < 400 * nearcopies.TREES  # the last one gives the cells themselves
    # sizes by hand: every text's cell is a node that holds it
    path = {rep: nearcopies.paths_of(np.frombuffer(s, np.uint8)[None, :])[0] for rep, _, s in rows}
    members = collections.defaultdict(set)
    for x in cells.collect():
        assert int(path[x.rep][x.place // 16]) >> 8 * (nearcopies.LEVELS - x.place % 16) == x.prefix & (2**64 - 1)
        members[x.place, x.prefix, x.texts].add(x.rep)
    assert members and all(n == len(reps) for (_, _, n), reps in members.items())
    assert len(depths.collect()) == 400


def test_stars_start_in_the_middle(spark, monkeypatch):
    """A round whose first root is near to nothing is followed by one with another root."""
    monkeypatch.setattr(nearcopies, "CHUNK", 4)
    sets = {i: np.arange(100, dtype=np.uint64) for i in range(2, 40)} | {1: np.arange(500, 600, dtype=np.uint64)}
    large = spark.createDataFrame([(place, 7, rep) for place in (16, 32) for rep in sets if place == 16 or rep > 1], "place int, prefix long, rep long")
    held = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "rep long, shingles binary")
    named, links = nearcopies._stars(large, lambda reps: held.join(reps.distinct(), "rep", "left_semi"), 0.8)
    assert {x.component for x in named.where("rep BETWEEN 2 AND 38").collect()} == {2}  # 39 was the largest component of one and waits for the others
    assert links.count() >= 36


def test_a_connected_cell_is_not_spread(spark):
    """Rows of a large cell grow with its size, not with its square; every pair that links do not connect yet meets once."""
    cell = lambda n, apart: spark.range(n).selectExpr("16 AS place", "CAST(7 AS long) AS prefix", "id AS rep", f"IF(id < {apart}, id, {apart}) AS component")
    assert nearcopies.across(cell(4000, 0), 50).count() == 0
    assert nearcopies.across(cell(4000, 10), 50).count() == 3990 + 10 * 81
    met = nearcopies.across(cell(60, 20), 8).collect()
    groups = collections.defaultdict(list)
    for x in met:
        groups[x.pair].append((x.rep, x.chunk))
    pairs = [(a, b) for pair, g in groups.items() for a, ca in g for b, cb in g if a < b and ((pair >> 31) == (pair & 0x7FFFFFFF) or ca != cb)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in range(20) for b in range(a + 1, 60)}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(400, 20)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[50:90] = vectors[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (920, [1.0, None]), (940, [float("nan")] * 20), (960, [float("inf")]), (980, [0.5, -0.25]), (1000, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for x in topk.exact_top_k(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    whole = {i: np.floor(np.float64(64) * np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    padded = {i: np.pad(v, (0, 20 - len(v))) for i, v in whole.items()}
    for q in [i for i in padded if i % 20 == 0]:
        best = sorted(((-int(padded[q] @ v), i) for i, v in padded.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {i for i in padded if i % 20 == 0}


def test_top_k_of_large_whole_numbers():
    """Ties and near ties of scores near 2**40 and above 2**53, seen block by block."""
    r = np.random.default_rng(0)
    for size in (1e4, 1e5, 1e6, 1e8):
        q = np.floor(r.normal(size=(40, 7)) * size)
        c = np.floor(r.normal(size=(40, 500)) * size)
        c[:, 100:160] = q[:, [3]]
        c[:, 160:200] = c[:, [100]] + r.integers(0, 2, (40, 40))
        ids, best = r.permutation(500), topk.Best(np.arange(1000, 1007), q, 20)
        for at in range(0, 500, 170):
            best.see(ids[at : at + 170], c[:, at : at + 170])
        exact = q.astype(np.int64).astype(object).T @ c.astype(np.int64).astype(object)
        for i in range(7):
            want = sorted((-x, j) for x, j in zip(exact[i], ids.tolist(), strict=True))[:20]
            assert [(-s, j) for j, s in zip(best.found[best.rows == i].tolist(), best.scores[best.rows == i].tolist(), strict=True)] == want


def test_top_k_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 0, "x", i) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, block string, query_id long")
    got = topk.exact_top_k(frame, F.col("vec_id") % 20 == 0, k=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 15


def test_top_k_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.exact_top_k(few, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 20, 4096), (0, 2, 3, 0), (20, 1, 0, 4096), (20, 2, 3, 0)]
    assert topk.exact_top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.exact_top_k(few, F.col("vec_id") < 0).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from lexiforge.llm import mixing, personal

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = P.quality_rules(spark, docs, data)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {i for i, c, _ in brute(rows) if i == c}
    one = P.ngram_join(spark, kept, data)
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    hidden = P.personal_data(spark, one, data)
    assert all(not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text) for r in hidden.collect()) and hidden.columns == docs.columns
    mixed = P.source_mix(spark, hidden, data)
    times = {r.doc_id: r.times for r in mixing.mix(hidden).collect() if r.times}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(times)
    final = P.run(spark, data).collect()
    tokens = collections.Counter()
    for r in final:
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(times)
    per_doc = {r.doc_id: r.doc_tokens for r in final}
    assert all(tokens[i] == per_doc[i] * times[i] for i in times)
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, data)
        assert empty.count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (None, c), (None, c), (None, c + " more"), (3, "other words " + b[:40]), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, P.ngram_join(spark, docs, "").collect()), key=str)
    left = [x for x in got if x[1] not in (c, c + " more")]
    assert left == sorted([(1, a), (1, b), (3, "other words " + b[:40]), (None, None), (4, None)], key=str) and len(got) == len(left) + 1


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Columns named as those that the stages use inside, ids repeated and missing: all stages but the last keep them."""
    import corpus_pipeline as P

    data = "/root/testdata/sf0.001"
    names = ["kept", "score", "n_words", "hash", "row", "number", "times", "repeats", "rep", "_hash", "doc", "class_id", "base_failed", "_judged", "label", "text_length"]
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 9))
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("lang")).alias(n) for n in names]).cache()
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        assert all(after.where(~F.col(f"`{n}`").eqNullSafe(F.concat(F.lit(f"{n} "), F.col("lang")))).isEmpty() for n in names), name
        docs = after.cache()
    pieces = P.STAGES[-1][1](spark, docs, data)
    assert pieces.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == docs.count() > 0
