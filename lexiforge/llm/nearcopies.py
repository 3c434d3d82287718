"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its five-word shingles (A-Z lower-cased; a shorter text is one shingle of all its words). Texts with
the same set form a class and go on as one representative. Its signature is a path of LEVELS minimum hashes, a byte each,
in every one of TREES prefix tries; two paths share a prefix of d levels with the probability s^d of their similarity s.

Prefixes start at full length and are shortened as far as it takes. A prefix of ``shallow`` levels with few texts is not
looked at further: its node is a cell. Where more texts tie, each of them asks for the shortest prefixes whose nodes stay
small, allowing ever larger nodes until a pair at the threshold meets in some tree with the target recall; if nothing else
reaches it, all trees are shortened to ``enough_depth``, where it holds for certain. A node that one of its texts asks for
is a cell for all of them, so a text has one cell in each tree, and the recall holds for every text.

A cell's pairs that have no earlier cell in common, and whose signatures and sizes leave the threshold within reach (six
standard deviations), are verified exactly on their shingle sets. So each pair is looked at in full once. Cells of the
same texts in several trees are one cell. A large cell is cut into chunks, each pair of chunks being a cell of its own;
sets are verified in parts of bounded size. A cell returns for each text how many documents it links and one link to a
smaller member; pairs are never expanded.

Where only classes are asked for, pairs of texts that links connect already need no look. Each text of a large cell is
verified against one text of the cell first; what this leaves apart is tried again with another one, in a few rounds. Then
only the texts outside a cell's largest component meet the others: a group of n near copies takes n verifications, not n^2.

Results: class_id, the smallest doc_id that verified links reach; copy_of, the representative of an equal set; n_links, the
documents whose similarity is at least the threshold (copies of the same set included). Null and empty texts have no
shingles: they are in a class of their own, with no links. Each row counts by itself, also if it shares a doc_id with
others or has none (then class_id is null only if no linked row has one). An empty table gives no rows. Texts are whole,
whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.graph import components
from lexiforge.llm.shared import arrow_map, exchanged, materialise, salted_join
from lexiforge.llm.words import Block, blocks, hashes, mix, windows, words

SHINGLE, SIMILARITY = 5, 0.8
TREES, LEVELS, TARGET_RECALL = 32, 8, 0.99999
SHALLOW = 4  # levels of the shortest prefix
SMALL = 8  # texts of a node that is a cell at once
CHUNK = 512  # texts of a chunk
PART_BYTES = 32 << 20  # of the sets verified together
NO_CELL = LEVELS + 1
MOST_WANTED = 500_000  # ids that are broadcast to choose texts: about 50 MB in the driver; for more, the texts are dealt by id
ROUNDS = 4  # of stars in large cells; the pairs that they leave apart are all looked at

_rng = np.random.default_rng(77)
_MULTIPLY = (_rng.integers(1, 2**31, TREES * LEVELS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, TREES * LEVELS, dtype=np.uint32)


def missed(similarity: float, depth: np.ndarray | float) -> np.ndarray | float:
    """Logarithm of the probability that a pair does not share a prefix of that depth in one tree."""
    return np.log1p(-(min(similarity, 1 - 1e-9) ** depth))


def enough_depth(similarity: float, recall: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair of that similarity meets in one of the trees with the target recall."""
    depth = LEVELS
    while depth > 1 and TREES * missed(similarity, depth) > math.log(1 - recall):
        depth -= 1
    return depth


def shingle_sets(block: Block, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    w = words(block)
    h = hashes(block, w, lower=True)
    grams, at = windows(h, w, k)
    edges = np.searchsorted(at, w.first)
    for i in range(len(block)):
        if edges[i] < edges[i + 1]:
            yield np.unique(grams[edges[i] : edges[i + 1]])
        elif w.first[i] < w.first[i + 1]:
            whole = np.zeros(1, np.uint64)
            for x in h[w.first[i] : w.first[i + 1]]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + x)
            yield mix(whole + np.uint64(w.first[i + 1] - w.first[i]))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * LEVELS minimum hashes, a byte of each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * LEVELS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[None, at : at + 256] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


NO_SHINGLES = 0


def set_key(shingles: np.ndarray) -> int:
    """A number that stands for the set: equal for equal sets, NO_SHINGLES for the empty one."""
    if not len(shingles):
        return NO_SHINGLES
    parts = np.array([np.bitwise_xor.reduce(mix(shingles)), mix(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64), len(shingles)], np.uint64)
    key = np.zeros(1, np.uint64)
    for x in parts:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + x)
    return int(key.view(np.int64)[0]) or 1


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "rep", "size", "signature"]
    for batch in batches:
        for block in blocks(batch.column(1)):
            n = len(block)
            keys, sizes, signatures = [NO_SHINGLES] * n, [0] * n, [b""] * n
            for i, s in enumerate(shingle_sets(block)):
                if len(s):
                    keys[i], sizes[i], signatures[i] = set_key(s), len(s), signature(s).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names)


def paths_of(signatures: np.ndarray) -> np.ndarray:
    """Paths (rows by trees) of signatures (rows by bytes): the first level is the highest byte."""
    return np.ascontiguousarray(signatures).view(">u8").astype(np.uint64)


def _spread(shallow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, root, path) for each tree; root: the tree and the shortest prefix."""
        for batch in batches:
            path = paths_of(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, TREES * LEVELS))
            root = (path >> np.uint64(8 * (LEVELS - shallow))) | (np.arange(TREES, dtype=np.uint64) << np.uint64(8 * shallow))[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(root.ravel().view(np.int64)), pa.array(path.ravel().view(np.int64))], ["rep", "root", "path"])

    return run


def asked_depths(sizes: np.ndarray, shallow: int, similarity: float, recall: float = TARGET_RECALL) -> np.ndarray:
    """How far each crowded tree's prefix is shortened for one text.

    sizes: crowded trees by the depths from ``shallow`` to LEVELS, the texts of the node there. Other trees are at ``shallow``.
    """
    goal = math.log(1 - recall) - (TREES - len(sizes)) * missed(similarity, shallow)
    for allowed in (SMALL, 8 * SMALL, 64 * SMALL):
        fits = sizes <= allowed
        depth = np.where(fits.any(axis=1), shallow + fits.argmax(axis=1), LEVELS)
        if missed(similarity, depth).sum() <= goal:
            return depth
    return np.full(len(sizes), max(shallow, enough_depth(similarity, recall)))


def _ask(shallow: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, prefix) of the nodes that texts ask for. Columns: rep, nodes (place, prefix, n)."""
        for batch in batches:
            lists, nodes = batch.column(1).offsets.to_numpy(), batch.column(1).values
            place, prefix, n = (nodes.field(i).to_numpy() for i in range(3))
            out = []
            for a, b in zip(lists[:-1].tolist(), lists[1:].tolist(), strict=True):
                trees, row = np.unique(place[a:b] // 16, return_inverse=True)
                sizes = np.ones((len(trees), LEVELS - shallow + 1), np.int64)
                sizes[row, place[a:b] % 16 - shallow] = n[a:b]
                out.append(a + np.flatnonzero(place[a:b] % 16 == asked_depths(sizes, shallow, similarity)[row]))
            found = np.concatenate([np.zeros(0, np.int64), *out])
            found = found[n[found] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(place[found]), pa.array(prefix[found])], ["place", "prefix"])

    return run


def forest_cells(classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(place, prefix, rep, texts) of all cells with two texts or more, and rep, depths of texts in crowded trees.

    place: the tree times 16 plus the prefix's depth; depths: the places of the text's cells in crowded trees.
    """
    shallow = min(SHALLOW, enough_depth(similarity))
    tries = arrow_map(classes.select("rep", "signature"), _spread(shallow), "rep long, root long, path long")
    tied = materialise(tries.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "ties")
    inside = materialise(salted_join(tries, tied, ["root"], salts=4), "tied")
    tree = F.shiftright("root", 8 * shallow).cast("int")
    near = inside.where(F.col("n") <= SMALL).select((tree * 16 + shallow).alias("place"), F.shiftrightunsigned("path", 8 * (LEVELS - shallow)).alias("prefix"), "rep")
    # texts of one path have the same nodes: these are found once for each path, and given to its texts after that
    crowded = inside.where(F.col("n") > SMALL).select("rep", "root", "path", "n")
    paths = materialise(crowded.groupBy("root", "path", "n").agg(F.count("*").alias("texts")), "paths")
    steps = F.explode(F.array(*[F.struct((tree * 16 + d).alias("place"), F.shiftrightunsigned("path", 8 * (LEVELS - d)).alias("prefix")) for d in range(shallow, LEVELS + 1)]))
    levels = paths.select("root", "path", "n", "texts", steps.alias("_s")).select("root", "path", "n", "texts", "_s.*")
    top = F.col("place") % 16 == shallow  # the root, whose size is known
    deeper = levels.where(~top)
    sizes = materialise(deeper.groupBy("place", "prefix").agg(F.sum("texts").alias("n")).where("n > 1"), "sizes")
    known = salted_join(deeper.select("root", "path", "place", "prefix"), sizes, ["place", "prefix"]).unionByName(levels.where(top).select("root", "path", "place", "prefix", "n"))
    nodes = known.groupBy("root", "path").agg(F.collect_list(F.struct("place", "prefix", "n")).alias("nodes"))  # five at most
    told = salted_join(crowded.drop("n"), nodes, ["root", "path"], salts=4).groupBy("rep").agg(F.flatten(F.collect_list("nodes")).alias("nodes"))
    asked = materialise(arrow_map(told, _ask(shallow, similarity), "place int, prefix long").distinct(), "asked")
    held = salted_join(levels.select("root", "path", "place", "prefix"), asked, ["place", "prefix"])
    shortest = held.groupBy("root", "path").agg(F.min(F.struct("place", "prefix")).alias("_m")).select("root", "path", "_m.*")
    placed = materialise(salted_join(crowded.drop("n"), shortest, ["root", "path"], "left", salts=4).select("rep", tree.alias("tree"), "place", "prefix"), "placed")
    depths = placed.groupBy("rep").agg(F.collect_list(F.coalesce("place", F.col("tree") * 16 + NO_CELL)).alias("depths"))
    cells = near.unionByName(placed.where("place IS NOT NULL").select("place", "prefix", "rep"))
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    known = cells.groupBy("place", "prefix").agg(F.count("*").alias("texts"), *marks).where("texts > 1")
    first = known.groupBy("texts", "mark1", "mark2").agg(F.min(F.struct("place", "prefix")).alias("_m")).select("texts", "_m.*")
    first = materialise(first, "cells")
    return salted_join(cells, first, ["place", "prefix"]), depths


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)])
        breaks = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(breaks):
            yield table.slice(0, int(breaks[-1]))
            held = table.slice(int(breaks[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)])
    return np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))


def in_chunks(cells: DataFrame, chunk: int) -> DataFrame:
    """cells with chunk and pair: each pair of a cell's chunks, and each chunk alone. A cell of up to ``chunk`` texts has one."""
    sized = cells.withColumn("_chunks", F.ceil(F.col("texts") / chunk).cast("int"))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("_chunks")).cast("int"))
    spread = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
    pair = F.least("chunk", "_other").cast("long") * F.lit(1 << 31) + F.greatest("chunk", "_other")
    return spread.withColumn("pair", pair).drop("_chunks", "_other", "texts")


def _largest(named: DataFrame) -> DataFrame:
    """place, prefix, main, inside, outside: of each cell the largest component, its texts and the other ones."""
    counts = named.groupBy("place", "prefix", "component").agg(F.count("*").alias("n"))
    best = counts.groupBy("place", "prefix").agg(F.max(F.struct("n", "component")).alias("_m"), F.sum("n").alias("_all"))
    return best.select("place", "prefix", F.col("_m.component").alias("main"), F.col("_m.n").alias("inside"), (F.col("_all") - F.col("_m.n")).alias("outside"))


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, root) of the pairs that are linked. Columns: rep, root, shingles, other."""
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
            linked = [c >= similarity * (len(x) + len(y) - c) - 1e-6 for x, y, c in zip(a, b, shared, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(linked, pa.bool_())) for i in (0, 1)], ["rep", "root"])

    return run


def _stars(large: DataFrame, sets_of, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """The texts of large cells (place, prefix, rep) with their component, and the links (rep, root) that were found on the way."""
    cell, links, tried, before = ["place", "prefix"], None, None, math.inf
    named = large.withColumn("component", F.col("rep"))
    for _ in range(ROUNDS):
        crowded = materialise(_largest(named).where(F.col("outside") > CHUNK), "crowded")
        left = crowded.agg(F.sum("outside")).head()[0] or 0
        if left == 0 or left > 0.9 * before:  # nothing is apart, or a round no longer pays
            break
        before = left
        apart = salted_join(named, crowded, cell).where("component <> main")
        # one star for each text, in the cell where most texts are left
        chosen = apart.groupBy("rep").agg(F.max(F.struct("outside", *cell)).alias("_m"), F.count("*").alias("met")).select("rep", "met", "_m.place", "_m.prefix")
        chosen = materialise(chosen, "apart")
        # the text that most cells hold is nearest to the middle of its group; each is a root once
        able = chosen if tried is None else chosen.join(exchanged(tried), "rep", "left_anti")
        centres = materialise(able.groupBy(*cell).agg(F.max(F.struct("met", "rep")).alias("_m")).select(*cell, F.col("_m.rep").alias("root")), "centres")
        tried = centres.select(F.col("root").alias("rep")) if tried is None else tried.unionByName(centres.select(F.col("root").alias("rep")))
        stars = materialise(salted_join(chosen, centres, cell).where("rep <> root").select("rep", "root"), "stars")
        roots = stars.select(F.col("root").alias("rep")).distinct()
        told = salted_join(stars.join(exchanged(sets_of(stars.select("rep"))), "rep"), sets_of(roots).select(F.col("rep").alias("root"), F.col("shingles").alias("other")), ["root"])
        found = materialise(arrow_map(told.select("rep", "root", "shingles", "other"), _alike(similarity), "rep long, root long"), "star-links")
        links = found if links is None else links.unionByName(found)
        joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "stars").withColumnRenamed("node", "rep")
        named = materialise(large.join(exchanged(joined), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    return named, links


def across(named: DataFrame, chunk: int) -> DataFrame:
    """place, prefix, rep, chunk, pair as of in_chunks, without the pairs inside a cell's largest component; cells of one component go."""
    left = salted_join(named, materialise(_largest(named).where("outside > 0"), "left"), ["place", "prefix"])
    inside, outside = (F.ceil(F.col(c) / chunk).cast("int") for c in ("inside", "outside"))
    main, dealt = F.col("component") == F.col("main"), F.xxhash64("rep", F.lit(5))
    own = F.when(main, F.pmod(dealt, inside)).otherwise(inside + F.pmod(dealt, outside)).cast("int")
    spread = left.withColumn("chunk", own).select("*", F.explode(F.sequence(F.when(main, inside).otherwise(F.lit(0)), inside + outside - 1)).alias("_other"))
    pair = F.least("chunk", "_other").cast("long") * F.lit(1 << 31) + F.greatest("chunk", "_other")
    return spread.select("place", "prefix", "rep", "chunk", pair.alias("pair"))


def _cell_keys(signatures: np.ndarray, depths: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """A number for the cell of each text (row) in each tree; texts share it if they share the cell."""
    shown = np.minimum(depths, LEVELS).astype(np.uint64)
    prefix = paths_of(signatures) >> (np.uint64(8) * (np.uint64(LEVELS) - shown))
    alone = mix(rep.view(np.uint64))[:, None] ^ np.uint64(0x5851F42D4C957F2D)
    return mix(np.where(depths > LEVELS, alone, prefix) ^ (depths.astype(np.uint64) << np.uint64(57)))


def _meet(shallow: int, similarity: float):
    least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / (TREES * LEVELS))

    def near(i: np.ndarray, j: np.ndarray, signature: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of these pairs the ones that may reach the similarity."""
        fits = np.flatnonzero(np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6)
        out = [fits[:0]]
        for lo in range(0, len(fits), 20_000):
            p = fits[lo : lo + 20_000]
            out.append(p[(signature[i[p]] == signature[j[p]]).sum(axis=1) >= least * TREES * LEVELS])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, prefix, pair, part, rep, partners): cells with pairs to verify, cut to parts of bounded size.

        partners: bits of the part's texts in order of rep. Columns: place, prefix, pair, rep, chunk, size, signature, depths.
        """
        names = ["place", "prefix", "pair", "part", "rep", "partners"]
        for table in runs(batches, 3):
            edges = _groups(table, 3)
            place, prefix, pair, rep, chunk, size = (table.column(c).to_numpy() for c in ("place", "prefix", "pair", "rep", "chunk", "size"))
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(rep), -1)
            depths = np.full((len(rep), TREES), shallow, np.int64)
            lists = table.column("depths").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            other = lists.flatten().to_numpy()
            depths[np.repeat(np.arange(len(rep)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)), other // 16] = other % 16
            keys, tree = _cell_keys(signature, depths, rep), place // 16
            crossing = (pair >> 31) != (pair & 0x7FFFFFFF)
            counts = np.diff(edges)
            group = np.repeat(np.arange(len(counts)), counts)
            little = np.repeat(counts <= SMALL, counts)
            ours, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, min(SMALL, len(rep))):
                i = np.flatnonzero(little[:-step] & (group[step:] == group[:-step]))
                i = i[~crossing[i] | (chunk[i] != chunk[i + step])]
                met = (keys[i] == keys[i + step]) & (np.arange(TREES)[None, :] < tree[i][:, None])
                i = i[~met.any(axis=1)]
                i = i[near(i, i + step, signature, size)]
                ours.append(i)
                theirs.append(i + step)
            for g in np.flatnonzero(counts > SMALL).tolist():
                for i in range(edges[g], edges[g + 1] - 1):
                    j = np.arange(i + 1, edges[g + 1])
                    if crossing[i]:
                        j = j[chunk[j] != chunk[i]]
                    for t in range(tree[i]):
                        j = j[keys[j, t] != keys[i, t]]
                        if not len(j):
                            break
                    j = j[near(np.full(len(j), i), j, signature, size)]
                    ours.append(np.full(len(j), i))
                    theirs.append(j)
            ours, theirs = np.concatenate(ours), np.concatenate(theirs)
            order = np.argsort(group[ours], kind="stable")
            ours, theirs = ours[order], theirs[order]
            cuts = np.flatnonzero(np.append(True, group[ours][1:] != group[ours][:-1])[: len(ours)])
            rows: list[list] = [[] for _ in names]
            for lo, hi in zip(cuts.tolist(), np.append(cuts, len(ours))[1:].tolist(), strict=True):
                for part, (members, bits) in enumerate(parts_of(ours[lo:hi], theirs[lo:hi], size)):
                    m = len(members)
                    for column, v in zip(rows, (place[members], prefix[members], pair[members], np.full(m, part), rep[members], [b.tobytes() for b in bits]), strict=True):
                        column.extend(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    return run


def parts_of(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of each part in ascending order, and bits that say which of them each one is to be compared with.

    The texts of the pairs (i, j) are cut to runs of bounded size; a part holds the pairs between two runs.
    """
    members = np.unique(np.concatenate([i, j]))
    run = np.cumsum(size[members] * 8) // PART_BYTES
    a, b = run[np.searchsorted(members, i)], run[np.searchsorted(members, j)]
    a, b = np.minimum(a, b), np.maximum(a, b)
    for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
        some = (a == x) & (b == y)
        own = np.unique(np.concatenate([i[some], j[some]]))
        p, q = np.searchsorted(own, i[some]), np.searchsorted(own, j[some])
        mask = np.zeros((len(own), len(own)), bool)
        mask[p, q] = mask[q, p] = True
        yield own, np.packbits(mask, axis=1)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, root, links) of each member of a part that has links. Columns: place, prefix, pair, part, rep, partners, weight, shingles."""
        for table in runs(batches, 4):
            edges = _groups(table, 4)
            rep, weight = (table.column(c).to_numpy() for c in ("rep", "weight"))
            sets, partners = table.column("shingles"), table.column("partners")
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n = hi - lo
                own = [np.frombuffer(sets[i].as_py(), np.uint64) for i in range(lo, hi)]
                bits = np.frombuffer(b"".join(partners[i].as_py() for i in range(lo, hi)), np.uint8).reshape(n, -1)
                linked = linked_pairs(own, similarity) & np.unpackbits(bits, axis=1, count=n).astype(bool)
                links = linked @ weight[lo:hi]
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[lo:hi][some]), pa.array(roots(linked, rep[lo:hi])[some]), pa.array(links[some])], ["rep", "root", "links"])

    return run


def linked_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs of sorted sets whose Jaccard similarity is at least ``similarity``; the diagonal is false."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((n, min(4096, total - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= similarity * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that links reach."""
    out = ids.copy()
    while True:
        new = np.minimum(out, np.where(linked, out[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == out).all():
            return out
        out = new


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            sets = list(shingle_sets(block))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, counted: bool = True) -> DataFrame:
    """doc_id, class_id, copy_of, n_links for each row of docs (doc_id, text); see the module for what they mean.

    Without ``counted`` n_links is 1 where there is a link, else 0, and large groups of near copies take far less work.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(arrow_map(texts, _sign, "doc_id long, rep long, size int, signature binary"), "signed")
    firsts = [F.first(c).alias(c) for c in ("size", "signature")]
    classes = signed.where(F.col("rep") != NO_SHINGLES).groupBy("rep").agg(F.min("doc_id").alias("doc"), F.count("*").alias("weight"), *firsts)
    classes = materialise(classes, "classes")
    cells, depths = forest_cells(classes, similarity)
    members = classes.select("rep", "size", "signature").join(exchanged(depths), "rep", "left")
    keys = ["place", "prefix", "pair"]

    def sets_of(reps: DataFrame) -> DataFrame:
        # one row's text of each class is enough; a table, whose size is known before the texts are joined
        one = materialise(classes.join(exchanged(reps.distinct()), "rep", "left_semi").select("doc").distinct(), "wanted")
        one = F.broadcast(one) if one.limit(MOST_WANTED + 1).count() <= MOST_WANTED else exchanged(one)
        chosen = texts.join(one, texts["doc_id"].eqNullSafe(one["doc"]), "left_semi").select("text")
        return arrow_map(chosen, _sets, "rep long, shingles binary").groupBy("rep").agg(F.first("shingles").alias("shingles"))

    stars = None
    if not counted:
        large = materialise(cells.where(F.col("texts") > CHUNK).select("place", "prefix", "rep"), "large")
        if not large.isEmpty():
            named, stars = _stars(large, sets_of, similarity)
            met = in_chunks(cells.where(F.col("texts") <= CHUNK), CHUNK).select(*keys, "rep", "chunk").unionByName(across(named, CHUNK))
    if stars is None:
        met = in_chunks(cells, CHUNK)
    laid = met.join(exchanged(members), "rep").select(*keys, "rep", "chunk", "size", "signature", "depths")
    laid = laid.repartition(*keys).sortWithinPartitions(*keys, "rep")
    meet = _meet(min(SHALLOW, enough_depth(similarity)), similarity)
    likely = materialise(arrow_map(laid, meet, "place int, prefix long, pair long, part int, rep long, partners binary"), "likely")
    together = likely.join(exchanged(classes.select("rep", "weight")), "rep").join(exchanged(sets_of(likely.select("rep"))), "rep")
    laid = together.select(*keys, "part", "rep", "partners", "weight", "shingles").repartition(*keys, "part").sortWithinPartitions(*keys, "part", "rep")
    found = materialise(arrow_map(laid, _verify(similarity), "rep long, root long, links long"), "links")
    if stars is not None:
        found = found.unionByName(stars.unionByName(stars.select(F.col("root").alias("rep"), "root")).select("rep", "root", F.lit(1).cast("long").alias("links")))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "linked").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    small = classes.select("rep", "doc", "weight").join(exchanged(linked), "rep", "left").join(exchanged(links), "rep", "left")
    named = linked.join(exchanged(classes.select("rep", "doc")), "rep").groupBy("component").agg(F.min("doc").alias("class_id"))
    # a text without links has a component of its own, so that no value is shared by all of them
    small = small.withColumn("component", F.coalesce("component", "rep"))
    ruled = salted_join(small, named, ["component"], "left").select("rep", F.col("doc").alias("copy_of"), F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "weight")
    ruled = materialise(ruled, "ruled")
    # classes that hold a thousandth of the rows are a thousand at most
    often = F.col("weight") * 1000 > signed.count()
    rows = signed.select("doc_id", "rep")
    many, few = F.broadcast(ruled.where(often)), ruled.where(~often)
    alone = rows.where(F.col("rep") == NO_SHINGLES).select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    columns = ["doc_id", "copy_of", "class_id", "n_links"]
    if not counted:
        many, few = (x.withColumn("n_links", F.least("n_links", F.lit(1))) for x in (many, few))
    hot = rows.join(many, "rep").select(*columns)
    cold = rows.join(many.select("rep"), "rep", "left_anti").join(exchanged(few), "rep").select(*columns)
    return alone.unionByName(hot).unionByName(cold).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.col("n_links").cast("long"))


#: DuckDB SQL for documents whose ids differ: all sets joined on all shingles, components by a recursive closure.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM split),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y, c = nx AND c = ny AS same FROM shared WHERE c >= 0.8 * (nx + ny - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
own AS (SELECT x, count(*) AS n, min(CASE WHEN same THEN y END) AS copy FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(lowest.y, doc_id)) AS class_id, least(doc_id, coalesce(own.copy, doc_id)) AS copy_of, coalesce(own.n, 0) AS n_links
FROM sets LEFT JOIN lowest ON lowest.x = doc_id LEFT JOIN own ON own.x = doc_id
"""
