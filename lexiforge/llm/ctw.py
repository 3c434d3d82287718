"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision (a node of the byte's binary tree) has a context tree over the preceding
bytes. At every context the Krichevsky-Trofimov estimate of the training counts competes, half and half, with the product
of its longer contexts, and the weights are carried down to the prediction, so all depths up to ``DEPTH`` are mixed.

Which contexts are nodes: all that occur in training text, so nodes grow with the corpus. The tree is a table of grams
(a byte with the ``DEPTH`` bytes before it) in shards of equal nearest ``CUT`` bytes: each shard holds whole subtrees, fits
them, and gives the driver what depths above need (sums for each decision of the two nearest bytes, at most 2^16 x 255 of them
whatever the corpus). With these on every executor the shards give each gram its log-probability. Grams of held-out text
are in the table with a count of 0, so every gram of a scored text has its row. The ``FREQUENT_GRAMS`` most frequent grams are
scored where the text is, all others by a join with the table; which ones are sent changes no score.

A text's score is log10 of its probability: all its bytes (A-Z lower-cased) and an end, given the bytes before them.

Beside it the base score: word unigrams with add-0.1 smoothing. Word counts of all training text meet in an exchange by
64-bit word hash; the ``FREQUENT`` most frequent words are scored where the text is, all others by a join with the counts.

Training text is every document whose crc32(doc_id) modulo 10 is not 0. Null text is empty (one token, the end). Rows that
share a doc_id are each counted and scored; null doc_ids count as held out and are scored each. A text of any length is read
whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map, materialise
from lexiforge.llm.words import Block, blocks, hashes, words

DEPTH = 6
CUT = 3
FREQUENT = 1 << 17
FREQUENT_GRAMS = 3 << 20
SHARD_ROWS = 1 << 17  # grams fitted together, more if one shard has more
END_BYTE = 0xFF  # no byte of UTF-8
END_WORD = np.uint64(0x0E4D0E4D0E4D0E4D)
SMOOTH = 0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
GRAM_BYTES = 1 << 22  # texts whose grams are counted together


def with_ends(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's lower-cased bytes with an end after each text, and each text's start."""
    data = np.insert(_LOWER[block.data], block.offsets[1:], END_BYTE)
    return data, block.offsets + np.arange(len(block) + 1)


def grams(data: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it (0 before a text's start), the byte itself lowest."""
    out = data.astype(np.int64)
    at = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    for d in range(1, depth + 1):
        before = np.zeros(len(data), np.int64)
        before[d:] = data[:-d]
        before[at < d] = 0
        out |= before << (8 * d)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0, a gram (n is 0 where no training text has it); 1, a training word's hash. Columns: train, text."""
    def emit(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for batch in batches:
        for block in blocks(batch.filter(pc.invert(batch.column(0))).column(1)):
            keys = np.unique(grams(*with_ends(block)))
            held[0].append((keys, np.zeros(len(keys), np.int64)))
            if len(held[0]) >= 16:
                held[0] = [merged(held[0])]
                if len(held[0][0][0]) > 1 << 20:
                    yield emit(0, held[0])
                    held[0] = []
        for block in blocks(batch.filter(batch.column(0)).column(1)):
            w = words(block)
            tokens = np.append(hashes(block, w, lower=True), np.full(len(block), END_WORD, np.uint64)).view(np.int64)
            for kind, keys in enumerate((grams(*with_ends(block)), tokens)):
                held[kind].append(np.unique(keys, return_counts=True))
                if len(held[kind]) >= 16:
                    held[kind] = [merged(held[kind])]
                    if len(held[kind][0][0]) > 1 << 20:
                        yield emit(kind, held[kind])
                        held[kind] = []
    for kind in (0, 1):
        if held[kind]:
            yield emit(kind, held[kind])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series from 8 up."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) - shift


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 decisions (1 is the first; node k leads to 2k and 2k + 1) from counts of 256 symbols."""
    tree = np.zeros((len(symbols), 512), np.int64)
    tree[:, 256:] = symbols
    for k in range(255, 0, -1):
        tree[:, k] = tree[:, 2 * k] + tree[:, 2 * k + 1]
    inner = np.arange(1, 256)
    return tree[:, 2 * inner], tree[:, 2 * inner + 1]


_FEW = 1 << 14
_HALVES, _WHOLES = (_lgamma(np.arange(_FEW) + x) for x in (0.5, 1.0))


def kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """kt_log, looked up where counts are small."""
    total = zeros + ones
    small = total < _FEW
    a, b, n = (np.where(small, x, 0).astype(np.int64) for x in (zeros, ones, total))
    out = _HALVES[a] + _HALVES[b] - _WHOLES[n] - math.log(math.pi)
    if not small.all():
        out[~small] = kt_log(zeros[~small], ones[~small])
    return out


def _above(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decisions (context, nearest byte highest, then the node of the byte's tree in 8 bits) of one depth less, and each one's place there."""
    return np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)


class Tree:
    """Decisions of a range of depths, fitted upwards: counts, the estimate's and the weighted logarithm, places of parents."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deepest: int, to: int, below: np.ndarray | None = None) -> None:
        """below: what the children weigh, for each decision of the deepest depth; None for leaves."""
        self.levels, self.parents = [], []
        for d in range(deepest, to - 1, -1):
            own = kt_of(zeros, ones)
            weighted = own if below is None else np.logaddexp(own, below) - math.log(2)
            stop = np.ones(len(ids)) if below is None else np.exp(own - math.log(2) - weighted)
            self.levels.append((stop, (ones + 0.5) / (zeros + ones + 1.0)))
            self.ids, self.zeros, self.ones, self.weighted = ids, zeros, ones, weighted
            if d > to:
                ids, up = _above(ids)
                zeros, ones, below = (np.bincount(up, weights=x, minlength=len(ids)) for x in (zeros, ones, weighted))
                self.parents.append(up)

    def down(self, mixed: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a one mixed so far and the weight that is left, at the deepest depth, from those above the highest."""
        for i in range(len(self.levels) - 1, -1, -1):
            stop, one = self.levels[i]
            mixed, reach = mixed + reach * stop * one, reach * (1 - stop)
            if i:
                mixed, reach = mixed[self.parents[i - 1]], reach[self.parents[i - 1]]
        return mixed, reach


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of whole shards, many together. Columns: shard (ascending), key, n."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SHARD_ROWS:
            continue
        shard, key, n = (pa.Table.from_batches(held).column(i).to_numpy() for i in range(3))
        at = int(np.searchsorted(shard, shard[-1]))
        if at:
            yield key[:at], n[:at]
            held, rows = [pa.RecordBatch.from_arrays([pa.array(x[at:]) for x in (shard, key, n)], ["shard", "key", "n"])], 0
        else:
            rows = 0  # one shard so far: the next look is after as many rows again
    if held:
        _, key, n = (pa.Table.from_batches(held).column(i).to_numpy() for i in range(3))
        if len(key):
            yield key, n


def _fitted(key: np.ndarray, n: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree from DEPTH to CUT over grams of whole shards; for each gram its eight decisions' places, and its bits."""
    symbol = key & 255
    context = (key.byteswap() >> 8) & ((1 << 48) - 1)  # the nearest byte highest
    j = np.arange(8)
    nodes = (1 << j) | (symbol[:, None] >> (8 - j))
    bits = (symbol[:, None] >> (7 - j)) & 1
    ids, place = np.unique((context[:, None] << 8) | nodes, return_inverse=True)
    place = place.reshape(nodes.shape)
    ones, every = (np.bincount(place.ravel(), weights=x.ravel(), minlength=len(ids)) for x in (bits * n[:, None], np.broadcast_to(n[:, None], bits.shape)))
    return Tree(ids, every - ones, ones, DEPTH, CUT), place, bits


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, zeros, ones, below): sums over the shards' highest decisions for each decision one depth above."""
    for key, n in _shards(batches):
        tree, _, _ = _fitted(key, n)
        ids, up = _above(tree.ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *(np.bincount(up, weights=x) for x in (tree.zeros, tree.ones, tree.weighted)))], ["id", "zeros", "ones", "below"])


def _predict(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n, log10 of the byte's probability)."""
        known, mixed, reach = top.value
        for key, n in _shards(batches):
            tree, place, bits = _fitted(key, n)
            at = np.searchsorted(known, (tree.ids >> 16 << 8) | (tree.ids & 255))
            one, _ = tree.down(mixed[at], reach[at])
            log = np.log10(np.where(bits == 1, one[place], 1 - one[place])).sum(axis=1)
            for lo in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (key, n, log)], ["key", "n", "log"])

    return run


def gram_logs(counts: DataFrame) -> DataFrame:
    """key, n, log: log10 of each gram's last byte after its others, from gram counts (key, n), all contexts kept."""
    spark = counts.sparkSession
    laid = counts.select(F.shiftright("key", 8).bitwiseAND((1 << (8 * CUT)) - 1).alias("shard"), "key", "n").repartition("shard").sortWithinPartitions("shard")
    sums = arrow_map(laid, _fit, "id long, zeros double, ones double, below double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    rows = sums.toArrow().sort_by("id")  # decisions after two bytes: their number does not grow with the corpus
    known, zeros, ones, below = (c.to_numpy() for c in rows.columns)
    top = Tree(known, zeros, ones, CUT - 1, 0, below)
    mixed, reach = top.down(np.zeros(len(top.ids)), np.ones(len(top.ids)))
    return materialise(arrow_map(laid, _predict(spark.sparkContext.broadcast((known, mixed, reach))), "key long, n long, log double"), "logs")


def frequent_grams(logs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and logarithms of the most frequent grams: all from a count on, so that they are ``most`` at most."""
    cap = 1 << 16
    tally = logs.where("n > 0").groupBy(F.least("n", F.lit(cap)).alias("n")).count().collect()
    least, room = cap + 1, most
    for n, c in sorted(tally, reverse=True):
        room -= c
        if room < 0:
            break
        least = n
    rows = logs.where(F.col("n") >= least).select("key", "log").toArrow() if least <= cap else None  # at most ``most``
    if rows is None:
        return np.zeros(0, np.int64), np.zeros(0)
    rows = rows.sort_by("key")
    return rows.column("key").to_numpy(), rows.column("log").to_numpy()


class Model:
    """The same model with all its nodes in one place, for texts few enough; it may leave out rare contexts.

    Contexts by depth with their symbol counts; after fitting: child tables and log10 probabilities, one row a node.

    Levels are worked off one at a time: only what later levels need is kept, in single precision.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """levels[d]: the ascending contexts (d bytes each, the nearest lowest) and their counts of 256 symbols; parents are always present."""
        keys = [k for k, _ in levels]
        base = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        self.depth = len(levels) - 1
        self.child = np.full((base[-1], 256), -1, np.int32)
        parents = [np.zeros(0, np.int64)]
        for d in range(1, len(levels)):
            up = np.searchsorted(keys[d - 1], keys[d] & ((1 << (8 * (d - 1))) - 1))
            self.child[base[d - 1] + up, keys[d] >> (8 * (d - 1))] = base[d] + np.arange(len(keys[d]))
            parents.append(up)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        from_below: np.ndarray | None = None
        for d in range(self.depth, -1, -1):
            counts = levels[d][1]
            zeros, ones = bit_counts(counts)
            weighted = kt_log(zeros, ones)
            stop, rest_one = np.ones(weighted.shape, np.float32), np.full(weighted.shape, 0.5, np.float32)
            if d < self.depth and len(keys[d + 1]):
                rest = counts.copy()
                np.subtract.at(rest, parents[d + 1], levels[d + 1][1])
                split = np.unique(parents[d + 1])
                rest0, rest1 = bit_counts(rest[split])
                below = from_below[split] + kt_log(rest0, rest1)  # what the kept children do not hold is one further child
                own = weighted[split]
                weighted[split] = np.logaddexp(own, below) - math.log(2)
                stop[split] = np.exp(own - math.log(2) - weighted[split])
                rest_one[split] = (rest1 + 0.5) / (rest0 + rest1 + 1.0)
            kept.append((stop, ((ones + 0.5) / (zeros + ones + 1.0)).astype(np.float32), rest_one))
            if d:
                from_below = np.zeros((len(keys[d - 1]), 255))
                np.add.at(from_below, parents[d], weighted)
        self.log10 = np.zeros((base[-1], 256), np.float32)
        reach = mixed = None
        for d in range(len(levels)):
            stop, one, rest_one = kept.pop()
            if d:
                reach, mixed = after[parents[d]], mixed[parents[d]]
            else:
                reach, mixed = np.ones(stop.shape, np.float32), np.zeros(stop.shape, np.float32)
            mixed = mixed + reach * stop * one
            after = reach * (1 - stop)
            final = (mixed + after * rest_one).astype(np.float64)  # reached as the longest kept context
            log1, log0 = np.log10(final), np.log10(1 - final)
            tree = np.zeros((len(final), 512))
            for k in range(1, 256):
                tree[:, 2 * k] = tree[:, k] + log0[:, k - 1]
                tree[:, 2 * k + 1] = tree[:, k] + log1[:, k - 1]
            self.log10[base[d] : base[d + 1]] = tree[:, 256:]

    def node_of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The longest kept context before each byte."""
        node = np.zeros(len(data), np.int32)
        at = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
        alive = np.ones(len(data), bool)
        for d in range(1, self.depth + 1):
            before = np.zeros(len(data), np.uint8)
            before[d:] = data[:-d]
            before[at < d] = 0
            step = self.child[node, before]
            alive &= step >= 0
            node = np.where(alive, step, node)
        return node

    def score(self, block: Block) -> np.ndarray:
        """log10 probability of each text of a block, and code length is -score * log2(10) bits."""
        data, starts = with_ends(block)
        each = self.log10[self.node_of(data, starts), data].astype(np.float64)
        return np.add.reduceat(each, starts[:-1]) if len(block) else np.zeros(0)


def fit_model(counts: DataFrame, depth: int = DEPTH, share: float = 0.0) -> Model:
    """From gram counts (key, n), all of which come to the driver if share is 0: what the shards are held against, on small inputs."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth + 1):
        by_gram = counts.groupBy((F.col("key").bitwiseAND((1 << (8 * (d + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        context = F.shiftright("gram", 8)
        least = 0 if d <= 1 else total * share
        kept = by_gram.groupBy(context.alias("context")).agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("context")
        rows = by_gram.withColumn("context", context).join(F.broadcast(kept), "context").select("gram", "n").toArrow()
        gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
        keys, row = np.unique(gram >> 8, return_inverse=True)
        if not d and not len(keys):
            keys = np.zeros(1, np.int64)
        symbols = np.zeros((len(keys), 256), np.int64)
        symbols[row, gram & 255] = n
        levels.append((keys, symbols))
    return Model(levels)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, score double, base double, known long, kind byte, key long, times long"


def _asked(rows: pa.Array, own: np.ndarray, kind: int, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    m = len(keys)
    none = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
    return pa.RecordBatch.from_arrays([rows.take(pa.array(own)), *none, pa.array(np.full(m, kind, np.int8)), pa.array(keys), pa.array(times)], [x.split()[0] for x in _SCORED.split(", ")])


def _score(common, frequent, end_log: float, end_known: bool):
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text with what can be scored here, then one row for each other word and gram of it."""
        keys, logs = common.value
        gram_keys, gram_log = frequent.value
        for batch in batches:
            for block in blocks(batch.column(3)):
                n, w = len(block), words(block)
                h = hashes(block, w, lower=True).view(np.int64)
                row = w.row
                place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                here = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(row[here], weights=logs[place[here]], minlength=n) + end_log
                known = np.bincount(row[here], minlength=n) + end_known
                ids, held, rows = (batch.column(i).slice(block.first, n) for i in (1, 2, 0))
                data, starts = with_ends(block)
                g, place_of = np.unique(grams(data, starts), return_inverse=True)
                at = np.minimum(np.searchsorted(gram_keys, g), max(len(gram_keys) - 1, 0))
                sent = gram_keys[at] == g if len(gram_keys) else np.zeros(len(g), bool)
                log = np.where(sent, gram_log[at], 0.0) if len(gram_keys) else np.zeros(len(g))
                score = np.add.reduceat(log[place_of], starts[:-1]) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays([rows, ids, held, pa.array(w.counts + 1), pa.array(score), pa.array(base), pa.array(known), pa.nulls(n, pa.int8()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
                far = np.flatnonzero(~sent[place_of])  # a rare gram seldom comes twice in a text
                if len(far):
                    yield _asked(rows, np.searchsorted(starts, far, "right") - 1, 0, g[place_of[far]], np.ones(len(far), np.int64))
                other = ~here
                if other.any():
                    pairs = np.stack([row[other], h[other]])
                    order = np.lexsort(pairs[::-1])
                    pairs = pairs[:, order]
                    first = np.flatnonzero(np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))
                    yield _asked(rows, pairs[0, first], 1, pairs[1, first], np.diff(np.append(first, pairs.shape[1])))

    return run


def score_documents(docs: DataFrame, frequent: int = FREQUENT, frequent_grams_sent: int = FREQUENT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counted = arrow_map(texts.select((~F.col("held_out")).alias("train"), "text"), _count, "kind byte, key long, n long")
    counts = materialise(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counts.where("kind = 1").select("key", "n")
    end = F.sum(F.when(F.col("key") == F.lit(int(END_WORD.view(np.int64))), F.col("n")))
    n, v, ends = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(end, F.lit(0))).first()
    room = n + SMOOTH * (v + 1)
    common = vocabulary.orderBy(F.desc("n"), "key").limit(frequent).toArrow()  # a bounded number of words; all others are joined
    order = np.argsort(common.column("key").to_numpy())
    table = (common.column("key").to_numpy()[order], np.log10((common.column("n").to_numpy()[order] + SMOOTH) / room))
    end_log = math.log10((ends + SMOOTH) / room)
    logs = gram_logs(counts.where("kind = 0").select("key", "n"))
    sent = spark.sparkContext.broadcast(frequent_grams(logs, frequent_grams_sent))
    # a row's number within its scan; both uses of it come from the one exchange below
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = arrow_map(numbered, _score(spark.sparkContext.broadcast(table), sent, end_log, ends > 0), _SCORED)
    # a text's own row meets nothing; it is dealt by its number
    dealt = scored.select("row", "doc_id", "held_out", "n_tokens", "score", "base", "known", "times", F.coalesce("kind", F.lit(2).cast("byte")).alias("_kind"), F.coalesce("key", F.xxhash64("row")).alias("_key"))
    tables = vocabulary.select(F.lit(1).cast("byte").alias("_kind"), F.col("key").alias("_key"), F.log10((F.col("n") + F.lit(SMOOTH)) / F.lit(room)).alias("_log"))
    tables = tables.unionByName(logs.select(F.lit(0).cast("byte").alias("_kind"), F.col("key").alias("_key"), F.col("log").alias("_log")))
    met = dealt.join(tables, ["_kind", "_key"], "left")
    word = F.col("_kind") == 1
    total = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.col("_kind") == 0, F.col("times") * F.col("_log")).otherwise(F.coalesce("score", F.lit(0.0)))).alias("score"),
        F.sum(F.coalesce("known", F.lit(0)) + F.when(word & F.col("_log").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.when(word, F.col("times") * F.coalesce("_log", F.lit(math.log10(SMOOTH / room)))).otherwise(F.coalesce("base", F.lit(0.0)))).alias("base_score"),
    )
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
