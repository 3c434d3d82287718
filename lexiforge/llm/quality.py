"""Quality rules: a log-likelihood ratio of hashed word n-grams between trusted text and the raw corpus.

Two multinomials over hashed one- and two-word n-grams: the raw one counts every document, the target one four fifths of the
documents that a label calls good and not toxic. A document's
score is the mean over its n-grams of log(p_target / p_raw), so long and short texts compare. Both sides, on the target's
scale, get the same prior, a fixed share of the target's n-grams, so scores mean the same at every size.

A fixed threshold decides each document alone, in any order. Unless it is given, it is read from labels that the target
does not hold: the fifth of the good documents left out, and all that a label calls bad. It is the cut
that keeps and rejects the largest shares of them, in the middle of the range where that is so. All labels count; their
scores meet on the driver as numbers of documents by score, to five digits, so what it holds does not grow with them. Simple shape rules are
computed beside it and reject first.

Null text has no words and is rejected; rows that share a doc_id are scored each, all with its label; without a trusted
document all scores are 0 and only the shape rules reject. A text of any length is read whole. An empty table gives no rows.
Windows and lines are compared by 64-bit hashes within one text. ``judge`` ignores extra columns, ``kept_rows`` returns
them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map, materialise, salted_join
from lexiforge.llm.words import Block, Words, blocks, hashes, mix, windows, words

BUCKETS = 1 << 20
SLICE = 1 << 12
PRIOR = 1e-5  # of the target's n-grams, added to both sides: a rare bucket says nothing of a text without a label
MOST_SENT = 500_000  # labels that are sent to every executor; more are joined by an exchange
DIGITS = 5  # of a score, for the threshold: at most about two million different ones, as a ratio's logarithm is within 12
HELD_OUT = 5  # one of so many trusted documents is left for the threshold
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def _equal(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal hashes of one row are adjacent, earlier ones first, and whether each equals the one before."""
    key = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    return order, same


def shape(block: Block, w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row of a block: words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    n_rows = len(block)
    heads = (block.data & 0xC0) != 0x80
    inside = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    out = {"n_words": w.counts.astype(np.int64), "word_chars": _sums(heads & (np.cumsum(inside[:-1]) > 0), block.offsets), "n_symbols": _sums(_SYMBOL[block.data], block.offsets)}
    lines = words(block, _LINE)
    full = np.searchsorted(w.starts, lines.starts) < np.searchsorted(w.starts, lines.ends)
    row = lines.row[full]
    order, same = _equal(hashes(block, lines)[full], row)
    out["n_dup_lines"] = np.bincount(row[order][same], minlength=n_rows).astype(np.int64)
    h3, at = windows(h, w, 3)
    order, same = _equal(h3, w.row[at])
    again = at[order[same | np.append(same[1:], False)]] if len(at) else at
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[again + i] = True
    out["n_repeat_words"] = _sums(covered, w.first)
    return out


def ngrams(h: np.ndarray, w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each one- and two-word n-gram."""
    h2, at = windows(h, w, 2)
    row = w.row
    return (np.concatenate([h, h2]) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate([row, row[at]])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        seen = False
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in blocks(batch.column(0)):
                w = words(block)
                k, row = ngrams(hashes(block, w), w, buckets)
                seen |= bool(len(k))
                raw += np.bincount(k, minlength=buckets)
                good = trusted[block.first : block.first + len(block)]
                if good.any():
                    target += np.bincount(k[good[row]], minlength=buckets)
        if seen:
            yield from _slices(raw, target)

    return run


def _slices(raw: np.ndarray, target: np.ndarray, base: int = 0) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(raw), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array([base + at // SLICE], pa.int32()), pa.array([raw[at : at + SLICE].tobytes()], pa.binary()), pa.array([target[at : at + SLICE].tobytes()], pa.binary())], ["slice", "raw", "target"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, raw, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            both = sums.setdefault(k, [np.zeros(SLICE, np.int64), np.zeros(SLICE, np.int64)])
            both[0] += np.frombuffer(raw, np.int64)
            both[1] += np.frombuffer(target, np.int64)
    for k, (raw, target) in sums.items():
        yield from _slices(raw, target, k)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, part of all labels: 0 good, for the target; 1 good, left out; 2 bad."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    part = F.when(F.expr("low = 1 AND toxic = 0"), held.cast("int")).when(F.col("high") == 0, F.lit(2))
    return known.select("doc_id", part.alias("part")).where("part IS NOT NULL")


def _with_parts(docs: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """doc_id, text of docs with parts' columns; parts has one row an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts.count() <= MOST_SENT:
        return rows.join(F.broadcast(parts), "doc_id", how)  # counted just now
    return salted_join(rows, parts, ["doc_id"], how, salts=4)


def fit_ratio(docs: DataFrame, parts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, from all of docs. The driver receives 16 bytes a bucket, whatever the corpus."""
    trusted = parts.where("part = 0").select("doc_id", F.lit(True).alias("trusted"))
    flagged = _with_parts(docs, trusted, "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    schema = "slice int, raw binary, target binary"
    added = arrow_map(arrow_map(flagged, _count(buckets), schema).repartition(min(64, buckets // SLICE), "slice"), _add, schema)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for k, a, b in added.collect():
        raw[k * SLICE : (k + 1) * SLICE] = np.frombuffer(a, np.int64)
        target[k * SLICE : (k + 1) * SLICE] = np.frombuffer(b, np.int64)
    if not target.sum():
        return np.zeros(buckets, np.float32)
    expected, prior = raw * (target.sum() / raw.sum()), PRIOR * target.sum()
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def _ranked(values: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """values in ascending order, and how many there are before each, all in the end."""
    order = np.argsort(values, kind="stable")
    counts = np.ones(len(values), np.int64) if counts is None else np.asarray(counts, np.int64)
    return values[order], np.concatenate(([0], np.cumsum(counts[order])))


def _quantile(values: np.ndarray, before: np.ndarray, share: float) -> float:
    at = share * (before[-1] - 1)
    low, high = (values[np.searchsorted(before, f(at), side="right") - 1] for f in (np.floor, np.ceil))
    return float(low + (high - low) * (at - np.floor(at)))


def best_cut(good: np.ndarray, bad: np.ndarray, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The score from which on documents are kept: the largest share of good ones kept plus that of bad ones below.

    n_good, n_bad: how often each score occurs; once, if not given. Without bad ones as far below the lowest hundredth of
    the good ones as that is below their middle; without good ones all are kept.
    """
    if not len(good):
        return -np.inf
    (good, good_before), (bad, bad_before) = _ranked(good, n_good), _ranked(bad, n_bad)
    if not len(bad):
        low, middle = (_quantile(good, good_before, q) for q in (0.01, 0.5))
        return 2 * low - middle
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[2 * scores[0] - scores[-1] - 1], (scores[1:] + scores[:-1]) / 2])  # the first one keeps all
    kept = 1 - good_before[np.searchsorted(good, cuts)] / good_before[-1]
    rejected = bad_before[np.searchsorted(bad, cuts)] / bad_before[-1]
    total = kept + rejected
    return float(np.median(cuts[total >= total.max() - 1e-12]))


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_JUDGED = [*_FIELDS, "base_failed", "kept", "score"]


def _judge(model, buckets: int, threshold: float, own: int, text: int):
    """Columns: own ones, which are passed on, and the text at its place."""
    names = [*(f"own{i}" for i in range(own)), *_JUDGED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            for block in blocks(batch.column(text)):
                w = words(block)
                h = hashes(block, w)
                s = shape(block, w, h)
                k, row = ngrams(h, w, buckets)
                score = np.bincount(row, weights=ratio[k], minlength=len(block)) / np.maximum(np.bincount(row, minlength=len(block)), 1)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                kept = ~failed & (score >= threshold)
                passed = [batch.column(i).slice(block.first, len(block)) for i in range(own)]
                yield pa.RecordBatch.from_arrays([*passed, *(pa.array(s[f]) for f in _FIELDS), pa.array(failed), pa.array(kept), pa.array(score)], names)

    return run


def _judged(docs: DataFrame, columns: list[str], model, buckets: int, threshold: float) -> DataFrame:
    """own0, own1, ... (these columns of docs), then what is found of each row."""
    place = columns.index("text") if "text" in columns else len(columns)
    taken = docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(columns)], *([] if "text" in columns else [F.col("text").alias("judged")]))
    own = ", ".join(f"own{i} {f.dataType.simpleString()}" for i, f in enumerate(taken.schema.fields[: len(columns)]))
    schema = ", ".join([own, *(f"{f} long" for f in _FIELDS), "base_failed boolean", "kept boolean", "score double"])
    return arrow_map(taken, _judge(model, buckets, threshold, len(columns), place), schema)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None):
    """The ratios, on every executor, and the threshold."""
    parts = materialise(labelled(labels), "labels")
    model = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, parts, buckets))
    if threshold is None:
        left_out = _with_parts(docs, parts.where("part > 0"), "inner")
        rows = _judged(left_out, ["part"], model, buckets, -np.inf).where("NOT base_failed")
        found = rows.groupBy(F.col("own0").alias("part"), F.round("score", DIGITS).alias("score")).agg(F.count("*").alias("n")).toArrow()
        part, score, n = (found.column(c).to_numpy() for c in ("part", "score", "n"))
        threshold = best_cut(score[part == 1], score[part == 2], n[part == 1], n[part == 2])
    return model, threshold


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, shape counts, base_failed, kept, score."""
    model, cut = fit(docs, labels, buckets, threshold)
    return _judged(docs, ["doc_id"], model, buckets, cut).withColumnRenamed("own0", "doc_id")


def kept_rows(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    model, cut = fit(docs, labels, buckets, threshold)
    rows = _judged(docs, docs.columns, model, buckets, cut).where("kept")
    return rows.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])
