"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

1. Statistics: one pass over the texts gives each document a short vector (lengths, shares
   of character classes, repetition of words, word pairs and lines), stored without the text.
2. Random Fourier features cos(w x + b), with w drawn for a Gaussian kernel, of the
   standardised statistics.
3. Normal equations: each partition sums z z' and z y over its labelled rows; the sums are
   added up cell by cell, and the driver solves for `features` + 1 weights.
4. Isotonic calibration: the rows are dealt into two folds by a hash of their statistics, and
   each fold is scored by the weights of the other, since the ridge fits its own rows too
   closely. These scores are counted in CALIBRATION_BINS bins, and pool adjacent violators
   turns the bins' label means into a rising curve from 0 to 1. The sums of both folds together
   give the weights that score documents.

What reaches the driver is bounded by `features` and CALIBRATION_BINS.

Defined results: a null text counts as empty, and an empty one is scored by its statistics
like any other. Labels other than 0 and 1, null ids and held-out rows teach nothing; a
document with several label rows teaches with each. Without labels every score is 0.5.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, text_slices
from .common import held_out, materialise, table

FEATURES = 128
WIDTH = 3.0
RIDGE = 1e-3
CALIBRATION_BINS = 4096
SEED = 20_011
#: Classes of bytes that are counted.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "bar": "|", "mark": "#$%&*@^~+=<>_\\", "shout": "!?", "stop": ".", "comma": ",;:", "quote": "'\"()[]{}", "line": "\n"}
STATS = ["log_bytes", "log_words", "word_mean", "word_sd", "short", "long", *CLASSES, "beyond_ascii", "distinct", "distinct_pairs", "stutter", "top_word", "distinct_lines"]
U = np.uint64


def _class_of() -> np.ndarray:
    out = np.full(256, len(CLASSES) + 1, np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        out[list(chars.encode())] = k
    out[128:] = len(CLASSES)
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, STATS) of texts without nulls."""
    n = len(texts)
    out = np.zeros((n, len(STATS)))
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy().astype(np.int64))
    spoken = pc.not_equal(words, "")
    keep = spoken.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), counts)[keep]
    coded = words.filter(spoken).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    length = pc.utf8_length(coded.dictionary).to_numpy()[index] if len(index) else np.empty(0)
    m = np.maximum(1, np.bincount(owner, minlength=n))
    put = lambda name, x: out.__setitem__((slice(None), STATS.index(name)), x)
    put("log_bytes", np.log1p(sizes))
    put("log_words", np.log1p(np.bincount(owner, minlength=n)))
    mean = np.bincount(owner, length, n) / m
    put("word_mean", mean)
    put("word_sd", np.sqrt(np.maximum(0, np.bincount(owner, length**2.0, n) / m - mean**2)))
    put("short", np.bincount(owner, length <= 3, n) / m)
    put("long", np.bincount(owner, length >= 14, n) / m)
    full = np.flatnonzero(sizes)
    kinds = _class_of()[np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)]
    starts = (np.cumsum(sizes) - sizes)[full]
    for k, name in enumerate([*CLASSES, "beyond_ascii"]):
        if len(full):
            found = np.zeros(n)
            found[full] = np.add.reduceat((kinds == k).astype(np.int32), starts)
            by = np.maximum(1, sizes) if name in ("upper", "lower", "digit", "beyond_ascii") else m
            put(name, np.log1p(10 * found / by) if by is m else found / by)
    same = owner[1:] == owner[:-1]
    stutter = same & (index[1:] == index[:-1])
    put("stutter", np.bincount(owner[1:][stutter], minlength=n) / m)
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    pairs = mix(index[:-1].astype(U) * U(0x9E3779B97F4A7C15) + index[1:].astype(U)) if len(index) > 1 else np.empty(0, U)
    distinct, distinct_pairs, top = np.ones(n), np.ones(n), np.zeros(n)
    for d in np.flatnonzero(np.diff(edges) > 1):
        a, b = edges[d], edges[d + 1]
        _, times = np.unique(index[a:b], return_counts=True)
        # A longer text repeats more words: against the root of its length.
        distinct[d] = len(times) / (b - a) ** 0.9
        top[d] = times.max() / (b - a)
        distinct_pairs[d] = len(np.unique(pairs[a : b - 1])) / (b - 1 - a)
    put("distinct", distinct)
    put("distinct_pairs", distinct_pairs)
    put("top_word", top)
    lines = pc.split_pattern(texts, "\n")
    line_count = np.diff(lines.offsets.to_numpy().astype(np.int64))
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    keyed = np.unique(np.repeat(np.arange(n), line_count) * (len(line_codes) + 1) + line_codes)
    put("distinct_lines", np.bincount(keyed // (len(line_codes) + 1), minlength=n) / np.maximum(1, line_count))
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double> in the order of STATS."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_statistics, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        # Outliers are drawn in, else each would be far from all others.
        x = 3 * np.tanh((stats - self.mean) / self.scale / 3)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0, 1)


def isotonic(means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising sequence, by squares weighted with sizes."""
    blocks: list[list[float]] = []
    for y, n in zip(means, sizes):
        blocks.append([float(y), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, n2, c2 = blocks.pop()
            y1, n1, c1 = blocks.pop()
            blocks.append([(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, c1 + c2])
    return np.concatenate([np.full(int(c), y) for y, _, c in blocks]) if blocks else np.empty(0)


def _stack(b: pa.RecordBatch) -> np.ndarray:
    return b.column("stats").flatten().to_numpy().reshape(b.num_rows, -1)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """labelled: stats array<double>, y int of 0 and 1."""
    d = len(STATS)
    row = labelled.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("stats")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("stats")[i] * F.col("stats")[i]) for i in range(d)]).alias("q")).first()
    if not row["n"]:
        return None
    mean = np.array(row["s"]) / row["n"]
    scale = np.sqrt(np.maximum(1e-6, np.array(row["q"]) / row["n"] - mean**2))
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.array([0.0]), np.array([0.5])))
    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("stats"), F.lit(2)).cast("int"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, features + 1, features + 2))
        for b in batches:
            z, y, fold = model.features(_stack(b)) if b.num_rows else None, b.column("y").to_numpy(), b.column("fold").to_numpy()
            for k in (0, 1):
                if (fold == k).any():
                    total[k] += z[fold == k].T @ np.column_stack([z, y])[fold == k]
        at = [(k, i) for k in (0, 1) for i in range(features + 1)]
        yield pa.RecordBatch.from_pydict({"fold": [k for k, _ in at], "row": [i for _, i in at], "cells": [total[x] for x in at]}, schema=pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.float64()))]))

    cells = folded.mapInArrow(sums, "fold int, row int, cells array<double>").select("fold", "row", F.posexplode("cells").alias("col", "v"))
    a = np.zeros((2, features + 1, features + 2))
    for r in cells.groupBy("fold", "row", "col").agg(F.sum("v").alias("v")).collect():
        a[r["fold"], r["row"], r["col"]] = r["v"]
    # The constant feature's own sum is the number of rows.
    solve = lambda m: np.linalg.solve(m[:, :-1] + ridge * max(1, m[-1, -2]) / features * np.eye(features + 1), m[:, -1])
    model.weights = solve(a.sum(axis=0))
    others = np.stack([solve(a[1]), solve(a[0])])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = (model.features(_stack(b)) * others[b.column("fold").to_numpy()]).sum(axis=1)
            at = np.clip((s + 1) / 3 * CALIBRATION_BINS, 0, CALIBRATION_BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), b.column("y")], ["bin", "s", "y"])

    bins = folded.mapInArrow(binned, "bin int, s double, y int").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    curve = isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins]))
    model.curve = (np.array([r["s"] for r in bins]), curve)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score double."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_stack(b)))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score double of every row of docs, learned from labels (doc_id, quality) of rows that are not held out."""
    stats = materialise(document_statistics(docs), "quality-stats")
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    labelled = materialise(stats.join(marked, "doc_id").select("stats", "y"), "quality-labelled")
    return score(stats, fit(labelled))


def op3_fourier_quality(spark, sf_dir):
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
