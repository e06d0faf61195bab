"""Line dedup by a deletion-neighbourhood join.

Lines that are within one edit of an earlier line anywhere in the corpus go; an edit puts
in, takes out or changes one word. Words are separated by white space and compared in lower
case. Lines of under MIN_WORDS words go only if they equal an earlier line, since one edit
would be too large a part of them. Blank lines stay.

1. Every line gets a 128-bit hash and the hashes of its beginning and its end. Equal lines
   are one from here on, at their earliest place.
2. Two lines within one edit share nearly all of their first or of their last half. Lines
   that share neither with another line can't have a neighbour and go no further. This
   filter loses nothing, and most lines end here.
3. The others emit all their variants with one word deleted, as hashed keys with the place
   of the deletion, and themselves.
4. Equal variants are joined: lines that become equal by deleting the same place differ in
   that word; a line that equals another's variant lacks one word. In each key the earliest
   line answers for all, so a key costs as many rows as it has lines, never their pairs.
5. The edit distance of each line and its earliest neighbour is verified on the words.

Earliest is by doc_id (nulls last), then by text hash and line number. A line counts as a
neighbour even if it goes itself. Rows that repeat an id and its text count as one document,
and each of them gets its result. Null and empty texts have one blank line. Extra columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, text_slices
from .common import materialise, null_safe, table

MIN_WORDS = 5
#: Halves of long lines are cut at multiples of this, so that lines a word apart share the cut.
GRAIN = 4
#: Words of the lines whose variants are made at once, or those of one longer line.
SLICE_WORDS = 1 << 18
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n + 1, U)
    out[1:] = np.multiply.accumulate(np.full(n, base, U))
    return out


def _inverse(base: np.uint64) -> np.uint64:
    """Of an odd number modulo 2**64."""
    return U(pow(int(base), -1, 1 << 64))


class Lines:
    """Word hashes of lines laid end to end, and hashes of any stretch of them."""

    def __init__(self, lines: pa.Array):
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(lines)))
        coded = lists.flatten().dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary))
        words = hashes[coded.indices.to_numpy()] if len(coded) else np.empty(0, U)
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        self.blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
        self.starts, self.sizes = edges[:-1], np.where(self.blank, 0, np.diff(edges))
        longest = int(self.sizes.max(initial=0))
        owner = np.repeat(np.arange(len(self.sizes)), np.diff(edges))
        self.sums, self.back = [], []
        for base in BASES:
            up = _powers(longest + 1, base)
            terms = words * up[np.minimum(np.arange(len(words)) - self.starts[owner], longest + 1)]
            self.sums.append(np.concatenate((np.zeros(1, U), np.cumsum(terms, dtype=U))))
            self.back.append(_powers(longest + 1, _inverse(base)))

    def stretch(self, which: int, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a to b - 1 of each line, wherever they stand."""
        s = self.starts[line]
        return (self.sums[which][s + b] - self.sums[which][s + a]) * self.back[which][a] + (b - a).astype(U)

    def whole(self, which: int, line: np.ndarray) -> np.ndarray:
        return mix(self.stretch(which, line, np.zeros(len(line), np.int64), self.sizes[line]))

    def without(self, which: int, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """whole() of the line less its word number at."""
        s, n = self.starts[line], self.sizes[line]
        head = self.sums[which][s + at] - self.sums[which][s]
        tail = (self.sums[which][s + n] - self.sums[which][s + at + 1]) * self.back[which][1]
        return mix(head + tail + (n - 1).astype(U))


def half(words: np.ndarray) -> np.ndarray:
    """Words that a line of so many shares at its beginning or its end with any line of as many words, or one more, within an edit."""
    h = np.maximum(0, (words - 1) // 2)
    return np.where(words >= 4 * GRAIN, h // GRAIN * GRAIN, h)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        lists = pc.split_pattern(texts, "\n")
        counts = np.diff(lists.offsets.to_numpy().astype(np.int64))
        lines = Lines(lists.flatten())
        row = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        live = np.flatnonzero(~lines.blank)
        n = lines.sizes[live]
        first = np.zeros(len(live), np.int64)
        own, less = half(n), half(n - 1)
        keys = [mix(lines.stretch(0, live, first, h) ^ U(k)) for h in (own, less) for k in (1, 2)]
        keys[1], keys[3] = [mix(lines.stretch(0, live, n - h, n) ^ U(2)) for h in (own, less)]
        keys = np.column_stack(keys).view(np.int64)
        emitted = np.where(n < MIN_WORDS, 0, np.where((own == less) | (n == MIN_WORDS), 2, 4))
        flat = keys.reshape(-1)[(np.arange(4)[None, :] < emitted[:, None]).reshape(-1)]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(row[live])), part.column("h").take(pa.array(row[live])), pa.array(number[live].astype(np.int32)),
                pa.array(lines.whole(0, live).view(np.int64)), pa.array(lines.whole(1, live).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(emitted))).astype(np.int32)), pa.array(flat)),
            ],
            ["doc_id", "h", "line", "k1", "k2", "halves"],
        )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the lines whose numbers a document's row lists."""
    for part, texts in text_slices(batches):
        found = [(row, n, k1, k2, t.split("\n")[n]) for row, (t, wanted) in enumerate(zip(texts.to_pylist(), part.column("wanted").to_pylist())) for n, k1, k2 in map(dict.values, wanted)]
        row, number, k1, k2, words = zip(*found) if found else ((),) * 5
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(at), part.column("h").take(at), pa.array(number, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(words, pa.string())], ["doc_id", "h", "line", "k1", "k2", "words"]
        )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v1, v2, at, id): at -1 for the line itself, else the number of the word deleted."""
    for b in batches:
        ends = np.cumsum(pc.add(pc.count_substring_regex(b.column("words"), r"\s+"), 1).to_numpy())
        a = 0
        while a < b.num_rows:
            to = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_WORDS, "right")))
            part, a = b.slice(a, to - a), to
            lines = Lines(part.column("words"))
            ids = part.column("id").to_numpy()
            each = np.arange(len(ids))
            line = np.repeat(each, lines.sizes)
            at = np.arange(len(line)) - np.repeat(np.cumsum(lines.sizes) - lines.sizes, lines.sizes)
            v = [np.concatenate((lines.whole(k, each), lines.without(k, line, at))).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v[0]), pa.array(v[1]), pa.array(np.concatenate((np.full(len(ids), -1), at)).astype(np.int32)), pa.array(ids[np.concatenate((each, line))])], ["v1", "v2", "at", "id"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, taken out or changed, at most, makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [within_one(x.lower().split(), y.lower().split()) for x, y in zip(b.column("words").to_pylist(), b.column("earlier").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("k1").filter(pa.array(good)), b.column("k2").filter(pa.array(good))], ["k1", "k2"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h long (the text's hash), dropped array<int>: line numbers, from 0, of documents that lose lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = materialise(_keyed(docs).mapInArrow(_lines, f"doc_id {kind}, h long, line int, k1 long, k2 long, halves array<long>"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "line")
    distinct = materialise(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("times")), "distinct-lines")

    halves = distinct.select("k1", "k2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    active = halves.join(shared, "half").select("k1", "k2").distinct()
    wanted = distinct.join(active, ["k1", "k2"]).groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct("first.line", "k1", "k2")).alias("wanted"))
    # Rows that repeat an id and its text name the same lines.
    chosen = null_safe(_keyed(docs), wanted, ["doc_id", "h"], "inner").mapInArrow(_chosen, f"doc_id {kind}, h long, line int, k1 long, k2 long, words string").dropDuplicates(["k1", "k2"])
    # Ids in the order of places: ranges ascend over partitions.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"), F.col("line")]
    numbered = materialise(chosen.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "words"), "active-lines")

    variants = materialise(numbered.select("id", "words").mapInArrow(_variants, "v1 long, v2 long, at int, id long"), "variants")
    by_place = variants.groupBy("v1", "v2", "at").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    by_key = by_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("at") == -1, F.col("low"))).alias("whole"), F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "low", "n"))).alias("deleted"))
    # A key's places are at most a line's words. Keys of one line alone are done with.
    lowest = F.array_min(F.transform("deleted", lambda d: d["low"]))
    mine = by_key.select("v1", "v2", F.explode(F.concat(F.transform("deleted", lambda d: F.struct(d["at"].alias("at"), F.least(d["low"], "whole").alias("earlier"), ((d["n"] > 1) | F.col("whole").isNotNull()).alias("more"))), F.array(F.struct(F.lit(-1).alias("at"), lowest.alias("earlier"), F.col("whole").isNotNull().alias("more"))))).alias("e"))
    answers = mine.where("e.more and e.earlier is not null").select("v1", "v2", "e.at", "e.earlier")
    pairs = variants.join(answers, ["v1", "v2", "at"]).where("earlier < id").select("id", "earlier").distinct()
    both = pairs.join(numbered, "id").join(numbered.select(F.col("id").alias("earlier"), F.col("words").alias("other")), "earlier").select("k1", "k2", "words", F.col("other").alias("earlier"))
    near = both.mapInArrow(_verify, "k1 long, k2 long").distinct().withColumn("near", F.lit(True))

    # Stored, so that the exchanges on both sides of the last join are plain ones, which adaptive execution splits
    # where a line is very frequent. Rows that repeat an id and its text may make times too large; place tells.
    affected = materialise(distinct.select("k1", "k2", "first", "times").join(near, ["k1", "k2"], "left").where("times > 1 or near"), "affected-lines")
    gone = lines.select("doc_id", "h", "line", "k1", "k2").join(affected, ["k1", "k2"]).where(F.col("near").isNotNull() | (place != F.col("first")))
    return gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from their texts; a null text stays null."""
    keyed = docs.withColumns({"__h": F.xxhash64("text"), "__id": F.col("doc_id")})
    gone = dropped_lines(docs).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("dropped").alias("__dropped"))
    joined = null_safe(keyed, gone, ["__id", "__h"], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op10_deletion_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), n.alias("n_lines"))
    found = null_safe(rows, dropped_lines(docs), ["doc_id", "h"], "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(gone).alias("n_dropped"), gone.alias("dropped"))
