"""Near-duplicate detection with DartMinHash signatures and banded joining.

Signatures. A text is a weighted set: its elements are its shingles, and one that occurs c times
weighs 1 + floor(log2 c), so that a passage repeated over and over doesn't outweigh the rest.
Each element owns a plane of weight and rank on which hashing
throws darts at one a unit of area. A set gathers the darts that lie below the element's
weight, layer by layer of rising rank, until every one of k coordinates (a dart names one
by its hash) has a dart; the earliest dart of a coordinate is its value. Two weighted sets
agree in a coordinate with probability equal to their weighted Jaccard similarity. A set
throws about k ln k darts however many elements it has. Layers double in width, regions of
weight too, so all sets see the same darts.

Joining. Documents with one weighted set are one node. Nodes that agree in a whole band of
the signature share a bucket. In each bucket the node that shares the most bands leads: all
others are held against it, and the exact weighted similarity of each such pair is computed
from the shingles, of which every unit of weight is an element of its own by then: the sum of
the smaller weights over that of the larger ones. Linked nodes are in one class. In further rounds, the nodes outside a bucket's
largest class are held against the leading nodes of other classes, eight times as many each
time, until every pair of a bucket is either compared or in one class. So no pair of a
bucket that is linked goes uncompared, and a bucket of copies costs about as many pairs as
it has nodes.

Defined results: words are runs of letters, marks and digits in lower case. A text of under
five words has one shingle, of all its words. A text without words, or null, is a class of
its own. class_id is the smallest doc_id of the class (null ids come last). Repeated rows
are in one class; rows that repeat an id and its text count as one document and stay or go
together. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import SMALL_SLICE_BYTES, mix, text_slices
from .common import discard, flagged, materialise, null_safe, table

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**6)**24 = 0.9993, at 0.85 with 0.99999.
BANDS, BAND_ROWS = 24, 6
#: Leaders of a bucket grow by this factor from round to round.
LEADERS = 8
#: Up to so many pairs, the nodes in them are broadcast (16 bytes each); beyond, all shingles are shuffled.
BROADCAST_PAIRS = 500_000
#: Groups of a profile.
GROUPS = 64
LOWEST = -8  # the first layer of ranks is [0, 2**LOWEST)
U = np.uint64


@functools.lru_cache(64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities."""
    top = int(mean + 12 * math.sqrt(mean) + 24)
    return np.cumsum(np.exp(np.arange(top) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(top)])))


def _throw(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, layer: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Darts of one layer of ranks: owner, coordinate, rank and name of each."""
    low, high = (0.0, 2.0**LOWEST) if layer < LOWEST else (2.0**layer, 2.0 ** (layer + 1))
    region = 0
    while True:
        w_low, w_high = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0**region)
        inside = weight > w_low
        if not inside.any():
            return
        e, o, w = (element, owner, weight) if inside.all() else (element[inside], owner[inside], weight[inside])
        seed = mix(e ^ mix(np.array([(layer + 64) * 256 + region + 1], U)))
        count = np.searchsorted(_poisson((high - low) * (w_high - w_low)), (seed >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        total = int(count.sum())
        if total:
            ends = np.cumsum(count)
            number = np.arange(total, dtype=np.int64) - np.repeat(ends - count, count)
            h = mix(np.repeat(seed, count) + (number.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            names = mix(h ^ U(0xD1B54A32D192ED03))
            coordinate = ((h >> U(44)) * U(k)) >> U(20)
            rank = low + (high - low) * ((h & U((1 << 44) - 1)).astype(np.float64) * 2.0**-44)
            owners = np.repeat(o, count)
            height = w_low + (w_high - w_low) * ((names >> U(11)).astype(np.float64) * 2.0**-53)
            hit = height < np.repeat(w, count)
            if not hit.all():
                owners, coordinate, rank, names = owners[hit], coordinate[hit], rank[hit], names[hit]
            yield owners, coordinate.astype(np.int64), rank, mix(names)
        region += 1


def sketch(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) values. element, owner (0 to sets - 1) and weight (over 0) run side by side; every set has an element."""
    values = np.zeros((sets, k), U)
    best = np.full(sets * k, np.inf)
    total = np.bincount(owner, weight, sets)
    # Layers that give a set k (ln k + 2) darts on average.
    upto = np.maximum(LOWEST - 1, np.ceil(np.log2(k * (math.log(k) + 2) / total)).astype(int) - 1)
    layer = LOWEST - 1
    active = np.ones(sets, bool)
    while active.any():
        mine = active[owner]
        for o, c, rank, names in _throw(element[mine], owner[mine], weight[mine], layer, k):
            slot = o * k + c
            np.minimum.at(best, slot, rank)
            first = best[slot] == rank
            values.reshape(-1)[slot[first]] = names[first]
        active &= (upto > layer) | np.isinf(best.reshape(sets, k)).any(axis=1)
        layer += 1
    return values


def shingle_bags(texts: pa.Array, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of each text (no nulls), and what each weighs."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    words = lists.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), U, len(words.dictionary))
    w = hashes[words.indices.to_numpy()] if len(words) else np.empty(0, U)
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    empty = (pc.binary_length(pc.utf8_trim(clean, " ")).to_numpy() == 0)
    salts = mix(np.arange(1, size + 1).astype(U))
    n = len(w) - size + 1
    rolled = mix(sum(w[i : i + n] * (salts[i] | U(1)) for i in range(size))) if n > 0 else np.empty(0, U)
    out = []
    for a, b, none in zip(edges[:-1], edges[1:], empty):
        if none:
            out.append((np.empty(0, U), np.empty(0, np.int64)))
        elif b - a < size:
            out.append((mix((w[a:b] * (salts[: b - a] | U(1))).sum(keepdims=True) + U(b - a)), np.ones(1, np.int64)))
        else:
            element, times = np.unique(rolled[a : b - size + 1], return_counts=True)
            out.append((element, np.frexp(times.astype(np.float64))[1].astype(np.int64)))
    return out


def units(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A set with an element for each unit of weight, so that weighted similarity is that of sets. First units keep their hash."""
    if not len(weight) or weight.max() == 1:
        return element
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    each = np.repeat(element, weight)
    return np.sort(np.where(nth > 0, mix(each + nth.astype(U) * U(0x9E3779B97F4A7C15)), each))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """units() of the shingles of each text (no nulls)."""
    return [units(e, n) for e, n in shingle_bags(texts, size)]


def node_name(s: np.ndarray) -> bytes:
    """128 bits for a shingle set."""
    return int(s.sum()).to_bytes(8, "big") + int(mix(s ^ U(0xA0761D6478BD642F)).sum()).to_bytes(8, "big")


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, rows + 1).astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
        for part, texts in text_slices(batches, SMALL_SLICE_BYTES):
            bags = shingle_bags(texts, size)
            for a in range(0, len(bags), 256):
                some = [units(*bag) for bag in bags[a : a + 256]]
                full = [bag for bag in bags[a : a + 256] if len(bag[0])]
                keys = iter(())
                if full:
                    owner = np.repeat(np.arange(len(full)), [len(e) for e, _ in full])
                    weight = np.concatenate([n for _, n in full]).astype(np.float64)
                    values = sketch(np.concatenate([e for e, _ in full]), owner, weight, len(full), bands * rows)
                    keyed = mix((values.reshape(-1, bands, rows) * salts).sum(axis=2) + np.arange(1, bands + 1).astype(U))
                    keys = iter(keyed.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(a, 256), part.column("h").slice(a, 256), pa.array([len(s) for s in some], pa.int32()), pa.array([node_name(s) if len(s) else None for s in some], pa.binary()), pa.array([next(keys) if len(s) else None for s in some], pa.list_(pa.int64()))],
                    ["doc_id", "h", "n", "node", "bands"],
                )

    return run


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, h long (the text's hash), n int (weight of its shingles), node binary (null without a word), bands array<long>."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_signatures(size, bands, rows), f"doc_id {kind}, h long, n int, node binary, bands array<long>")


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SMALL_SLICE_BYTES):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays([pa.array([node_name(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Of stored pairs (a, b), those whose exact Jaccard similarity is at least threshold."""
    ids = pairs.select(F.col("a").alias("nid")).distinct().union(pairs.select("b").distinct()).distinct()
    if pairs.count() <= BROADCAST_PAIRS:  # then only the shingles that are needed are shuffled
        shingles = shingles.join(F.broadcast(ids), "nid", "left_semi")
    left = shingles.select(F.col("nid").alias("a"), F.col("shingles").alias("s"))
    right = shingles.select(F.col("nid").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(left, "a").join(right, "b").where(both >= threshold * (F.size("s") + F.size("t") - both) - 1e-9).select("a", "b")


def lone_shingles(shingles: DataFrame) -> DataFrame:
    """(nid, lone): how many shingles of a node no other node has. Nodes without any are left out."""
    each = shingles.select("nid", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("nid").alias("nid")).where("k = 1")
    return alone.groupBy("nid").agg(F.count(F.lit(1)).cast("int").alias("lone"))


def profiles(shingles: DataFrame) -> DataFrame:
    """(nid, profile): a node's shingles by hash group. Two nodes share at most the sum of the groups' smaller numbers."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.size(F.filter("shingles", lambda x: F.pmod(x, F.lit(GROUPS)) == g)))
    return shingles.select("nid", counts.alias("profile"))


def components(links: DataFrame) -> DataFrame:
    """(nid, comp): the smallest node of each node's component, by label propagation with pointer jumping."""
    edges = materialise(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialise(edges.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("comp")).select("nid", F.least("nid", "comp").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "nid").select("nid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        over = step.select(F.col("nid").alias("comp"), F.col("comp").alias("root"))
        old, labels = labels, materialise(step.join(over, "comp", "left").select("nid", F.least("comp", "root").alias("comp"), (F.least("comp", "root") != F.col("old")).alias("moved")), "labels")
        discard(old)
        if labels.where("moved").isEmpty():
            return labels.select("nid", "comp")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, h long (the text's hash), class_id, class_size long, kept boolean: every row of docs once."""
    signed = materialise(signatures(docs, size, bands, rows), "signatures")
    # One node for all rows of a shingle set, with the id of one of them to find its text by.
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("*", F.monotonically_increasing_id().alias("nid")), "nodes")
    spread = nodes.select("nid", "n", F.posexplode("bands").alias("nth", "band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # Stored, here and below, so that a join's exchanges are plain ones, which adaptive execution splits where a key is hot.
    shared = materialise(shared, "shared")
    likely = flagged(spread, F.col("band"), shared, F.col("band")).where("__maybe").drop("__maybe")
    members = materialise(likely.join(shared, "band"), "shared-bands")
    # The nodes that share the most lead: a group's original, or the copy nearest to it, does.
    degree = members.groupBy("nid").agg(F.sum("size").alias("degree"))
    members = materialise(members.drop("size").join(degree, "nid"), "members")
    wanted = degree.join(nodes, "nid").select("nid", "node", "id")
    wanted_ids = materialise(wanted.select(F.col("id").alias("doc_id")).distinct(), "wanted-ids")
    texts = flagged(docs.select("doc_id", "text"), F.col("doc_id"), wanted_ids, F.col("doc_id")).where("__maybe").drop("__maybe")
    texts = null_safe(texts, wanted_ids, ["doc_id"], "left_semi")
    shingles = texts.mapInArrow(_shingles(size), "node binary, shingles array<long>").join(wanted.select("node", "nid"), "node").drop("node")
    shingles = materialise(shingles.dropDuplicates(["nid"]), "shingles")

    links, labels, tested, leaders, left_over = None, None, None, 1, None
    done = 0  # leaders that have had their turn since classes last changed
    while True:
        now = members.withColumn("comp", F.col("nid")) if labels is None else members.join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        # Buckets that hold more than one class still, and the largest class of each.
        by_class = now.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("degree").alias("d"))
        open_ = by_class.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum("k").alias("size"), F.max(F.struct("k", "d", "comp")).alias("m")).where("classes > 1")
        open_ = materialise(open_, "open")
        now = now_stored = materialise(now.join(open_.select("band", "size", F.col("m.comp").alias("main")), "band").withColumn("inside", F.col("comp") == F.col("main")).drop("main"), "open-buckets")
        largest = now.agg(F.max("size")).first()[0]
        if largest is None:
            break
        # Two nodes share at most the shingles that both have in common with anyone in an open bucket, and what their
        # profiles allow. These bounds rule out the scattered relatives of a text without looking at their shingles.
        if tested is None:
            now = now.withColumn("common", F.col("n")).withColumn("before", F.lit(None).cast("array<long>")).withColumn("profile", F.lit(None).cast("array<int>"))
        else:
            if left_over is None:
                ids = materialise(now.select("nid").distinct(), "open-nodes")
                theirs = flagged(shingles, F.col("nid"), ids, F.col("nid")).where("__maybe").drop("__maybe")
                theirs = materialise(theirs.join(ids, "nid", "left_semi"), "open-shingles")
                left_over = nodes.select("nid", "bands").join(ids, "nid", "left_semi").join(lone_shingles(theirs), "nid", "left").join(profiles(theirs), "nid")
                left_over = materialise(left_over.select("nid", "bands", "profile", F.coalesce("lone", F.lit(0)).alias("lone")), "left-over")
            now = now.join(left_over, "nid").withColumn("common", F.col("n") - F.col("lone")).withColumn("before", F.slice("bands", F.lit(1), F.col("nth")))
            now = now.where(F.col("common") >= threshold * F.col("n") - 1e-9)
        enough = F.least("common", "b_common") * (1 + threshold) >= threshold * (F.col("n") + F.col("b_n")) - 1e-9
        # A pair comes up in the first band that it shares alone.
        if tested is not None:
            most = F.aggregate(F.zip_with("profile", "b_profile", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
            enough &= ~F.arrays_overlap("before", "b_before") & (most * (1 + threshold) >= threshold * (F.col("n") + F.col("b_n")) - 1e-9)
        # Every pair of two classes has a node outside the bucket's largest class: that one is held against leaders
        # of both sides. In the first round the largest class is the node that leads.
        rank = F.row_number().over(W.partitionBy("band", "inside").orderBy(F.desc("degree"), "nid"))
        lead = now.where("inside") if labels is None and tested is None else now
        lead = lead.withColumn("r", rank).where((F.col("r") > done) & (F.col("r") <= leaders)).select("band", F.col("nid").alias("b"), F.col("n").alias("b_n"), F.col("comp").alias("b_comp"), F.col("common").alias("b_common"), F.col("before").alias("b_before"), F.col("profile").alias("b_profile"))
        lead = materialise(lead, "leaders")
        pairs = now.where("not inside").join(lead, "band").where((F.col("comp") != F.col("b_comp")) & (F.least("n", "b_n") >= threshold * F.greatest("n", "b_n") - 1e-9) & enough)
        pairs = pairs.select(F.least("nid", "b").alias("a"), F.greatest("nid", "b").alias("b")).distinct()
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        for done_with in (now_stored, open_, lead):
            discard(done_with)
        tested = pairs if tested is None else tested.union(pairs)
        found = materialise(verified(pairs, shingles, threshold), "verified")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels, done = components(links), 0
        elif leaders >= largest:
            break
        else:
            done = leaders
        leaders *= LEADERS
    named = nodes.select("node", "nid") if labels is None else nodes.select("node", "nid").join(labels, "nid", "left")
    named = named.select("node", F.col("nid").alias("comp") if labels is None else F.coalesce("comp", "nid").alias("comp"))
    return _classes(signed, named)


def _classes(signed: DataFrame, named: DataFrame) -> DataFrame:
    named = materialise(signed.where("n > 0").select("doc_id", "h", "node").join(named, "node"), "named")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = named.groupBy("comp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size"))
    classes = materialise(classes, "classes")
    named = named.join(classes, "comp").select("doc_id", "h", F.col("first.doc_id").alias("class_id"), "class_size", (place == F.col("first")).alias("kept"))
    rest = signed.where("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return named.unionByName(rest)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each class the first document by id and text hash, with all its columns."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    gone = materialise(gone, "near-dropped")
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__h": F.xxhash64("text")})
    # Rows that surely stay are not shuffled.
    keyed = flagged(keyed, F.struct("__id", "__h"), gone, F.struct("__id", "__h"))
    rest = null_safe(keyed.where("__maybe"), gone, ["__id", "__h"], "left_anti")
    return keyed.where("not __maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))


def op1_dart_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h")
