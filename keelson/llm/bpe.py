"""Byte-level BPE by a global distinct-word shuffle, and its decoding.

1. Explode: every task splits its texts into pre-tokens with their positions. Texts are
   taken in chunks of about CHUNK_TOKENS pre-tokens; a chunk keeps its positions as a
   stream of word numbers and sends each of its distinct words on once.
2. Encode: the chunks' words are shuffled by hash bucket. A bucket holds all occurrences of
   its words, so each distinct word of the corpus is encoded exactly once.
3. Join back: each chunk gets the ids of its words, bucket by bucket, and
4. reassembles its documents by position.

What is shuffled are packed blocks of words, ids and word numbers, a few bytes a pre-token.
Frequent words cost one entry a chunk, however often they occur, so none is hot.
Decoding looks ids up in the token-byte table, whose size is that of the vocabulary.

Defined results: a null text counts as empty and gives no ids; ids may repeat or be null,
every row gives a row. Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from .batches import text_slices
from .common import dealt_in_order, file_starts, place, stored, table

CHUNK_TOKENS = 4_000_000
BUCKET_BYTES = 8 << 20
BUCKETS = (64, 16_384)
#: Input that a task of the exchange takes, where the session's number of shuffle partitions gives each more.
PARTITION_BYTES = 32 << 20
#: Words of a chunk that get the small numbers, most frequent first; the others are numbered as they are sent.
FREQUENT = 1 << 16
# White space as Unicode has it, for a matcher whose own \s is ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MATCH = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+"
#: The part that a matcher without lookahead lacks: a run of spaces leaves its last one to what follows.
RUN = rf"([{SPACE}]+)([{SPACE}][^{SPACE}])"
MARKS = [chr(c) for c in (*range(0x1C, 0x20), *range(1, 9), *range(0xE000, 0xE010))]


@functools.lru_cache(2)
def encoding(ranks_file: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _marks(texts: pa.Array) -> list[str]:
    """Two characters that occur in no text."""
    free = []
    for m in MARKS:
        if not pc.any(pc.match_substring(texts, m)).as_py():
            free.append(m)
            if len(free) == 2:
                break
    return free


@functools.lru_cache(1)
def _differing() -> frozenset[str]:
    """Characters that two libraries' Unicode tables, an older and a newer one, call letter or number differently."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    array, found = pa.array(points), set()
    for kind in (r"\p{L}", r"\p{N}"):
        found |= set(array.filter(pc.match_substring_regex(array, kind)).to_pylist()) ^ set(regex.findall(kind, "".join(points)))
    return frozenset(found)


@functools.lru_cache(1)
def doubtful() -> str:
    """_differing() as a class of ranges; empty if the tables agree."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, _differing())):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]" if ranges else ""


@functools.lru_cache(4096)
def _stand_in(char: str) -> str:
    """A character that every table has, of the kind that the tokenizer's own table gives to char."""

    def joins(before: str) -> bool:
        ranks = {bytes([i]): i for i in range(256)} | {before.encode() + char.encode()[:1]: 256}
        return tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(before + char)[0] == 256

    return "!" if joins(":") else "é" if joins("z") else "1"


def _matches(text: str) -> list[str]:
    """Matches of the pattern one by one, for texts that the faster way can't take."""
    unsure = _differing() & set(text)
    known = text.translate({ord(c): _stand_in(c) for c in unsure})
    return [text[m.start() : m.end()] for m in regex.finditer(public_tokenizers.PATTERN, known)]


def pre_tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Matches of public_tokenizers.PATTERN in texts (no nulls): all of them in order, and how many each text has."""
    marks = _marks(texts)
    slow = np.full(len(texts), len(marks) < 2)
    if doubtful():
        slow |= pc.match_substring_regex(texts, doubtful()).to_numpy(zero_copy_only=False)
    if not slow.any():
        return _fast(texts, *marks)
    parts, counts = [], []
    edges = np.concatenate(([0], np.flatnonzero(slow[1:] != slow[:-1]) + 1, [len(texts)]))
    for a, b in zip(edges[:-1], edges[1:]):
        if slow[a]:
            found = [_matches(t) for t in texts.slice(a, b - a).to_pylist()]
            parts.append(pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode())
            counts.append(np.array([len(ws) for ws in found], np.int64))
        else:
            words, n = _fast(texts.slice(a, b - a), *marks)
            parts.append(words)
            counts.append(n)
    return pa.chunked_array(parts).unify_dictionaries().combine_chunks(), np.concatenate(counts)


def _fast(texts: pa.Array, cut: str, end: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    pieces = pc.split_pattern(pc.replace_substring_regex(texts, RUN, rf"\1{cut}\2"), cut)
    matched = pc.split_pattern(pc.replace_substring_regex(pieces.flatten(), MATCH, rf"\0{end}"), end)
    # Each piece ends with its last match, so its split ends with an empty string.
    offsets = matched.offsets.to_numpy().astype(np.int64)
    all_words = matched.flatten().dictionary_encode()
    keep = np.ones(len(all_words), bool)
    keep[offsets[1:] - offsets[0] - 1] = False
    words = pa.DictionaryArray.from_arrays(all_words.indices.filter(pa.array(keep)), all_words.dictionary)
    a_piece = np.diff(offsets) - 1
    ends = np.concatenate(([0], np.cumsum(a_piece)))
    of = pieces.offsets.to_numpy().astype(np.int64)
    of = of - of[0]
    return words, ends[of[1:]] - ends[of[:-1]]


def _pack(level: int = 3, **columns) -> bytes:
    """Arrays of any lengths, compressed."""
    names, arrays = zip(*columns.items())
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a)) for a in arrays], names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(blob) as r:
        row = r.read_next_batch()
    return {n: row.column(n).flatten() for n in row.schema.names}


#: key: the bucket for words, and below 0 one of the chunk's own for its positions and answers.
BLOCK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("key", pa.int64()), ("payload", pa.binary())])


def _explode(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list = []
        tokens = 0
        for part, texts in text_slices(batches):
            words, counts = pre_tokens(texts)
            held.append((part.column("doc_id"), words, counts))
            tokens += len(words)
            if tokens >= CHUNK_TOKENS:
                yield from _blocks(chunk, held, buckets)
                held, tokens, chunk = [], 0, chunk + 1
        if held:
            yield from _blocks(chunk, held, buckets)

    return run


def _blocks(chunk: int, held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """The chunk's positions as bucket -1, and its distinct words by bucket."""
    words = pa.chunked_array([w for _, w, _ in held]).unify_dictionaries()
    dictionary = words.chunk(0).dictionary
    index = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in words.chunks])
    times = np.bincount(index, minlength=len(dictionary))
    used = np.flatnonzero(times)
    # Words are sent bucket by bucket and sorted, in which order they and their ids take the least room.
    names = np.array(dictionary.take(pa.array(used)).to_pylist(), object)
    bucket = (pd.util.hash_array(names, categorize=False) % buckets).astype(np.int32) if len(used) else np.empty(0, np.int32)
    alphabetical = pc.sort_indices(dictionary.take(pa.array(used))).to_numpy().astype(np.int64)
    sent = alphabetical[np.argsort(bucket[alphabetical], kind="stable")]
    place = np.empty(len(used), np.int64)
    place[sent] = np.arange(len(used))
    frequent = np.argsort(-times[used], kind="stable")[:FREQUENT]
    number = np.empty(len(dictionary), np.uint32)
    number[used[sent]] = _numbers(place[frequent], len(used))
    planes = number[index].view(np.uint8).reshape(-1, 4)
    position = _pack(ids=pa.concat_arrays([i for i, _, _ in held]), counts=np.concatenate([c for _, _, c in held]), frequent=place[frequent].astype(np.uint32), words=np.array([len(used)]), **{f"b{k}": np.ascontiguousarray(planes[:, k]) for k in range(4)})
    yield _block(chunk, -1, -1 - chunk, position)
    edges = np.searchsorted(bucket[sent], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        mine = [w.encode() for w in names[sent[edges[b] : edges[b + 1]]]]
        yield _block(chunk, int(b), int(b), _pack(9, sizes=_narrow(np.fromiter(map(len, mine), np.int64, len(mine))), text=np.frombuffer(b"".join(mine), np.uint8)))


def _numbers(frequent: np.ndarray, words: int) -> np.ndarray:
    """The number of each word, in the order of sending, of which the frequent ones' places are given."""
    out = np.full(words, -1, np.int64)
    out[frequent] = np.arange(len(frequent))
    rest = out < 0
    out[rest] = len(frequent) + np.arange(int(rest.sum()))
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned, of the fewest bytes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _block(chunk: int, bucket: int, key: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([key]), pa.array([payload], pa.binary())], schema=BLOCK)


def _encode_words(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(ranks.value)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            for chunk, bucket, payload in zip(*(b.column(k).to_pylist() for k in ("chunk", "bucket", "payload"))):
                if bucket != now:
                    known, now = {}, bucket
                words = _unpack(payload)
                ends = np.cumsum(words["sizes"].to_numpy(), dtype=np.int64).tolist()
                text = words["text"].to_numpy().tobytes()
                lists = []
                at = 0
                for end in ends:
                    w, at = text[at:end], end
                    if (got := known.get(w)) is None:
                        got = known[w] = one(w)
                    lists.append(got)
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
                yield _block(chunk, bucket, -1 - chunk, _pack(9, sizes=_narrow(sizes), low=(flat & 255).astype(np.uint8), high=_narrow(flat >> 8)))

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def _documents(position: dict[str, pa.Array], answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents from its positions and the ids of its words, bucket by bucket."""
    parts, lengths = [], []
    for payload in answers:
        got = _unpack(payload)
        lengths.append(got["sizes"].to_numpy().astype(np.int64))
        parts.append(got["low"].to_numpy().astype(np.uint32) | got["high"].to_numpy().astype(np.uint32) << 8)
    length = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    assert len(length) == position["words"][0].as_py(), "a bucket's answer is missing"
    number = _numbers(position["frequent"].to_numpy(), len(length))
    sizes, starts = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    sizes[number] = length
    starts[number] = np.cumsum(length) - length
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    words = np.column_stack([position[f"b{k}"].to_numpy() for k in range(4)]).view(np.uint32).reshape(-1)
    counts = position["counts"].to_numpy()
    ends = np.cumsum(counts)
    step = max(1, len(counts) * 250_000 // max(1, len(words)))  # documents of about 250,000 words at once
    for a in range(0, len(counts), step):
        b = min(len(counts), a + step)
        low = ends[a] - counts[a]
        mine = words[low : ends[b - 1]]
        n = sizes[mine]
        ids = _gather(flat, starts[mine], n)
        edges = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends[a:b] - low))]
        blobs = pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([position["ids"].slice(a, b - a), blobs], ["doc_id", "ids"])


@functools.lru_cache(2)
def _pieces(ranks_file: bytes) -> dict[int, bytes]:
    """The token-byte table."""
    return {i: b for b, i in encoding(ranks_file)._mergeable_ranks.items()}


def _decoded(ids: pa.Array, ranks_file: bytes) -> pa.Array:
    piece = _pieces(ranks_file).__getitem__
    return pa.array([b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in ids.to_pylist()], pa.binary())


def _shipped(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary, whatever the corpus


def encode(docs: DataFrame, ranks_path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids binary: the ids of each text as little-endian unsigned 32-bit integers.

    ranks_path: a .tiktoken file that the driver reads. decoded: add the ids' bytes, as
    decode() does, in the same task. doc_id may be of any type, also a struct.
    """
    ranks = _shipped(docs.sparkSession, ranks_path)
    # Chunks are made of the rows that a task sees, so it must see the same ones when it runs again.
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = stored(docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text"), "bpe-input")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(max(size // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1])
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    schema = "chunk long, bucket int, key long, payload binary"
    # One exchange deals out words and positions; both branches below read it, and positions stay where it puts them.
    blocks = docs.mapInArrow(_explode(buckets), schema).repartition(partitions, "key")
    # A filter that Spark takes for nondeterministic stays above the exchange, so that both find the same one.
    only = lambda test: blocks.where(F.when(F.monotonically_increasing_id() >= 0, F.expr(test)))
    answers = only("bucket >= 0").sortWithinPartitions("bucket", "chunk").mapInArrow(_encode_words(ranks), schema)

    def assemble(position: pa.Table, answers: pa.Table) -> pa.Table:
        found = _documents(_unpack(position["payload"][0].as_py()), answers.sort_by("bucket")["payload"].to_pylist())
        rows = pa.Table.from_batches(found, out)
        return rows.append_column("decoded", _decoded(rows["ids"], ranks.value)) if decoded else rows

    out = pa.schema([("doc_id", pa_type(docs.schema["doc_id"].dataType)), ("ids", pa.binary())])
    return only("bucket < 0").groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(assemble, f"doc_id {id_type}, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for."""
    ranks = _shipped(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column("ids"), ranks.value)], ["doc_id", "ids", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256, decoded_sha256 string."""
    done = encode(docs, ranks_path, decoded=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return done.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digests_in_order(docs: DataFrame, ranks_path: str) -> DataFrame:
    """digests() and position long: the row's number, from 0, in the order in which docs were written to files.

    The rows come in this order over partitions and files.
    """
    docs = stored(docs.select("doc_id", "text"), "bpe-input", filters=False)
    done = digests(docs.select(F.struct("doc_id", place().alias("place")).alias("doc_id"), "text"), ranks_path)
    done = done.select("doc_id.*", *done.columns[1:]).withColumn("file", F.col("place.file"))
    done = done.join(F.broadcast(file_starts(docs)), "file").withColumn("position", F.col("before") + F.col("place.row"))
    return dealt_in_order(done.drop("file", "place", "before"), "position", docs.count())


def op4_word_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
