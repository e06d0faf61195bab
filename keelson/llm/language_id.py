"""Language ID by a linear-chain conditional random field over words.

A word's emission scores are sums of weights of its features: the word itself (lexicon) and
its byte n-grams of 2 to 4 with marks at both ends, so that prefixes and suffixes of up to
three bytes are features of their own. Transitions between the languages of neighbouring
words are learned. Forward-backward gives each word's marginal, so a code-switched text gets
its runs of languages; the text's language is the one with the most letters in expectation.

Training takes at most DOCS_A_LANGUAGE documents of each language (chosen by a hash of the
id), each with its whole text, and of those the ones that come before the language's part of
TRAIN_BYTES is used up; both bounds are parameters. Of over MAX_LANGUAGES languages those with
the most documents are learned. First every word carries its document's label; after half of
the steps, words that the model is sure stand in another language change over, since
documents switch within themselves.

A model also knows which n-grams of letters it has met, in one training text of MET_IN at
least, so that a few texts under a wrong language don't count. A word is familiar if at least half of
its n-grams are; `familiar` is the share of a text's letters that stand in familiar words. It
says whether the text is in any learned language at all, however many there are, which the
score, a share among the learned ones, can't.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text if no labelled row may be learned from. Held-out rows, null ids and null languages
teach nothing. Repeated rows give equal results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import SMALL_SLICE_BYTES, mix, text_slices
from .common import held_out, table

DOCS_A_LANGUAGE = 150
TRAIN_BYTES = 64 << 20
MAX_LANGUAGES = 200
STEPS = 24
GRAMS = (2, 3, 4)
SLOTS = 1 << 17
#: Slots of the n-grams that a model has met: more than weights have, so that few share one.
MET_SLOTS = 1 << 22
MET_IN = 200
#: Share of a word's n-grams that make it familiar.
FAMILIAR = 0.5
CHUNK = 256
U = np.uint64


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # (SLOTS, languages)
    transition: np.ndarray  # (languages, languages)
    met: np.ndarray  # MET_SLOTS marks of the n-grams in training


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts (no nulls), in order, and how many each text has. A text without a letter has none."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " "), " ")
    clean = pc.if_else(pc.match_substring_regex(texts, r"\p{L}"), clean, "")
    lists = pc.split_pattern(clean, " ")
    counts = np.diff(lists.offsets.to_numpy().astype(np.int64))
    words = lists.flatten()
    if not pc.all(pc.not_equal(clean, "")).as_py():  # an empty text splits into one empty word
        words = words.filter(pc.not_equal(words, ""))
        counts = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, counts)
    return words.dictionary_encode(), counts


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature hashes of distinct words, side by side with the word's number; and how many of the first are whole words."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(marked).to_numpy(), dtype=np.int64)))
    raw = np.frombuffer("".join(marked.to_pylist()).encode(), np.uint8).astype(U)
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    slots = [np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), U, len(words))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        m = max(0, len(raw) - n + 1)
        gram = np.full(m, n, U)
        for i in range(n):
            gram = gram << U(8) | raw[i : i + m]
        within = owner[:m] == owner[n - 1 :] if m else np.empty(0, bool)
        slots.append(mix(gram[within]))
        owners.append(owner[:m][within])
    return np.concatenate(slots), np.concatenate(owners), len(words)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U(SLOTS)).astype(np.int64)


def _met_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes // U((1 << 64) // MET_SLOTS)).astype(np.int64)


def _met(index: np.ndarray, counts: np.ndarray, grams: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """MET_SLOTS marks: whether enough of the texts hold an n-gram. grams and their words' numbers side by side."""
    order = np.argsort(owner, kind="stable")
    slots, edges = _met_slot(grams)[order], np.searchsorted(owner[order], np.arange(words + 1))
    texts = np.zeros(MET_SLOTS, np.int32)
    for at, n in zip(np.cumsum(counts) - counts, counts):
        mine = np.unique(index[at : at + n])
        texts[np.unique(np.concatenate([slots[edges[w] : edges[w + 1]] for w in mine]))] += 1
    return texts >= max(1, -(-np.count_nonzero(counts) // MET_IN))


def _read_words(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores of distinct words, and whether each is familiar."""
    hashes, owner, n = features(words)
    slots = _slot(hashes)
    emitted = np.column_stack([np.bincount(owner, model.emission[slots, k], n) for k in range(len(model.languages))])
    known = np.bincount(owner[n:], model.met[_met_slot(hashes[n:])], n)
    return emitted, known >= FAMILIAR * np.bincount(owner[n:], minlength=n)


def marginals(scores: np.ndarray, starts: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact forward-backward over chains laid end to end. starts marks each chain's first word.

    The words are cut into rows of CHUNK. Each row's transfer matrix is worked out for all
    rows at once, messages pass from row to row, and then all rows are filled at once.
    Returns each word's marginals and, if asked, the expected counts of transitions.
    """
    n, k = scores.shape
    rows = -(-n // CHUNK)
    psi = np.ones((rows * CHUNK, k))
    psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    psi = psi.reshape(rows, CHUNK, k)
    first = np.ones(rows * CHUNK, bool)
    first[:n] = starts
    first = first.reshape(rows, CHUNK)
    a = np.exp(transition - transition.max())

    carry = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(CHUNK):
        moved = np.where(first[:, t, None, None], carry.sum(axis=2, keepdims=True), carry @ a) * psi[:, t, None, :]
        carry = moved / moved.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((rows, k)), np.empty((rows, k))
    v = np.full(k, 1.0 / k)
    for r in range(rows):
        into[r] = v
        v = v @ carry[r]
        v /= v.sum()
    v = np.full(k, 1.0 / k)
    for r in range(rows - 1, -1, -1):
        out[r] = v
        v = carry[r] @ v
        v /= v.sum()

    alpha = np.empty((rows, CHUNK, k))
    now = into
    for t in range(CHUNK):
        now = np.where(first[:, t, None], 1.0, now @ a) * psi[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    gamma = np.empty((rows, CHUNK, k))
    back = out
    expected = np.zeros((k, k)) if pairs else None
    for t in range(CHUNK - 1, -1, -1):
        both = alpha[:, t] * back
        gamma[:, t] = both / both.sum(axis=1, keepdims=True)
        message = psi[:, t] * back
        if pairs:
            before = alpha[:, t - 1] if t else into
            joint = before[:, :, None] * a * message[:, None, :]
            joint[first[:, t]] = 0
            if t == 0:
                joint[0] = 0
            total = joint.sum(axis=(1, 2), keepdims=True)
            expected += (joint / np.where(total > 0, total, 1)).sum(axis=0)
        back = np.where(first[:, t, None], 1.0, message @ a.T)
        back = back / back.sum(axis=1, keepdims=True)
    return gamma.reshape(-1, k)[:n], expected


def fit(texts: list[str], labels: list[str], steps: int = STEPS) -> Model:
    """Gradient ascent on the chains' log-likelihood, with per-weight step sizes."""
    languages = sorted(set(labels))
    k = len(languages)
    words, counts = words_of(pa.array(texts, pa.string()))
    model = Model(languages, np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(MET_SLOTS, bool))
    if not len(words):
        return model
    hashes, owner, n = features(words.dictionary)
    slots = _slot(hashes)
    model.met = _met(words.indices.to_numpy(), counts[counts > 0], hashes[n:], owner[n:], n)
    if k == 1:
        return model
    index = words.indices.to_numpy().astype(np.int64)
    starts = np.zeros(len(index), bool)
    starts[(np.cumsum(counts) - counts)[counts > 0]] = True
    gold = np.repeat([languages.index(x) for x in labels], counts)
    # A document of any length and a language with any number of documents weigh alike.
    share = 1.0 / np.bincount(gold, minlength=k)[gold] * len(gold) / k
    inner = ~starts[1:]
    squares, t_squares = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
    for step in range(steps):
        emitted = np.column_stack([np.bincount(owner, model.emission[slots, j], len(words.dictionary)) for j in range(k)])
        gamma, expected = marginals(emitted[index], starts, model.transition, pairs=True)
        if step == steps // 2:
            sure = gamma.max(axis=1) > 0.9
            gold = np.where(sure, gamma.argmax(axis=1), gold)
        error = -gamma * share[:, None]
        error[np.arange(len(gold)), gold] += share
        by_word = np.column_stack([np.bincount(index, error[:, j], len(words.dictionary)) for j in range(k)])
        grad = np.column_stack([np.bincount(slots, by_word[owner, j], SLOTS) for j in range(k)]) - 0.5 * model.emission
        squares += grad**2
        model.emission += 0.5 * grad / np.sqrt(squares)
        held = np.bincount(gold[:-1][inner] * k + gold[1:][inner], minlength=k * k).reshape(k, k)
        t_grad = held - expected - 0.5 * model.transition
        t_squares += t_grad**2
        model.transition += 0.5 * t_grad / np.sqrt(t_squares)
    return model


def train(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """Learns from documents that are not held out; None if there is none with a language."""
    size = F.octet_length("text").cast("long")
    labelled = docs.select("doc_id", "lang", "text", size.alias("size")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("size") > 0) & ~held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    sizes = labelled.select("doc_id", "lang", "size")
    names = [r["lang"] for r in sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    if not names:
        return None
    first = sizes.where(F.col("lang").isin(names)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_a_language)
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= train_bytes // len(names)).select("doc_id", "lang", "size")
    # At most docs_a_language * MAX_LANGUAGES ids; as many texts, of train_bytes together, on the driver. Rows that agree in
    # id, language and size give one text.
    keys = ["doc_id", "lang", "size"]
    picked = labelled.join(F.broadcast(chosen.distinct()), keys, "left_semi").groupBy(*keys).agg(F.min("text").alias("text")).orderBy(*keys).collect()
    return fit([r["text"] for r in picked], [r["lang"] for r in picked]) if picked else None


RESULT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("familiar", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))])


def label_texts(model: Model | None, texts: pa.Array, spans: bool = False) -> pa.RecordBatch:
    """lang_pred, score, the share of letters in familiar words and, if asked, the runs of words of one language, of each text."""
    words, counts = words_of(texts)
    lang = np.full(len(texts), "und", object)
    score, familiar = np.zeros(len(texts)), np.zeros(len(texts))
    runs: list = [[] if spans else None] * len(texts)
    if model is not None and len(words):
        index = words.indices.to_numpy().astype(np.int64)
        full = np.flatnonzero(counts)
        at = (np.cumsum(counts) - counts)[full]
        starts = np.zeros(len(index), bool)
        starts[at] = True
        emitted, known = _read_words(model, words.dictionary)
        gamma, _ = marginals(emitted[index], starts, model.transition)
        letters = pc.utf8_length(words.dictionary).to_numpy()[index]
        familiar[full] = np.add.reduceat(letters * known[index], at) / np.add.reduceat(letters, at)
        mass = np.add.reduceat(gamma * letters[:, None], at, axis=0)
        mass /= mass.sum(axis=1, keepdims=True)
        lang[full] = np.array(model.languages, object)[mass.argmax(axis=1)]
        score[full] = mass.max(axis=1)
        if spans:
            best = gamma.argmax(axis=1)
            for d, a in zip(full, at):
                mine = best[a : a + counts[d]]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]))
                runs[d] = [{"first": int(x), "last": int(y) - 1, "lang": model.languages[mine[x]]} for x, y in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(familiar), pa.array(runs, RESULT.field("spans").type)], schema=RESULT)


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """docs with lang_pred string, score and familiar double, and spans (word numbers; null unless asked for) added, in place of such columns."""
    docs = docs.drop(*RESULT.names)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS by languages
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SMALL_SLICE_BYTES):
            found = label_texts(shipped.value, texts, spans)
            yield pa.RecordBatch.from_arrays([*part.columns, *found.columns], [*names, *found.schema.names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, familiar double, spans array<struct<first:int,last:int,lang:string>>"]))


def keep_identified(docs: DataFrame, model: Model | None, min_familiar: float) -> DataFrame:
    """Rows of docs, as they are, whose text has letters, at least min_familiar of them in familiar words."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SMALL_SLICE_BYTES):
            found = label_texts(shipped.value, texts)
            yield part.filter(pc.and_(pc.not_equal(found.column("lang_pred"), "und"), pc.greater_equal(found.column("familiar"), min_familiar)))

    return docs.mapInArrow(run, docs.schema)


def op7_crf_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
