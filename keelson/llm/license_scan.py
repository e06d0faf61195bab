"""License scans: an exact set-similarity join of text blocks with license templates.

Main path: DataFrame functions only.

* A block is one line of a document. Its tokens are the distinct words of the line,
  after A-Z are lower-cased.
* A template matches a block if the block holds at least `threshold` of the template's
  distinct tokens (containment).
* Tokens are ordered by their global document frequency, rarest first. A block that holds
  o = ceil(threshold * m) of a template's m tokens holds one of its first m - o + 1, so
  only blocks with such a prefix token are candidates (prefix filter); blocks of under o
  tokens are not (length filter); nor are those whose first hit stands so late in either
  order that o can't be reached (positional filter). What is left is counted exactly.
* Where a block meets two templates of which one's tokens include the other's, the wider
  template alone gives a label.
* Notices that are wrapped over lines are found in runs of a template's length in words (and
  an eighth and one more, for comment marks that are words) across line breaks, at every word.
  The same filters hold: a run that matches holds a prefix token, so only runs about one are
  looked at. Runs that touch a line which the template matches by itself are left out, and
  of a template's runs that overlap the first is a block.

Whole texts are read once: their word counts, phrase places and template tokens go into small
stored rows, from which the global order comes. Only texts that hold enough tokens of some
template are read again and cut into blocks.

Empty and null texts have no word and no label. Repeated rows each get their own row.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, materialise, null_safe, place, stored, table

# Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening sentences and short notices of public licenses, by label.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

THRESHOLD = 0.9
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower_ascii(text: Column) -> Column:
    """A-Z only; lower() does that, and faster, where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(_lower_ascii(text), F.lit(WORD), F.lit(0))


def _phrase_starts(ws: Column, phrase: str) -> Column:
    parts = phrase.split()
    n = F.size(ws) - len(parts)

    def stands(i: Column) -> Column:
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(ws, i + k) == part)
        return hit

    # Most texts lack the phrase's last word.
    return F.when((n >= 0) & F.array_contains(ws, parts[-1]), F.filter(F.sequence(F.lit(0), n), stands)).otherwise(F.array().cast("array<int>"))


def _template_rows(templates: Mapping[str, list[str]]) -> list[tuple[int, str, list[str]]]:
    rows = []
    for label, texts in sorted(templates.items()):
        for text in texts:
            tokens = sorted(set(re.findall("[a-z0-9]+", text.lower())))
            rows.append((len(rows), label, tokens))
    return rows


def _run_lengths(templates: Mapping[str, list[str]]) -> list[int]:
    """The most words in which a template may stand across lines, in the order of _template_rows()."""
    lengths = [len(re.findall("[a-z0-9]+", text.lower())) for _, texts in sorted(templates.items()) for text in texts]
    return [n + n // 8 + 1 for n in lengths]


def _literal(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small fixed table as a plan of literals."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def _vocabulary(templates: Mapping[str, list[str]]) -> list[str]:
    return sorted({t for _, _, tokens in _template_rows(templates) for t in tokens})


def _known(ws: Column, templates: Mapping[str, list[str]]) -> Column:
    """The distinct template tokens among words."""
    return F.array_intersect(F.array(*[F.lit(t) for t in _vocabulary(templates)]), ws)


def _plan(known: DataFrame, templates: Mapping[str, list[str]], threshold: float) -> tuple[list[dict], list[dict], dict[str, int]]:
    """The templates with their tokens in the global order, their prefix tokens, and that order. known: a row of _known() a document."""
    rows, vocabulary = _template_rows(templates), _vocabulary(templates)
    # Global frequencies of the template tokens over all documents. At most len(vocabulary) rows reach the driver.
    found = known.select(F.explode("known").alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}

    prefixes, whole = [], []
    for tid, label, tokens in rows:
        ordered = sorted(tokens, key=order.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        wider = [other for other, _, more in rows if set(tokens) < set(more)]
        whole.append({"tid": tid, "label": label, "tokens": ordered, "m": len(ordered), "need": need, "wider": wider})
        prefixes += [{"token": t, "tid": tid, "pos": k} for k, t in enumerate(ordered[: len(ordered) - need + 1])]
    return whole, prefixes, order


def template_matches(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, plan: tuple | None = None) -> DataFrame:
    """(doc_id, text_hash, block, label, containment): every block and template at or over the threshold.

    text_hash tells repeated ids apart; block counts a text's lines from 0.
    """
    whole, prefixes, order = plan or _plan(docs.select(_known(words(F.coalesce("text", F.lit(""))), templates).alias("known")), templates, threshold)
    prefix_tokens = sorted({p["token"] for p in prefixes})
    index = _literal(docs, prefixes, "array<struct<token:string,tid:int,pos:int>>")
    templates_df = _literal(docs, whole, "array<struct<tid:int,label:string,tokens:array<string>,m:int,need:int,wider:array<int>>>")

    # A text without any prefix token as a substring has no candidate block. (?i) is ASCII only, as the words are.
    blocks = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        .where(F.col("text").rlike("(?i)" + "|".join(prefix_tokens)))
        .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("block", "line"))
        .where(F.col("line").rlike("(?i)" + "|".join(prefix_tokens)))
        .select("doc_id", "text_hash", "block", F.array_distinct(words(F.col("line"))).alias("tokens"))
        # In the global order, tokens outside the templates' vocabulary can't count and are left out.
        .select("doc_id", "text_hash", "block", F.size("tokens").alias("n"), F.array_intersect(F.array(*[F.lit(t) for t in sorted(order, key=order.__getitem__)]), "tokens").alias("known"))
    )
    # Both sides of each join: the index and the templates have a fixed, literal size.
    hits = (
        blocks.select("*", F.posexplode("known").alias("at", "token"))
        .join(F.broadcast(index), "token")
        .groupBy("doc_id", "text_hash", "block", "tid")
        .agg(F.min(F.struct("pos", "at")).alias("first"), F.first("known").alias("known"), F.first("n").alias("n"))
        .join(F.broadcast(templates_df), "tid")
        .where(F.col("n") >= F.col("need"))
        .where(1 + F.least(F.col("m") - F.col("first.pos") - 1, F.size("known") - F.col("first.at") - 1) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("known", "tokens"))
    matched = hits.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    # At most one entry a template, so a block's list is small.
    by_block = matched.groupBy("doc_id", "text_hash", "block").agg(F.collect_list(F.struct("tid", "label", "wider", (F.col("overlap") / F.col("m")).alias("containment"))).alias("all"))
    kept = F.filter("all", lambda x: ~F.arrays_overlap(x["wider"], F.transform("all", lambda y: y["tid"])))
    return by_block.select("doc_id", "text_hash", "block", F.explode(kept).alias("m")).select("doc_id", "text_hash", "block", "m.label", "m.containment")


def wrapped_matches(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, plan: tuple | None = None) -> DataFrame:
    """(doc_id, text_hash, block, label, containment): templates that no line holds, in runs across lines.

    block is the line in which the run begins; of runs that overlap, the first one counts.
    """
    whole, prefixes, order = plan or _plan(docs.select(_known(words(F.coalesce("text", F.lit(""))), templates).alias("known")), templates, threshold)
    for t, most in zip(whole, _run_lengths(templates)):
        t["most"] = most
        t["prefix"] = [p["token"] for p in prefixes if p["tid"] == t["tid"]]
    fields = "tid:int,label:string,tokens:array<string>,m:int,need:int,most:int,prefix:array<string>"
    plain = [{k: v for k, v in t.items() if k != "wider"} for t in whole]
    for t, row in zip(whole, plain):
        row["wider"] = [plain[w] for w in t["wider"]]
    literal = F.from_json(F.lit(json.dumps(plain)), f"array<struct<{fields},wider:array<struct<{fields}>>>>")
    vocab = F.array(*[F.lit(t) for t in sorted(order, key=order.__getitem__)])
    # A text holds what its runs hold, so the filters on whole texts leave few candidates. The row's
    # number keeps Spark from putting the words of a text into each use of them.
    texts = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        .where(F.col("text").rlike("(?i)" + "|".join(sorted({p["token"] for p in prefixes}))))
        .where(F.instr("text", "\n") > 0)
        .withColumn("known", F.array_intersect(vocab, words(F.col("text"))))
        .withColumn("row", F.monotonically_increasing_id())
    )
    held = lambda t: F.arrays_overlap("known", t["prefix"]) & (F.size(F.array_intersect("known", t["tokens"])) >= t["need"])
    found = texts.withColumn("met", F.filter(literal, held)).where(F.size("met") > 0)
    lines = F.transform(F.split("text", "\n"), lambda line, n: F.transform(words(line), lambda w: F.struct(n.alias("line"), w.alias("word"))))
    found = found.select("doc_id", "text_hash", "row", "met", F.flatten(lines).alias("seq")).withColumn("again", F.monotonically_increasing_id())
    near = found.select("doc_id", "text_hash", "row", "seq", F.explode("met").alias("t"))
    # Runs of wider templates about the same place count too, so the neighbourhood is theirs in width.
    reach = F.greatest(F.col("t.most"), F.coalesce(F.array_max(F.transform("t.wider", lambda w: w["most"])), F.lit(0)))
    near = near.select("doc_id", "text_hash", "row", "t", reach.alias("reach"), "seq")
    low = lambda at: F.greatest(F.lit(0), at - F.col("reach"))
    around = lambda at: F.slice("seq", low(at) + 1, at - low(at) + F.col("reach") + 1)
    overlap = lambda part, t: F.size(F.array_intersect(part["word"], t["tokens"]))
    # Only neighbourhoods leave a text; a copy of the text for each of its words would not fit in memory.
    spots = F.filter(F.sequence(F.lit(0), F.size("seq") - 1), lambda at: F.array_contains("t.prefix", F.get("seq", at)["word"]) & (overlap(around(at), F.col("t")) >= F.col("t.need")))
    near = near.select("doc_id", "text_hash", "row", "t", F.explode(F.transform(spots, lambda at: F.struct(low(at).alias("low"), around(at).alias("seq")))).alias("spot"))
    near = near.select("doc_id", "text_hash", "row", "t", F.col("spot.low").alias("low"), F.col("spot.seq").alias("seq"))

    def runs(t: Column) -> Column:
        """Runs of t that start with one of its tokens and hold enough of them: (from, till, first, last, overlap)."""
        run = lambda i: F.slice("seq", i + 1, t["most"])
        starts = F.filter(F.sequence(F.lit(0), F.size("seq") - 1), lambda i: F.array_contains(t["tokens"], F.get("seq", i)["word"]) & (overlap(run(i), t) >= t["need"]))
        return F.transform(starts, lambda i: F.struct((F.col("low") + i).alias("from"), overlap(run(i), t).alias("overlap"), run(i).alias("run")))

    near = near.where(~F.exists("t.wider", lambda w: F.size(runs(w)) > 0)).select("doc_id", "text_hash", "row", "t", F.explode(runs(F.col("t"))).alias("r"))
    # The run ends where it first holds all that it does.
    ends = F.filter(F.sequence(F.lit(1), F.size("r.run")), lambda k: overlap(F.slice("r.run", 1, k), F.col("t")) == F.col("r.overlap"))
    near = near.withColumn("n", F.get(ends, F.lit(0))).withColumn("run", F.slice("r.run", 1, F.col("n")))
    own = F.filter("run", lambda x: F.array_contains("t.tokens", x["word"]))
    near = near.select("doc_id", "text_hash", "row", "t", F.col("r.from").alias("from"), F.col("r.overlap").alias("overlap"), own.alias("own"), "n")
    by_line = F.transform(F.array_distinct("own.line"), lambda n: F.size(F.array_distinct(F.filter("own", lambda x: x["line"] == n)["word"])))
    near = near.where((F.size(by_line) > 1) & (F.array_max(by_line) < F.col("t.need")))
    run = near.select("doc_id", "text_hash", "row", F.col("t.tid").alias("tid"), F.col("t.label").alias("label"), "from", (F.col("from") + F.col("n")).alias("till"), F.get("own", F.lit(0))["line"].cast("int").alias("line"), (F.col("overlap") / F.col("t.m")).alias("containment"))
    # Of runs that overlap, the first in the text counts; a list holds one text's runs of one template.
    each = run.groupBy("doc_id", "text_hash", "row", "tid").agg(F.first("label").alias("label"), F.array_sort(F.collect_set(F.struct("from", "till", "line", "containment"))).alias("runs"))
    none = F.slice("runs", 1, 0)
    apart = F.aggregate("runs", none, lambda done, x: F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), done["till"]), -1), F.lit(0)) <= x["from"], F.concat(done, F.array(x))).otherwise(done))
    notice = each.select("doc_id", "text_hash", "label", F.explode(apart).alias("x")).select("doc_id", "text_hash", F.col("x.line").alias("block"), "label", F.col("x.containment").alias("containment"))
    return notice.select("doc_id", "text_hash", "block", "label", "containment")


def scan_licenses(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: word count, phrase places, and the labels of phrases and templates.

    doc_id, n_words long, n_base long, first_word, last_word long (null without a place),
    base_labels, labels string (sorted, distinct, comma-joined; '' if there is none),
    score double (1 for a phrase place, else the best containment, else 0), n_blocks long.
    """
    docs = stored(docs.select("doc_id", "text"), "license-input")
    read = docs.select("doc_id", place().alias("place"), F.xxhash64("text").alias("text_hash"), words(F.coalesce("text", F.lit(""))).alias("ws"))
    at = [_phrase_starts(F.col("ws"), p).alias(f"at_{k}") for k, p in enumerate(PHRASES)]
    base = materialise(read.select("doc_id", "place", "text_hash", F.size("ws").cast("long").alias("n_words"), *at, _known(F.col("ws"), templates).alias("known")), "license-words")
    plan = _plan(base, templates, threshold)
    # A text holds what its blocks hold. Texts of the others aren't read again.
    enough = [F.size(F.array_intersect("known", F.array(*[F.lit(x) for x in t["tokens"]]))) >= t["need"] for t in plan[0]]
    wanted = materialise(base.where(reduce(lambda a, b: a | b, enough)).select("place"), "license-wanted")
    texts = flagged(docs.withColumn("place", place()), F.col("place"), wanted, F.col("place")).where("__maybe").drop("__maybe")
    texts = materialise(texts.join(wanted, "place", "left_semi").select("doc_id", "text"), "license-texts")
    matched = (
        template_matches(texts, templates, threshold, plan)
        .union(wrapped_matches(texts, templates, threshold, plan))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count_distinct("block").alias("n_blocks"))
    )
    starts = F.concat(*[f"at_{k}" for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())]))
    base = base.select(
        "doc_id", "text_hash", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("phrases"),
    )
    out = null_safe(base, matched, ["doc_id", "text_hash"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("phrases", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("phrases", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = _template_rows(TEMPLATES)
    values = ", ".join(f"({tid}, '{label}', {tokens})" for tid, label, tokens in rows)
    lowered = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = f"regexp_extract_all({lowered}, '{WORD}')"
    at = ", ".join(
        "list_filter(range(0, greatest(len(w) - {n}, 0)), lambda i: {test})".format(n=len(p.split()) - 1, test=" AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))) + f" AS a{j}" for j, p in enumerate(PHRASES)
    )
    starts = "list_concat(list_concat(a0, a1), a2)"
    base = ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{v}' END" for k, v in enumerate(PHRASES.values()))
    return f"""
WITH t(tid, label, tokens) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {split.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, unnest(range(0, len(ls))) AS block, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
bw AS (SELECT doc_id, block, list_distinct({split.format("line")}) AS w FROM b),
m AS (SELECT doc_id, block, tid, label, tokens, len(list_intersect(w, tokens)) / len(tokens) AS c FROM bw, t
      WHERE len(list_intersect(w, tokens)) >= {THRESHOLD} * len(tokens) - 1e-9),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.doc_id = m.doc_id AND o.block = m.block
      AND len(o.tokens) > len(m.tokens) AND list_has_all(o.tokens, m.tokens))),
g AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS best, count(DISTINCT block) AS n_blocks FROM k GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, {at} FROM d),
p AS (SELECT doc_id, n_words, {starts} AS st, list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS phrases FROM s)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(st) AS BIGINT) AS n_base,
  CAST(list_min(st) AS BIGINT) AS first_word, CAST(list_max(st) AS BIGINT) AS last_word,
  coalesce(array_to_string(phrases, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(phrases, coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN len(st) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score,
  CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM p LEFT JOIN g ON p.doc_id = g.doc_id"""
