"""License scans, source mixing, streaming dedup: edge cases, and brute force where SQL gives no second opinion."""

import hashlib
import re
import string
import textwrap

import pytest
from pyspark.sql import functions as F

from keelson.llm import license_scan, mixing, registry, stream_dedup

from ..oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, kept string, place string"


def documents(spark, texts, sources=None):
    """Rows (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", sources[k] if sources else "a", None, 7, "x", "y", "z") for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], sf)


LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, "MIT license, mit License!"), (3, "MIT license, mit License!"), (None, "the general public license"), (5, LONG), (6, "mit\nlicense"), (7, "mKtt LICENſE mit-license"), (8, "Released under the MIT License."), (9, "MIT license, mit License!")]


def test_license_scan_cases(spark):
    got = license_scan.scan_licenses(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in ODD:
        lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = by[i][0]
        starts = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
    assert len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[1][0]["labels"] == "" and by[1][0]["score"] == 0.0
    assert by[6][0]["base_labels"] == "mit" and by[8][0]["labels"] == "mit" and by[8][0]["n_blocks"] == 1
    assert license_scan.scan_licenses(documents(spark, ODD).where("false")).collect() == []


def test_template_join_equals_all_pairs(spark):
    rows = license_scan._template_rows(license_scan.TEMPLATES)
    texts = [" ".join(tokens[cut:] + ["filler"] * pad) + "\nother line the of" for _, _, tokens in rows for cut in (0, 1, 2, 3) for pad in (0, 4)]
    docs = documents(spark, list(enumerate(texts)))
    for threshold in (0.5, 0.8, 0.9, 1.0):
        got = {(r["doc_id"], r["block"], r["label"], round(r["containment"], 9)) for r in license_scan.template_matches(docs, threshold=threshold).collect()}
        want = set()
        for i, t in enumerate(texts):
            for b, line in enumerate(t.split("\n")):
                met = [(set(x), label, len(set(x) & set(line.split())) / len(x)) for _, label, x in rows if len(set(x) & set(line.split())) >= threshold * len(x) - 1e-9]
                want |= {(i, b, label, round(c, 9)) for x, label, c in met if not any(x < y for y, _, _ in met)}
        assert got == want


def test_wrapped_templates_are_found(spark):
    """Every template, wrapped at 72 columns behind comment marks and after 0 to 60 columns of another word, gets the labels that it has on one line."""
    flat = [(label, notice) for label, notices in license_scan.TEMPLATES.items() for notice in notices]
    whole = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan_licenses(documents(spark, [(k, x) for k, (_, x) in enumerate(flat)])).collect()}
    one_line = {x: whole[k] for k, (_, x) in enumerate(flat)}
    texts, want = [], []
    for label, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            for mark in ("", "# ", "// ", " * ", "dnl "):
                for ahead in (0, 40, 60):
                    lines = textwrap.wrap("x" * ahead + " " + notice, 72 - len(mark), break_on_hyphens=False)
                    texts.append("\n".join(["int main;", *[mark + x for x in lines], "return 0;"]))
                    want.append((one_line[notice], one_line[notice] | {label}))
    texts += ["Permission is hereby granted, free\n" + "other words " * 40 + "\nof charge, to any person obtaining a copy of this software and associated documentation files"]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files\n" * 2, None, ""]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    # A line that holds enough of a narrower template keeps its label.
    missed = [(texts[k], least, got[k]) for k, (least, most) in enumerate(want) if not least <= set(got[k]["labels"].split(",")) <= most or got[k]["score"] < 0.9 or not 1 <= got[k]["n_blocks"] <= 2]
    assert not missed
    n = len(want)
    assert got[n]["labels"] == "" and got[n]["score"] == 0
    assert got[n + 1]["labels"] == "mit" and got[n + 1]["n_blocks"] == 2
    assert got[n + 2]["labels"] == got[n + 3]["labels"] == ""


def test_pfair_keeps_every_source_within_a_block():
    for weights in ([1], [1, 1], [3, 2, 1], [10, 1, 1, 7], [1] * 20, list(mixing.TARGETS.values())):
        done, total = [0] * len(weights), sum(weights)
        for slot, i, j in mixing.pfair_period(weights):
            assert j == done[i]
            done[i] += 1
            assert all(abs(d - w * (slot + 1) / total) < 1 for d, w in zip(done, weights))
        assert done == weights
    with pytest.raises(ValueError):
        mixing.pfair_period([mixing.MAX_PERIOD, 1])


def test_mixing_places_every_row(spark):
    texts = [(k % 400 if k % 50 else None, "x" * (k * 37 % 3000)) for k in range(900)] + [(7, None), (7, None), (1000, "y" * 400_000)]
    sources = [("hot", "hot", "b", None)[k % 4] for k in range(len(texts))]
    docs = documents(spark, texts, sources)
    targets = {"hot": 1, "b": 3, None: 2}
    block = 10_000
    rows = sorted(mixing.schedule(docs, targets, block_bytes=block).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(texts)))
    assert [(r["slot"], r["slot_rank"]) for r in rows] == sorted((r["slot"], r["slot_rank"]) for r in rows)
    # At every slot before the first source ends, each source's bytes are within a block of its share, but for the
    # documents that reach over the end of their block.
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in targets}
    cut = max(r["slot"] for r in rows if r["balanced"])
    assert any(not r["balanced"] for r in rows) and all((r["slot"] <= cut) == r["balanced"] for r in rows)
    for upto in range(cut + 1):
        for source, weight in targets.items():
            done = sum(r["size"] for r in rows if r["source"] == source and r["slot"] <= upto)
            share = weight * (upto + 1) / 6 * block
            assert -block < done - share < block + longest[source]
    mixed = mixing.mix(docs, targets, block_bytes=block)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert [(r["doc_id"], r["source"], len(r["text"] or "")) for r in got] == [(r["doc_id"], r["source"], r["size"] if r["size"] > 1 else len(g["text"] or "")) for r, g in zip(rows, got)]
    assert mixing.schedule(docs.where("false"), targets).collect() == [] == mixing.mix(docs.where("false"), targets).collect()
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"hot": 0})


DUPES = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (3, "a b"), (None, "a b"), (4, None), (6, ""), (7, " "), (8, " "), (2, LONG), (1, LONG + " "), (None, "z"), (None, "z")]


def expected(rows):
    norm = lambda t: re.sub("[\\x20\\x09-\\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda c: F.substring(stream_dedup.sha256(c), 1, 0), lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)])
def test_dedup_cases_also_where_digests_collide(spark, digest):
    docs = documents(spark, DUPES)
    got = stream_dedup.find_duplicates(docs, digest).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=repr) == expected(DUPES)


def test_dedup_keeps_rows_and_columns(spark):
    docs = documents(spark, DUPES)
    left = stream_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == sum(r[3] for r in expected(DUPES))
    assert stream_dedup.find_duplicates(docs.where("false")).collect() == []


def told(rows):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows], key=repr)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)])
@pytest.mark.parametrize("from_files", [True, False])
def test_state_goes_on_in_later_runs(spark, tmp_path, digest, from_files):
    """Three calls with one checkpoint tell what one call over all rows does; smaller ids come late."""
    parts = [[(50, "a  b"), (51, "c"), (52, None), (53, "x")], [(10, "a b"), (11, "d"), (11, "d"), (12, "")], [(5, "c\t"), (60, "a\nb"), (None, "d"), (61, "y"), *[(100 + k, f"text {k}") for k in range(40)]]]
    before = []
    for k, part in enumerate(parts):
        docs = documents(spark, part)
        if from_files:
            docs.write.parquet(f"{tmp_path}/in {k}")
            docs = spark.read.parquet(f"{tmp_path}/in {k}")
        before += part
        found = stream_dedup.find_duplicates(docs, digest, f"{tmp_path}/state")
        want = expected(before)
        got = told(found.collect())
        # Of this call's rows, in groups with all rows so far.
        assert len(got) == len(part) and all(g in want for g in got)
    got = stream_dedup.find_duplicates(documents(spark, []), digest, f"{tmp_path}/state", all_runs=True)
    assert told(got.collect()) == expected(before)


def test_a_file_that_is_read_twice(spark, sf):
    path = f"{sf}/documents.parquet"
    docs = spark.read.parquet(path, path)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert told(stream_dedup.find_duplicates(docs).collect()) == expected(rows)
    left = stream_dedup.drop_duplicates(docs).collect()
    assert len(left) == len({re.sub("[\\x20\\x09-\\x0D]+", " ", t) for _, t in rows})
