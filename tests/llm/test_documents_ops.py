"""Operators on documents against brute force, with nulls, blanks, copies, long texts, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from edge import alnum, ascii_lower, spaced
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnflow.llm import bpe, decontamination, language_id, license_scan, near_dedup, quality, substring_dedup, token_counts
from txnflow.llm.q05_license_scan import TEMPLATES
from txnflow.llm.tables import scratch_path

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def same_rows(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


# token counts ---------------------------------------------------------------------------------------------------

def test_token_counts(spark, edge_docs, edge_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = scratch_path(spark, "token-cache")
    for _ in range(2):                                  # the second run finds all counts in the cache
        got = token_counts.count_tokens(edge_docs, PIECE, cache)
        same_rows(got.select("doc_id", "text", "n_bytes", "n_tokens").collect(),
                  [(i, t, len((t or "").encode()), len(model.encode(t or ""))) for i, t in edge_rows])
        assert set(got.columns) == {*edge_docs.columns, "n_bytes", "n_tokens"}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in edge_rows})
    word = token_counts.count_tokens(edge_docs, WORD, cache).where("doc_id = 11").first()
    assert word["n_tokens"] == 1 and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_token_counts_read_what_is_stored(spark, edge_docs):
    """Only misses are encoded: a stored count is returned as it is."""
    cache = scratch_path(spark, "token-cache")
    version = token_counts.tokenizer_digest(PIECE)
    digest = hashlib.sha256(b"one").digest()
    spark.createDataFrame([(bytearray(digest), 3, 777, version)], token_counts.CACHE_SCHEMA) \
        .union(spark.createDataFrame([(bytearray(digest), 3, 777, version)], token_counts.CACHE_SCHEMA)) \
        .write.partitionBy("tokenizer").parquet(cache)
    got = token_counts.count_tokens(edge_docs.where("doc_id in (11, 12)"), PIECE, cache).select("doc_id", "n_tokens").collect()
    assert dict(map(tuple, got))[11] == 777 and len(got) == 2


def test_token_counts_of_nothing(spark, no_docs):
    assert token_counts.count_tokens(no_docs, PIECE, scratch_path(spark, "token-cache")).collect() == []


# repeated passages ----------------------------------------------------------------------------------------------

def removed_words(rows, window):
    """{row number: kept words}; rows as (id, text)."""
    first = {}
    words = [spaced(t) for _, t in rows]
    order = [(float("inf") if i is None else i) for i, _ in rows]
    for n, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (order[n], s)), (order[n], s))
    out = []
    for n, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (order[n], s):
                gone |= set(range(s, s + window))
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_substring_dedup(edge_docs, edge_rows, window):
    got = substring_dedup.dedup_substrings(edge_docs, window=window)
    want = removed_words(edge_rows, window)
    same_rows(got.select("doc_id", "text", "n_words", "n_removed", "kept_text").collect(),
              [(i, t, *w) for (i, t), w in zip(edge_rows, want)])
    assert {"score", "kept", "oid", "spans"} <= set(got.columns)


def test_substring_dedup_splits_hot_minimisers(spark, monkeypatch):
    """A phrase in every document amid different words fills no bucket, and results stay exact."""
    import random
    import numpy as np
    import pyarrow as pa
    from txnflow.llm import wordbytes
    rng = random.Random(3)
    names = wordbytes.scan(pa.array([" ".join(f"c{i}" for i in range(20_000))]), wordbytes.SPACED)
    at = int(np.argmin(wordbytes.grams(names.hashes(), 3)))
    phrase = [f"c{at}", f"c{at + 1}", f"c{at + 2}"]
    own = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows = [(i, " ".join(own(25) + phrase + own(25))) for i in range(300)]
    rows += [(i, " ".join(rows[rng.randrange(300)][1].split()[14:44] + own(3))) for i in (400, 401, 402, 7, None, None)] + rows[9:11]
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 16_000, raising=False)
    real = substring_dedup.repeated_in_bucket

    def bounded(window):
        solve = real(window)

        def run(table):
            import zstandard
            volume = sum(len(zstandard.decompress(x)) for x in table["packed"].to_pylist() if x is not None)
            assert volume < 30_000, f"{volume} bytes in a bucket"
            return solve(table)
        return run

    monkeypatch.setattr(substring_dedup, "repeated_in_bucket", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup_substrings(docs, window=20).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    want = removed_words(rows, 20)
    same_rows(got, [(i, t, *w) for (i, t), w in zip(rows, want)])
    assert sum(w[1] for w in want) >= 150


def test_substring_dedup_sends_only_what_may_repeat(spark):
    """Windows whose minimiser stands at one place do not travel; copies, overlapping repeats included, lose nothing."""
    import random
    import zstandard
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = own(30)
    rows = [(i, " ".join(own(150) + (passage if i % 20 == 3 else []) + own(150))) for i in range(200)]
    rows += [(300, "again " * 25), (301, "one two three " * 12), (302, None), (303, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = docs.selectExpr("doc_id AS oid", "xxhash64(text) AS tkey", "text")
    volume = sum(len(t or "") for _, t in rows)
    wanted = substring_dedup.repeated_filter(texts, 20, volume)
    sent = texts.mapInArrow(substring_dedup.super_kmers(20, 4, wanted=wanted), substring_dedup._SUPERS_DDL).where("packed IS NOT NULL")
    bytes_sent = sum(len(zstandard.decompress(r.packed)) for r in sent.collect())
    assert 0 < bytes_sent < volume / 10
    got = substring_dedup.dedup_substrings(docs, window=20).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    want = removed_words(rows, 20)
    same_rows(got, [(i, t, *w) for (i, t), w in zip(rows, want)])


def test_substring_dedup_sends_only_texts_that_may_have_spans(spark):
    """Texts without a repeated window stay where they are read; null ids, texts and repeated rows as well as others get their answers."""
    import random
    import numpy as np
    rng = random.Random(8)
    own = lambda n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))
    passage = own(25)
    rows = [(i, own(40) + (" " + passage if i % 25 == 3 else "")) for i in range(400)]
    rows += [(None, rows[5][1]), (None, None), (500, None), (501, ""), (7, rows[7][1]), (502, rows[8][1]), (502, own(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substring_dedup.repeated_spans(docs, "doc_id", "text", 20)
    some = substring_dedup.span_filter(spans)
    last = substring_dedup.LAST
    keys = docs.selectExpr(f"coalesce(doc_id, {last}) AS oid", "xxhash64(text) AS tkey").selectExpr("*", "xxhash64(oid, tkey) AS hash").toPandas()
    passes = some.passes(keys["hash"].to_numpy().view(np.uint64))
    have = {(r.oid, r.tkey) for r in spans.collect()}
    assert have <= {k for k, p in zip(zip(keys["oid"], keys["tkey"]), passes) if p} and len(have) <= passes.sum() < len(have) + 5 < 30
    got = substring_dedup.dedup_substrings(docs, window=20).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    same_rows(got, [(i, t, *w) for (i, t), w in zip(rows, removed_words(rows, 20))])


def test_substring_dedup_of_nothing(no_docs):
    assert substring_dedup.dedup_substrings(no_docs).collect() == []


def test_substring_dedup_confirms_windows_on_their_words(edge_docs, edge_rows, monkeypatch):
    """With a useless fingerprint, windows are still told apart."""
    import pyarrow as pa
    import numpy as np
    from txnflow.llm import wordbytes
    texts = [t for _, t in edge_rows if t and len(spaced(t)) >= 5][:6]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)],
                            ["oid", "tkey", "text"])
    table = pa.Table.from_batches(list(substring_dedup.super_kmers(5, 1)([batch])))
    sent = table.filter(pa.compute.is_valid(table["packed"]))
    want = substring_dedup.repeated_in_bucket(5)(sent).sort_by([("oid", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
    real = wordbytes.grams
    monkeypatch.setattr(wordbytes, "grams", lambda h, n: real(h, n) * np.uint64(0) if n == 5 else real(h, n))
    got = substring_dedup.repeated_in_bucket(5)(sent).sort_by([("oid", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
    assert got.equals(want) and got.num_rows


# benchmark passages -----------------------------------------------------------------------------------------------

def contamination(docs, items, window):
    wins = {}
    for item, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in wins:
                    hit |= set(range(s, s + size))
                    found |= wins[tuple(w[s:s + size])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.fixture(scope="module")
def items(spark, edge_rows):
    long = edge_rows[5][1]
    data = [(10, long), (2, " ".join(long.split()[5:22])), (3, "one"), (4, "under the"), (5, None), (6, " !"), (7, "the the the"),
            (None, "word word"), (10, long), (11, "word " * 30), (12, "no such words at all anywhere")]
    return data, spark.createDataFrame(data, "item_id long, text string")


@pytest.mark.parametrize("window", [1, 4, 10])
def test_decontamination(edge_docs, edge_rows, items, window):
    got = decontamination.find_contamination(edge_docs, items[1], window=window).collect()
    want = contamination(edge_rows, items[0], window)
    key = lambda i: decontamination.LAST if i is None else i
    same_rows([(r.oid, r.n_words, r.n_hit, tuple(r["items"])) for r in got], [(key(i), n, h, tuple(x)) for i, n, h, x in want])
    kept = decontamination.drop_contaminated(edge_docs, items[1], window=window).select("doc_id", "text").collect()
    same_rows(kept, [row for row, w in zip(edge_rows, want) if not w[2]])


def test_decontamination_of_and_by_nothing(spark, edge_docs, edge_rows, no_docs, items):
    assert decontamination.find_contamination(no_docs, items[1]).collect() == []
    got = decontamination.find_contamination(edge_docs, items[1].where("false")).collect()
    assert len(got) == len(edge_rows) and not any(r.n_hit or r["items"] for r in got)


# licences -------------------------------------------------------------------------------------------------------

LICENCE_TEXTS = ["Under the MIT License.", "x under the mit license, under THE mit license", "Apache License, Version 2.0 and CC BY-NC 4.0",
                 "license mit the under", "under the mit", "mit license", "All rights reserved", "GNU General Public License", "",
                 None, "mit", "cc by-nc-sa", "apache license version 2" * 2, "Redistribution and use in source and binary forms"]


def test_license_scan(spark):
    docs = spark.createDataFrame([(n, t, "w", 1) for n, t in enumerate(LICENCE_TEXTS * 2)], "doc_id long, text string, labels string, n_base int")
    got = license_scan.scan_licenses(docs, TEMPLATES)
    assert set(got.columns) == {"doc_id", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 2 * len(LICENCE_TEXTS)
    for n, text in enumerate(LICENCE_TEXTS * 2):
        w, r = alnum(text), rows[n]
        places, base, every, whole = [], set(), set(), False
        for t in TEMPLATES:
            lo, hi = t.key_range
            at = [i for i in range(len(w)) if w[i:i + hi - lo] == t.words[lo:hi]]
            whole |= any(w[i:i + len(t.words)] == t.words for i in range(len(w)))
            if at:
                every.add(t.label)
                base |= {t.label} if t.base else set()
                places += at if t.base else []
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(every)))
        assert 0 <= r.score <= 1 and (r.score == 1) == whole and (not every or r.score > 0)


def test_license_scan_runs_no_python(spark, no_docs, edge_docs):
    assert license_scan.scan_licenses(no_docs, TEMPLATES).collect() == []
    got = license_scan.scan_licenses(edge_docs, TEMPLATES)
    assert got.count() == edge_docs.count()
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0])


def test_license_scan_lower_cases_ascii_alone(spark):
    docs = spark.createDataFrame([(1, "trade mar\u212a here"), (2, "TRADE MARK here"), (3, "trade mark\u0130 here")], "doc_id long, text string")
    got = license_scan.scan_licenses(docs, [license_scan.Template("tm", "trade mark here", base=True)])
    assert {r.doc_id: (r.n_words, r.labels) for r in got.collect()} == {1: (3, ""), 2: (3, "tm"), 3: (3, "")}


def test_license_scan_of_many_templates(spark):
    """500 templates of 40 to 120 words; the plan is no larger than for two, and every planted one is found in place."""
    import random
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    templates = []
    for i in range(500):
        words = [word() for _ in range(rng.randint(40, 120))]
        lo = rng.randrange(len(words) - 6)
        templates.append(license_scan.Template(f"t{i:03d}", " ".join(words), " ".join(words[lo:lo + 6]), base=i % 2 == 0))
    rows, want = [], {}
    for n in range(120):
        some = rng.sample(range(500), rng.randint(0, 2))
        parts = [" ".join(word() for _ in range(20))]
        for i in some:
            parts += [templates[i].text.upper().replace(" ", ", ", 3), " ".join(word() for _ in range(5))]
        rows.append((n, " ".join(parts)))
        want[n] = {f"t{i:03d}" for i in some}
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    got = license_scan.scan_licenses(docs, templates)
    found = got.collect()
    assert len(found) == 240
    for r in found:
        w = alnum(rows[r.doc_id][1])
        every, places = set(), []
        for t in templates:
            key = (t.key or t.text).split()
            at = [i for i in range(len(w)) if w[i] == key[0] and w[i:i + 6] == key]
            every |= {t.label} if at else set()
            places += at if t.base else []
        assert want[r.doc_id] <= every and r.labels == ",".join(sorted(every)) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert (r.score == 1.0) == bool(want[r.doc_id])
    size = lambda ts: len(license_scan.scan_licenses(docs, ts)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(templates) - size(templates[:2])) < 200


# languages ------------------------------------------------------------------------------------------------------

def test_language_id(spark, edge_docs, no_docs):
    texts = {"en": "the of and in on that with the of and", "de": "der die das und nicht ein mit der die", "xx": "zq zzq qqz zq qz"}
    learned = spark.createDataFrame([(l, t) for l, t in texts.items() for _ in range(3)] + [(None, "der " * 50), ("en", None), ("en", "")],
                                    "lang string, text string")
    profiles = language_id.learn_profiles(learned)
    assert list(profiles) == ["de", "en", "xx"] and all(len(set(p)) == len(p) <= language_id.PROFILE for p in profiles.values())
    counts = Counter()
    for _ in range(3):                                   # brute force: the profile of xx
        padded = " " + " ".join(texts["xx"].split()) + " "
        counts.update(g for n in (1, 2, 3) for g in (padded[i:i + n] for i in range(len(padded) - n + 1))
                      if " " not in g[1:-1] and g.strip() and not (len(g) == 1 and g == " "))
    code = lambda g: sum(b << 8 * i for i, b in enumerate(g.encode()))
    assert profiles["xx"] == [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))]
    got = language_id.identify_languages(edge_docs.union(edge_docs.limit(1).withColumn("text", F.lit("die der das"))), profiles)
    rows = got.select("text", "lang_pred", "score").collect()
    assert len(rows) == edge_docs.count() + 1 and got.columns.count("score") == 1
    for text, lang, score in rows:
        assert 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in text or ""))
        assert lang == "de" if text == "die der das" else True
    assert language_id.identify_languages(no_docs, profiles).collect() == []
    none = language_id.learn_profiles(no_docs.select(F.lit(None).cast("string").alias("lang"), "text"))
    assert none == {} and {r.lang_pred for r in language_id.identify_languages(edge_docs, none).collect()} == {"und"}


# byte-pair encoding -----------------------------------------------------------------------------------------------

ODD = ["a", "B", " ", "'S", "'ll", "\n", "é", "É", "ß", "Σ", "ς", "İ", "ſ", "K", "<|endoftext|>", "<|startoftext|>", "<|", "é",
       "日本", "١", "Ⅷ", "²", "\x00", "\x85", " ", "﻿", "​", "😀", ".", "!!", "ǅ", "ﬁ", "ẞ", "the", "ing", "Å", "_", "\xa0"]


def test_bpe_equals_the_library():
    import random
    rng = random.Random(3)
    texts = ["", " ", "x" * 3000, "ab" * 2000] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    library, own = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert ids == want.ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_other_files():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.WordBPE(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_documents(edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORD)
    want = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in edge_rows}
    full = bpe.encode_documents(edge_docs, WORD).collect()
    assert len(full) == len(edge_rows)
    for r in full:
        assert r.token_ids == want[r.text] and r.n_tokens == len(r.token_ids)
        assert r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    for r in bpe.encode_digests(edge_docs, WORD).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.text])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want[r.text], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(no_docs, WORD).collect() == []


# near duplicates ----------------------------------------------------------------------------------------------------

def shingle_set(text, size):
    w = spaced(ascii_lower(text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_groups(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(ids[n] for n in range(len(rows)) if group[n] == g) for g in set(group)}
    back = lambda i: None if i == float("inf") else i
    return [(back(ids[n]), len(sets[n]), back(least[group[n]]), ids[n] == least[group[n]]) for n in range(len(rows))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(edge_docs, edge_rows, size):
    got = near_dedup.near_duplicates(edge_docs, shingle=size).collect()
    same_rows(got, near_groups(edge_rows, size))


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Chains of near copies, whose ends are similar only to some members, in many small tiles."""
    import random
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(4):
        words = [rng.choice("abcdefghijkl") + str(rng.randint(0, 99)) for _ in range(60)]
        for _ in range(45):
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = "w" + str(rng.randint(0, 10 ** 6))
            rows.append((rng.randint(0, 10 ** 9), " ".join(words)))
            if rng.random() < 0.2:
                rows.append((rng.randint(0, 10 ** 9), " ".join(words).upper()))
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = near_groups(rows, 2)
    same_rows(near_dedup.near_duplicates(docs, shingle=2).collect(), want)
    assert 4 < len({w[2] for w in want}) < len(rows) // 2       # groups neither fell apart nor ran together
    kept = near_dedup.drop_near_duplicates(docs, shingle=2).collect()
    assert {r.doc_id for r in kept} == {w[0] for w in want if w[3]} and len(kept) == len({w[2] for w in want})


def test_near_duplicates_when_scans_are_packed_anew(spark, monkeypatch):
    """Cores come or go between two jobs: the same files are one scan partition first, one each later."""
    rows = [(i, " ".join(f"w{i % 5}x{j}" for j in range(60)) + f" end{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    real, conf = near_dedup.written, {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": "1g",
                                      "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}

    def written(df, name):
        out = real(df, name)
        if name == "leaders":
            spark.conf.set("spark.sql.files.minPartitionNum", "1000")
        return out

    monkeypatch.setattr(near_dedup, "written", written)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_dedup.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    same_rows(got, near_groups(rows, 5))


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    """A near copy among rows of a null or repeated id takes none of the unrelated rows of that id with it."""
    text = lambda name: " ".join(f"{name}{j}" for j in range(60))
    rows = [(5, text("a")), (None, text("a") + " end"), (None, text("b")), (None, text("c")), (None, text("c")),
            (3, text("d")), (7, text("d") + " end"), (7, text("e")), (8, text("e") + " end"), (7, text("f")), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = near_groups(rows, 5)
    same_rows(near_dedup.near_duplicates(docs).collect(), want)
    kept = [r for r, w in zip(rows, want) if w[3]]
    assert (None, text("b")) in kept and (7, text("d") + " end") not in kept and (7, text("e")) in kept
    same_rows(near_dedup.drop_near_duplicates(docs).collect(), kept)


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []
    assert near_dedup.drop_near_duplicates(no_docs).collect() == []


# quality --------------------------------------------------------------------------------------------------------------

def test_quality(spark, edge_docs, no_docs):
    import random
    rng = random.Random(9)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["alpha", "beta"]) + rng.choice(["!!!", "$$$"]) for _ in range(30)) for _ in range(150)]
    rows = list(enumerate(good + bad))
    docs = spark.createDataFrame(rows + [(None, "alpha"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in rows] + [(None, 0), (900, 0), (901, 1), (5, None)], "doc_id long, quality int")
    weights = quality.learn(docs, labels, F.col("doc_id") % 3 != 0)
    scored = quality.score_quality(docs.withColumn("score", F.lit("x")), weights).select("doc_id", "score").collect()
    assert len(scored) == 302 and all(0 <= r.score <= 1 for r in scored)
    held = [(r.doc_id < 150, r.score) for r in scored if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 3 == 0]
    assert sum((s >= 0.5) == y for y, s in held) >= 0.97 * len(held)
    edge = quality.score_quality(edge_docs, weights)
    assert edge.count() == edge_docs.count()
    empty = {r.score for r in edge.collect() if not spaced(r.text)}
    assert len(empty) == 1
    assert quality.score_quality(no_docs, weights).collect() == []
    untaught = quality.learn(docs, labels.where("false"), F.lit(True))
    assert not untaught.any() and {r.score for r in quality.score_quality(docs, untaught).collect()} == {0.5}


def test_quality_words():
    import pyarrow as pa
    texts = ["The%%% a-b  É!", None, "", " ", "x", "!!x"]
    words = quality.runs(pa.array(texts))
    found = [[words.data[words.start[k]:words.end[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
    assert found == [["The", "%%%", "a", "-", "b", "É", "!"], [], [], [], ["x"], ["!!", "x"]]


def test_held_out_rule(spark):
    from txnflow.llm.q10_quality import held_out
    rows = spark.createDataFrame([(i,) for i in (0, 1, 17, -4, 10 ** 12, None)], "doc_id long").select("doc_id", held_out()).collect()
    assert all(h == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, h in rows)
