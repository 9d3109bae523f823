"""Cross-tokenizer alignment against a plain form that compares all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from txnflow.llm import alignment
from txnflow.llm.q11_alignment import op11

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    letters = {}                                       # byte-level letters, by the rule of such files
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters[chr(b)] = b
        else:
            letters[chr(spare)] = b
            spare += 1
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        a = library.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        bytes_b = []
        for i in b:
            piece = model.id_to_piece(i)
            bytes_b.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        want = (" " + text).encode()
        return (a, b, bytes_a, bytes_b) if text and b"".join(bytes_a) == b"".join(bytes_b) == want else ([], [], [], [])

    return tokens


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(texts):
    tokens, docs, counts = plain_tokens(), [], Counter()
    for text in texts:
        a, b, x, y = tokens(text or "")
        x, y = spans(x), spans(y)
        links = [(i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s < f and t < e] if len(x) < 3000 else _near(x, y)
        common = sorted({e for _, e in x} & {e for _, e in y})
        groups, lo = [], 0
        for end in common:
            groups.append(",".join(str(a[i]) for i, (s, e) in enumerate(x) if lo <= s and e <= end) + "|"
                          + ",".join(str(b[j]) for j, (s, e) in enumerate(y) if lo <= s and e <= end))
            lo = end
        counts.update((a[i], b[j]) for i, j in links)
        docs.append((len(a), len(b), len(common), links, ";".join(groups), a, b))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [(n_a, n_b, n, len(links), g, sum(counts[a[i], b[j]] == highest[b[j]] for i, j in links), sum(counts[a[i], b[j]] for i, j in links))
            for n_a, n_b, n, links, g, a, b in docs]


def _near(x, y):
    out, j = [], 0
    for i, (s, e) in enumerate(x):
        while y[j][1] <= s:
            j += 1
        k = j
        while k < len(y) and y[k][0] < e:
            out.append((i, k))
            k += 1
    return out


TEXTS = ["a", "<|endoftext|> and <s>b</s>", "a▁b", "日本語 text é́\U0001f600!!", "  two  spaces \n\t x", "\x00\x7f", "aaaa" * 50,
         "퟿�", "don't won't 12345 67", " ", "\n"]


@pytest.mark.parametrize("piece", [4 << 20, 300])
def test_alignment(spark, edge_docs, edge_rows, monkeypatch, piece):
    monkeypatch.setattr(alignment, "PIECE_BYTES", piece)
    rows = [(i, t) for i, t in edge_rows if i != 16] + list(enumerate(TEXTS, 100))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, groups string, n_b int").repartition(3)
    got = alignment.align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    want = [(i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]))]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(w[1] == 0 and t for (i, t), w in zip(rows, want)) and sum(w[1] > 0 for w in want) > 20
    short = alignment.align_tokenizers(docs, A, B, digests=True).collect()
    assert Counter((r.doc_id, r.groups) for r in short) == Counter((w[0], hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "") for w in want)


def test_alignment_of_long_texts(spark, edge_rows):
    """A text of 30,000 words, one of white space alone, and one word of many characters."""
    texts = [dict((i, t) for i, t in edge_rows if i is not None)[16], " " * 50_000 + "x", "y" * 30_000, "é" * 9_000]
    tokens = plain_tokens()
    for text, row in zip(texts, alignment.align_tokenizers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B)
                         .orderBy("doc_id").collect()):
        a, b, x, y = tokens(text)
        assert len(a) and (row.n_a, row.n_b, row.n_links) == (len(a), len(b), len(_near(spans(x), spans(y))))
        assert row.n_groups == len({e for _, e in spans(x)} & {e for _, e in spans(y)}) == row.groups.count("|")


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.align_tokenizers(no_docs, A, B).collect() == []
    empty = alignment.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert [tuple(r)[1:] for r in empty] == [(0, 0, 0, 0, "", 0, 0)] * 2


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = np.unique(rng.integers(0, 10_000, rng.integers(1, 2000)))
        needles = np.sort(rng.integers(0, ends[-1] + 1, rng.integers(0, 500)))
        assert (alignment.gallop(needles, ends) == np.searchsorted(ends, needles)).all()


def test_the_fast_encoder_gives_the_ids_of_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = [" " + "".join(rng.choice(" \n\t'sabAB1é日!ſK٣. ​́<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" %cb %c1%c %c%c's  %c\n" % ((chr(c),) * 6) for c in range(1, 0x3000, 7)] + [" " * 19_999, " " * 60_000 + "a"]
    assert alignment.load(A).encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_plain_form(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(docs, plain_of_all([r.text for r in docs]))]
    got = op11(spark, sf)
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum").collect())) == \
        Counter((w[0], *w[1:5], *w[6:]) for w in want)
    assert dict(got.select("doc_id", "groups_sha256").collect()) == {w[0]: hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "" for w in want}


def plain_of_all(texts):
    """As ``plain``, with links and groups found by walking both lists."""
    tokens, docs, counts = plain_tokens(), [], Counter()
    for text in texts:
        a, b, x, y = tokens(text or "")
        x, y = spans(x), spans(y)
        links = _near(x, y) if x else []
        common = {e for _, e in x} & {e for _, e in y}
        groups = [[[], []]]
        at = {e: n for n, e in enumerate(sorted(common))}
        groups = [[[], []] for _ in at]
        for side, ids, ends in ((0, a, x), (1, b, y)):
            n = 0
            for i, (_, e) in zip(ids, ends):
                groups[n][side].append(str(i))
                n += e in common
        counts.update((a[i], b[j]) for i, j in links)
        docs.append((len(a), len(b), len(common), links, ";".join("|".join(map(",".join, g)) for g in groups), a, b))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [(n_a, n_b, n, len(links), g, sum(counts[a[i], b[j]] == highest[b[j]] for i, j in links), sum(counts[a[i], b[j]] for i, j in links))
            for n_a, n_b, n, links, g, a, b in docs]
