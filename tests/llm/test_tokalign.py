"""Alignment of tokenizers against plain loops over tokens and bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultlens.llm import tokalign
from faultlens.llm.tables import table

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "<|endoftext|> a <s> </s> <unk> <0x41>", "a▁b", "a\0b", "  x  y ", "\xa0　 x y\n\n\n z", "x" * 5000,
    "﻿abc", "ﬁ Å é", "don't I'LL 'ſ", "中文 русский 😀👩‍👩‍👧", " " * 3000, "same text here", "same text here",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(tokalign.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokalign.B_PATH)
    alphabet = tokalign._byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in p) for p, i in a.get_vocab().items() if p != "<|endoftext|>"}

    def tokens(text):
        if not text:
            return [], []
        x = [(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (x, y) if b"".join(p for _, p in x) == b"".join(p for _, p in y) == whole else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def expected(texts, tokens):
    """texts: key → text; key → the row of the digest, and the corpus counts of pairs."""
    rows, counts = {}, Counter()
    for key, text in texts.items():
        a, b = map(spans, tokens(text))
        links = [(x[0], y[0]) for y in b for x in a if x[2] == y[2]] if len(a) * len(b) < 10**5 else linked_by_end(a, b)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, start = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(t[0]) for t in side if start < t[2] <= cut) for side in (a, b)) if len(a) < 400 else None)
            start = cut
        line = ";".join(parts) if None not in parts else groups_in_one_pass(a, b, set(cuts))
        rows[key] = [len(a), len(b), len(cuts), links, hashlib.sha256(line.encode()).hexdigest() if a else ""]
        counts.update(links)
    return rows, counts


def linked_by_end(a, b):
    ends = {x[2]: x[0] for x in a}
    return [(ends[y[2]], y[0]) for y in b if y[2] in ends]


def groups_in_one_pass(a, b, cuts):
    out, i, j = [], 0, 0
    for cut in sorted(cuts):
        x, y = [], []
        while i < len(a) and a[i][2] <= cut:
            x.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= cut:
            y.append(str(b[j][0]))
            j += 1
        out.append(",".join(x) + "|" + ",".join(y))
    return ";".join(out)


def test_digest_equals_plain_loops(spark, plain):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    texts |= {10**6 + i: t for i, t in enumerate(ODD)}
    rows, counts = expected(texts, plain)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = {
        k: (n_a, n_b, n_groups, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for k, (n_a, n_b, n_groups, links, digest) in rows.items()
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in tokalign.alignment_digest(docs).collect()}
    assert got == want
    assert {(r.a_id, r.b_id): (r.n_links, r.best) for r in tokalign.pair_table(docs).collect()} == {
        x: (n, n == highest[x[1]]) for x, n in counts.items()
    }


def test_both_ways_to_encode_agree(plain):
    pair = tokalign.read_files().load()
    assert pair._ranked is not None
    for text in ODD:
        found, (a, b) = pair.encode((text or "").encode()), plain(text)
        assert (found is None) == (not a)
        if found:
            assert found[0].tolist() == [i for i, _ in a] and found[1].tolist() == [i for i, _ in b]


def test_products_equal_dense_ones():
    rng = random.Random(2)
    for _ in range(30):
        n, m, k = (rng.randint(1, 9) for _ in range(3))
        dense = [np.array([[rng.random() < 0.4 for _ in range(c)] for _ in range(r)], int) for r, c in ((n, m), (k, m))]
        left, right = (
            tokalign.Csr(np.concatenate([[0], np.cumsum(d.sum(axis=1))]), np.nonzero(d)[1], m) for d in dense
        )
        out = np.zeros((n, k), int)
        rows, columns, values = tokalign.whole_product(left, tokalign.transpose(right))
        out[rows, columns] = values
        assert (out == dense[0] @ dense[1].T).all() and len(rows) == (out > 0).sum()


@pytest.mark.parametrize("entries", [7, tokalign.PRODUCT_ENTRIES])
def test_links_of_all_kinds(spark, plain, monkeypatch, entries):
    monkeypatch.setattr(tokalign, "PRODUCT_ENTRIES", entries)
    texts = {i: t for i, t in enumerate([*ODD[:9], "Überraschung: unbelievably long compounds, 12345 numbers!"])}
    want = {kind: Counter() for kind in ("overlap", "group", "end")}
    for key, text in texts.items():
        a, b = map(spans, plain(text))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        group = lambda t: sum(c < t[2] for c in cuts)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                shared = min(x[2], y[2]) - max(x[1], y[1])
                if shared > 0:
                    want["overlap"][key, i, j, x[0], y[0], shared] += 1
                if group(x) == group(y):
                    want["group"][key, i, j, x[0], y[0], 1] += 1
                if x[2] == y[2]:
                    want["end"][key, i, j, x[0], y[0], 1] += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    for kind in want:
        assert Counter(tuple(r) for r in tokalign.token_links(docs, kind).collect()) == want[kind]
    with pytest.raises(ValueError):
        tokalign.token_links(docs, "other")


def test_pairs_are_bounded_by_the_vocabularies():
    pair = tokalign.read_files().load()
    assert len(pair.pairs) <= pair.a_length.sum() * 2 + pair.b_length.sum() * 2 and len(pair.pairs) < 400_000
    for code in random.Random(1).sample(pair.pairs.tolist(), 500):
        a, b = pair.a_bytes[code // len(pair.b_bytes)], pair.b_bytes[code % len(pair.b_bytes)]
        assert a.endswith(b) or b.endswith(a)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = tokalign.alignment_digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {tuple(r)[1:] for r in rows if r.doc_id in (4, 5)} == {(0, 0, 0, 0, 0, 0, "")}
    assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    assert all(r.n_links == r.n_groups and r.n_best <= r.n_links <= min(r.n_a, r.n_b) for r in rows)
    broken = odd_docs.limit(1).select("doc_id", F.expr("CAST(X'61FF62' AS STRING)").alias("text"))
    assert tuple(tokalign.alignment_digest(broken).first())[1:] == (0, 0, 0, 0, 0, 0, "")
    assert tokalign.alignment_digest(no_docs).count() == tokalign.pair_table(no_docs).count() == tokalign.token_links(no_docs).count() == 0


def test_links_are_counted_in_small_parts():
    lists = [[1] * 90_000, [], [2] * 100_000, [3] * 200_000, [4] * (2 * tokalign.SLICE_LINKS), [], [5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "links"])
    parts = list(tokalign._by_links([batch.slice(0, 0), batch]))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist()
    assert all(len(p.column("links").flatten()) <= tokalign.SLICE_LINKS or p.num_rows == 1 for p in parts) and len(parts) >= 3
