from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from provena.llm import token_alignment as ta

SF = "/root/testdata/sf0.01"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _bytes_a(token):
    letters = {}
    n = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            letters[chr(b)] = b
        else:
            letters[chr(256 + n)] = b
            n += 1
    return bytes(letters[c] for c in token)


def _bytes_b(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def _tokens(text):
    """Whole texts, by the libraries themselves: [(id, start, end)] of both; None without tokens."""
    if not text:
        return None
    found = []
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: _bytes_a(A.id_to_token(i))), (B.encode(text), lambda i: _bytes_b(B.id_to_piece(i)))):
        at, own, joined = 0, [], b""
        for i in ids:
            own.append((i, at, at + len(spell(i))))
            at, joined = own[-1][2], joined + spell(i)
        if joined != (" " + text).encode():
            return None
        found.append(own)
    return found


def _plain(rows):
    """The contract by brute force: every A token against every near B token."""
    links, groups = [], []
    for _, text in rows:
        tokens = _tokens(text)
        if tokens is None:
            links.append([])
            groups.append([])
            continue
        a, b = tokens
        own, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            j = low
            while j < len(b) and b[j][1] < e:
                own.append((i, b[j][0]))
                j += 1
        links.append(own)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        by = defaultdict(lambda: ([], []))
        for side in (0, 1):
            k = 0
            for i, _, e in (a, b)[side]:
                by[k][side].append(str(i))
                k += e == ends[k]
        groups.append([by[k] for k in range(len(ends))])
    counts = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), own, gs in zip(rows, links, groups, strict=True):
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


def _rows():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "don't", "émigré", "数据", "😀", "\t", "12345", "...", "<|endoftext|>", "<s>", "<0x41>", "'ll", "\x00", " ", " ", "\x1c", "ſ", "́", "Ω≈ç"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(300)]
    hard = ["▁", "a ▁b", "fine words ▁", "x" * 5000, " " * 3000, "\n" * 2000, "a b " * 3000, "1" * 999, "中" * 2000, "á b", "word", "word", " lead", "trail ", "﻿bom", "​zero width"]
    return rows + [(1000 + k, t) for k, t in enumerate(hard)] + [(None, None), (None, "null id"), (7, ""), (7, "same id")]


def _scored(df, **more):
    return sorted((tuple(r) for r in ta.score(df, **more).collect()), key=str)


@pytest.mark.parametrize("hot", [ta.HOT, 40])
def test_against_brute_force(spark, hot):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _scored(df, hot=hot) == sorted(_plain(rows), key=str)


def test_documents_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert _scored(df) == sorted(_plain([tuple(r) for r in df.collect()]), key=str)


def test_slices_and_a_short_memory_change_nothing(monkeypatch):
    files = ta._bytes(ta.FILE_A), ta._bytes(ta.FILE_B)
    texts = [t for _, t in _rows() if t] + ["many words of one text " * 500, "▁ " * 40]
    whole = ta.Aligner(*files).texts(texts)
    monkeypatch.setattr(ta, "SLICE", 7)
    monkeypatch.setattr(ta, "ROOM", 3)
    for x, y in zip(whole, ta.Aligner(*files).texts(texts), strict=True):
        assert (x is None) == (y is None)
        if x:
            assert x[0].tolist() == y[0].tolist() and x[1] == y[1] and x[2].tolist() == y[2].tolist() and x[3].tolist() == y[3].tolist()


def test_aligned_columns(spark):
    df = spark.createDataFrame([(1, "tokenizers differ", "x", 3), (2, None, "y", 4)], "doc_id long, text string, groups string, aligned int")
    first, second = ta.align(df).collect()
    assert (first["aligned"], second["aligned"]) == (3, 4) and second["groups"] == "" and second["links"] == [] and second["n_a"] == 0
    assert "|" in first["groups"] and sum(x["times"] for x in first["links"]) == first["n_links"] and first["groups"].count(";") + 1 == first["n_groups"]
    assert ta.align(df.limit(0)).count() == 0 and ta.score(df.limit(0)).count() == 0


def test_threshold_of_frequent_pairs(spark):
    pairs = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 2, 3, 4, 9, 70])], "pair long, n long")
    assert ta.frequent(pairs, 7) == (1, 7) and ta.frequent(pairs, 6) == (2, 5) and ta.frequent(pairs, 2) == (8, 2) and ta.frequent(pairs, 0) == (128, 0)
