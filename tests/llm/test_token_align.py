"""Alignment against whole-text encoding and a plain two-pointer walk."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from llm_helpers import DOCS, edge_rows, local_frame
from sentencepiece import SentencePieceProcessor
from slicegauge.llm import token_align
from slicegauge.llm.queries import QUERIES
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    b = SentencePieceProcessor(model_file=B)

    def of(text):
        if not text:
            return None
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        bytes_x = [bytes(back[c] for c in names[i]) for i in x]
        bytes_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + text).encode()
        return ((x, bytes_x), (y, bytes_y)) if b"".join(bytes_x) == raw == b"".join(bytes_y) else None
    return of


def brute(rows, tokens):
    found, counts = [], Counter()
    for doc, text in rows:
        t = tokens(text)
        links, groups = [], []
        if t:
            (x, bx), (y, by) = t
            spans = []
            for side in (bx, by):
                at, out = 0, []
                for s in side:
                    out.append((at, at + len(s)))
                    at += len(s)
                spans.append(out)
            ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            i = j = 0
            for e in ends:
                k, m = i, j
                while i < len(x) and spans[0][i][1] <= e:
                    i += 1
                while j < len(y) and spans[1][j][1] <= e:
                    j += 1
                groups.append(",".join(map(str, x[k:i])) + "|" + ",".join(map(str, y[m:j])))
                links += [(x[p], y[q]) for p in range(k, i) for q in range(m, j)
                          if spans[0][p][0] < spans[1][q][1] and spans[1][q][0] < spans[0][p][1]]
        counts.update(set(links))
        found.append((doc, len(t[0][0]) if t else 0, len(t[1][0]) if t else 0, groups, links))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return sorted([(d, na, nb, len(g), len(ls), sum(counts[x] == top[x[0]] for x in ls), sum(counts[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in found], key=str)


def result(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_against_brute_force(spark, data, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert result(QUERIES["op12_lockstep_align"](spark, data)) == brute(rows, tokens)


HARD = ["a", " a", "  a  b ", "a\nb", "\n\n a\t\tb\r\n", "x▁y", "▁", "<s> <|endoftext|> <unk></s><0x41>", "don't 've\x00 1234567", "é́ ﬁ ① 漢字\U0001F600",
        "a\xa0b c", "    ", "\n", "a" * 3000, "ñ" * 50 + " " * 40 + "z", "日本語" * 20, "​x﻿"]


@pytest.mark.parametrize("hot", [0, 5, 100_000])
def test_edges_and_any_number_of_hot_pairs(spark, nothing, tokens, hot):
    rows = [(i, t, "en", "s", 0, "n", 1, 2, 3, "s") for i, t in enumerate(HARD * 2)] + edge_rows()
    got = token_align.align(local_frame(spark, rows, DOCS).repartition(3), A, B, hot)
    assert result(got) == brute([r[:2] for r in rows], tokens)
    assert token_align.align(nothing, A, B, hot).collect() == []


def test_encoders_agree_on_long_runs(tokens):
    texts = ["ab" * 5_000, " " * 3_000 + "x", "\n" * 1_000, "word " * 3_000, "é" * 4_100 + " 12", "1" * 4_500]
    one = token_align.Bytes(A, B)
    assert one.encode(texts) == [(t[0][0], t[1][0]) for t in map(tokens, texts)]
    assert token_align.groups_of("", A, B) == [] and len(token_align.groups_of("hello there", A, B)) >= 2
