"""Token alignment against whole texts encoded by both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests_llm_odd import ODD
from tidemark.llm import token_alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b, letter = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), letters()

    def tokens(text):
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(letter[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (left, right) if text and all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(texts):
        found, count = [], Counter()
        for t in texts:
            left, right = map(spans, tokens(t or ""))
            links = [(i, j) for i, s, e in left for j, u, v in right if s < v and u < e] if len(left) < 2000 else None
            cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
            groups = [",".join(str(i) for i, _, e in left if low < e <= c) + "|" + ",".join(str(i) for i, _, e in right if low < e <= c) for low, c in zip([0, *cuts], cuts)]
            found.append((len(left), len(right), len(groups), links, ";".join(groups)))
            count.update(links)
        best = Counter()
        for (_, j), n in count.items():
            best[j] = max(best[j], n)
        return [(x, y, g, len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(told.encode()).hexdigest() if x else "") for x, y, g, k, told in found]

    return run


def rows():
    rng = random.Random(9)
    odd = ["日本語 のテキスト", "a▁b c", "▁", "x ▁y", "é  x 　 y", "😀😁 👩‍👩‍👧", "<|endoftext|> </s> <unk> <0x0A>", "  two  spaces   end ", "\n\n a\r\nb\t c\x0b d\x1c e", "a\x00b \x7f \x85 z"]
    odd += ["it's 3.14159 foo_bar==baz", "ﬁ①½ Ⅷ", "العربية שלום ไทย हिन्दी", " lead", "\ttab", "=" * 40, " nb   sp", "a ​ b﻿", "  x ᠎ y"]
    pool = "abc XYZ  éß日😀\n\t'012.,-_▁  ﬁ"
    odd += ["".join(rng.choice(pool.replace("▁", "") if k % 4 else pool) for _ in range(rng.randrange(60))) for k in range(150)]
    words = ["the", "cat", "Straße", "naïve", "co-op", "l'été", "2024", "日本", "(see)", "e.g."]
    return [*ODD, *odd, *(" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(40))]


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 25, 1 << 14, 1 << 20), (20, 300, 7, 30)])
def test_alignment(make, brute, monkeypatch, limits):
    for name, value in zip(("BLOCK_CHUNKS", "BLOCK_BYTES", "BATCH", "PIECE"), limits):
        monkeypatch.setattr(token_alignment, name, value)
    texts = rows()
    texts += texts[30:33]
    table = make(list(enumerate(texts))[:-3] + [(None, texts[-3]), (40, texts[-2]), (41, texts[-1])])
    got = token_alignment.align(table.withColumnRenamed("n_chars", "block"), *PATHS).collect()
    want = brute(texts)
    ids = [*range(len(texts) - 3), None, 40, 41]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *w)) for i, w in zip(ids, want))
    assert {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"} < set(got[0].asDict())


def test_empty(make):
    assert token_alignment.align(make([]), *PATHS).collect() == []
    assert [tuple(r)[1:] for r in token_alignment.align(make([None, "", "▁"]), *PATHS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_cuts_need_the_spans():
    """Where the coarse cuts are sure, the decoded bytes agree with them."""
    aligner = token_alignment.Aligner.at(*PATHS)
    for text in (" 日本語😀x", " é", " Straße  \u2028①", "   "):
        for (ids, ends), table in ((aligner.ends_a(text), aligner.sizes_a), (aligner.ends_b(text), aligner.sizes_b)):
            assert ends.tolist() == table[ids].cumsum().tolist() and ends[-1] == len(text.encode())
