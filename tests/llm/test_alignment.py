"""Alignment of two tokenizers against a plain version that reads the same vocabulary files by other means."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bandlake.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    own = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    letter = {chr(b): b for b in own}
    letter |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}

    def tokens(text):
        """[(id, bytes)] of both, or None."""
        if not text:
            return None
        left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        want = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == want == b"".join(t for _, t in right) else None

    return tokens


def groups_of(left, right):
    out, a, b, at_a, at_b = [], [], [], 0, 0
    left, right = list(left), list(right)
    while left or right:
        if at_a <= at_b:
            i, t = left.pop(0)
            a.append(i)
            at_a += len(t)
        else:
            i, t = right.pop(0)
            b.append(i)
            at_b += len(t)
        if at_a == at_b:
            out.append((a, b))
            a, b = [], []
    return out


def measured(plain, rows):
    groups = [groups_of(*t) if (t := plain(text)) else [] for _, text in rows]
    links = [Counter((a, b) for left, right in g for a in left for b in right) for g in groups]
    counts = Counter(pair for own in links for pair in own)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = Counter()
    for (doc_id, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n_best = sum(n for (a, b), n in own.items() if counts[a, b] == best[a])
        out[doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), n_best, sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


def corpus():
    rng = random.Random(2)
    pool = ["the", " ", "  ", "\n", "\t", "'s", "12345", "é", "ß", "漢字", "##", " ", "<|endoftext|>", "</s>", "\U0001f600", "internationalisation", "\r\n", "aaaaaaaaaaaa", "Zq", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    texts += ["", None, " ", "▁ no", "a▁b", "<unk>", "<0x41>", "\x00nul", "word " * 5000, "x" * 20000, "same text here"]
    rows = list(enumerate(texts)) + [(1000 + k, "same text here") for k in range(40)]
    return [*rows, (3, texts[3]), (None, texts[4]), (5, "another text of that id"), (5, None)]


SCHEMA = "doc_id long, text string, n_a int, text_key string, `count` int"


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
def test_measures_equal_the_plain_version(spark, plain, limit):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], SCHEMA)
    got = Counter(tuple(r) for r in alignment.alignment_measures(frame, limit=limit).select("doc_id", *alignment.MEASURES).collect())
    assert got == measured(plain, rows)


def packed(found):
    columns = [[b"k"] * len(found), [1] * len(found), *[[len(f[k]) for f in found] for k in (0, 1)], *[[f[k].astype("<u4").tobytes() for f in found] for k in (0, 1)], *[[np.packbits(f[k]).tobytes() for f in found] for k in (2, 3)]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_key", "n_docs", "n_a", "n_b", "a_ids", "b_ids", "a_cuts", "b_cuts"])


def test_unpacked_groups_are_the_plain_ones(spark, plain):
    rows = corpus()
    want = {}
    for _, text in rows:
        if text:
            n, g = want.get(text, (0, groups_of(*t) if (t := plain(text)) else []))
            want[text] = n + 1, g
    want = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    found = alignment.unpacked(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(found) == len(want)
    for r in found:
        n, g = want[bytes(r.text_key)]
        assert r.n_docs == n and (r.a_sizes, r.b_sizes) == ([len(a) for a, _ in g], [len(b) for _, b in g])
        assert (r.a_ids, r.b_ids) == ([i for a, _ in g for i in a], [i for _, b in g for i in b])


def test_large_groups_go_by_their_distinct_ids(spark, plain, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["漢字" * 30, "aab" * 50, "éàü" * 40, "ab 12"])]
    engines = alignment.engines(alignment.load())
    monkeypatch.setattr(alignment, "LINKS", 2)
    for _, text in rows:
        row, pair, times = alignment._Part(packed(engines.align([text]))).distinct()
        want = Counter((a << 24 | b) for left, right in groups_of(*plain(text)) for a in left for b in right)
        assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == want


def test_same_ids_as_the_vocabulary_files_own_library(plain):
    engines, rng = alignment.engines(alignment.load()), random.Random(9)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 12)))
        both = plain(text)
        a, b, *_ = engines.align([text])[0]
        assert (a.tolist(), b.tolist()) == (([i for i, _ in both[0]], [i for i, _ in both[1]]) if both else ([], []))


def test_an_empty_table_gives_no_rows(spark):
    assert alignment.alignment_measures(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in alignment.alignment_measures(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
