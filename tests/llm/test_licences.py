import random
import re

from bandlake.llm import licenses


def brute_force(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = []
    for label, is_base, phrase, allowed, lo, hi in licenses.templates():
        for start in range(len(w)):
            same = [start + k < len(w) and w[start + k] == x for k, x in enumerate(phrase)]
            if all(same[lo : hi + 1]) and len(same) - sum(same) <= allowed:
                hits.append((label, is_base, start, sum(same) / len(same)))
    return len(w), sorted(hits)


def test_hits_by_brute_force(spark):
    rng, texts = random.Random(2), [None, "", "...", "mit", "Under the MIT license" * 3, "word " * 30_000 + "all rights reserved"]
    phrases = [t[2] for t in licenses.templates()]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = list(rng.choice(phrases))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(("copy", "software", "x"))
            parts.append(rng.choice((" ", "-", ", ")).join(words))
        texts.append(" some words. ".join(parts))
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(4, texts[4], "clash", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, w string, proposed int")
    got = [(r.doc_id, r.n_words, [(h.label, h.is_base, h.start, h.similarity) for h in r.hits]) for r in licenses.licence_hits(frame).collect()]
    assert sorted(got) == sorted((i, *brute_force(t)) for i, t, _, _ in rows)
    assert len({h[0] for _, _, hits in got for h in hits}) > 10


def test_places_of_two_rare_words_must_agree(spark):
    index = licenses.rare_words(licenses.templates(), {"the": 9, "under": 5, "license": 2, "mit": 1})
    assert (0, 2, 0) in index["mit"] and (0, 3, 1) in index["license"]
    frame = spark.createDataFrame([(1, "mit license"), (2, "the license under mit"), (3, "x under the mit license")], "doc_id long, text string")
    assert {r.doc_id: [(h.label, h.start) for h in r.hits if h.is_base] for r in licenses.licence_hits(frame).collect()} == {1: [], 2: [], 3: [("mit", 1)]}
