"""Operators without SQL against plain versions written from their docstrings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bandlake.llm import decontaminate, langid, linededup, mixing, quality
from bandlake.llm.samples import labelled_sample

WORDS = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain_quality(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return [0.0] * len(quality.FEATURES)
    data, n = text.encode(), len(words)
    size = len(data)
    count = lambda chars: sum(data.count(bytes([c])) for c in chars)
    junk, marks, digits = count(b"#$%&*|<>=~^{}[]\\_@+"), count(b"!?;:"), count(range(48, 58))
    capitals, letters = count(range(65, 91)), count([*range(65, 91), *range(97, 123), *range(128, 256)])
    pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    mean = size / n
    return [
        min(1, 8 * junk / size), min(1, 8 * marks / size), capitals / max(1, letters), min(1, 5 * digits / size), max(0, min(1, (6 - mean) / 4)), max(0, min(1, (mean - 6) / 8)),
        1 - len(set(words)) / n, 1 - pairs, min(1, (junk + marks) / n), min(1, 2 * (1 - pairs) + 4 * (junk + marks) / size + 2 * (capitals > letters / 4)), 1 / (1 + math.log1p(n)),
    ]


def test_quality_features_and_order(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "one", "A A a", "é!" * 30, " ".join(WORDS) * 4000]
    texts += [" ".join(rng.choice([*WORDS, "x1!", "#$%", "WOW", "42", "漢字"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    got = quality.features(pa.array(texts))
    assert np.allclose(got, [plain_quality(t) for t in texts])
    rows = [(i, " ".join(rng.choice(WORDS if i % 2 else [*WORDS, "##", "!!"]) for _ in range(30)), i % 2) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(labelled_sample(frame, frame, "quality", max_rows=1000))
    scored = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    for i, text, _ in rows:
        strength = sum(w * f for w, f in zip(model.weights, plain_quality(text), strict=True))
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * strength + model.offset))))
    pairs = [scored[a] > scored[b] for a, _, x in rows for b, _, y in rows if x > y]
    assert sum(pairs) > 0.95 * len(pairs)
    nothing = frame.where("false")
    assert quality.fit(labelled_sample(nothing, nothing, "quality", max_rows=10)).weights == (0.0,) * len(quality.FEATURES)


def least_edits(item, text):
    """Least edit distance of ``item`` to any part of ``text``, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdef") for _ in range(n))
    items = [(k, text(rng.randrange(6, 14))) for k in range(8)] + [(20, text(3)), (21, text(8)), (20, text(9))]
    items += [(30, items[0][1]), (31, "  " + items[1][1].upper())]  # repeated ones
    rows = []
    for k in range(60):
        held = rng.choice(items)[1]
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(held))
            held = held[:at] + rng.choice(["", "q", held[at] + "z"]) + held[at + 1 :]
        rows.append((k, f"{text(rng.randrange(6))} {held}{rng.choice((' ', chr(10), ''))}{text(rng.randrange(6))}"))
    rows += [(3, rows[3][1]), (None, items[0][1]), (70, text(4000)), (71, None), (72, "")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.benchmark_hits(frame, bench).collect())
    want = Counter()
    for doc, body in rows:
        if doc == 70 or not body:
            continue
        for item, piece in items:
            short, long = decontaminate.normalise(piece), decontaminate.normalise(body)
            found = least_edits(short, long)
            if found <= int(0.08 * len(short)):
                want[doc, item, found] += 1
    assert got == want and len(want) > 30


def test_language_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = {"en": "the and with river house walking".split(), "de": "der und mit fluss haus gehen".split(), "fr": "le et avec rivière maison marcher".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(20)) + " 12!", lang) for i in range(120) for lang in [("en", "de", "fr")[i % 3]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    counts = {lang: Counter(w for _, t, x in rows if x == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in vocabulary}
    known = sorted(set().union(*counts.values()))
    for word in known:
        want = [math.log((counts[x][word] + 0.5) / (sum(counts[x].values()) + 0.5 * len(known))) for x in sorted(vocabulary)]
        assert model.words[word] == pytest.approx(want)

    def plain(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        sums, n = [0.0] * 3, 0
        for w in words:
            found = model.words.get(w)
            for size in (4, 3, 2, 1) if found is None else ():
                grams = [g for g in (f" {w} "[k : k + size] for k in range(len(w) + 3 - size)) if g in model.grams[model.orders.index(size)]]
                if grams:
                    found = [sum(model.grams[model.orders.index(size)][g][j] for g in grams) / len(grams) for j in range(3)]
                    break
            if found is not None:
                n += 1
                sums = [s + f for s, f in zip(sums, found, strict=True)]
        if not n:
            return model.languages[0], 1 / 3
        scaled = [s / math.sqrt(n) for s in sums]
        best = max(range(3), key=lambda j: (sums[j], -j))
        return model.languages[best], 1 / sum(math.exp(max(-60.0, s - scaled[best])) for s in scaled)

    tests = [None, "", "12 !?", "THE River", "unknownish gehend", "qqq", "漢字", "marcher " * 20_000, "und the le", "walked hauses"]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(tests)] + [(3, tests[3])], "doc_id long, text string"), model).collect()
    assert len(got) == len(tests) + 1
    for r in got:
        name, score = plain(tests[r.doc_id])
        assert r.lang_pred == name and r.score == pytest.approx(score)


def test_lines_by_brute_force(spark):
    """The template tree on random lines of few words, with documents given twice and without id."""
    rng = random.Random(11)
    lines = [" ".join(rng.choice(["a", "b", "c", "7", "x@y"]) if rng.random() < 0.25 else w for w in ("this page was made by one of us here").split()[: rng.randrange(1, 10)]) for _ in range(150)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(5)))) for k in range(40)]
    rows += [(5, rng.choice(lines)), rows[7], (None, lines[0]), (60, None)]
    tokens = lambda line: tuple("<*>" if re.search(r"[0-9@]|://", w) else w for w in line.split())
    docs = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                t = tokens(line)
                if t and 100 * sum(w != "<*>" for w in t) >= 80 * len(t):
                    docs.setdefault(t, set()).add(doc)
    pieces = lambda t: [((len(t), *t[:3]), i, t[len(t) * i // k : len(t) * (i + 1) // k]) for k in [len(t) - -(-80 * len(t) // 100) + 1] for i in range(k)]
    of = {}
    for t, own in docs.items():
        for p in pieces(t):
            of.setdefault(p, set()).update(own)
    able = {t: own for t, own in docs.items() if any(len(of[p]) >= 3 for p in pieces(t))}
    spots = {}
    for t, own in able.items():
        for at, w in enumerate(t):
            if w != "<*>":
                spots.setdefault((len(t), *t[:3], at, w), set()).update(own)
    level = {s: math.floor(math.log(len(own) / 3) / math.log(4) + 1e-9) for s, own in spots.items() if len(own) >= 3}
    templates = {}
    for t, own in able.items():
        mine = {at: level[s] for at, w in enumerate(t) if (s := (len(t), *t[:3], at, w)) in level}
        for rung in set(mine.values()):
            kept = tuple((at, t[at]) for at, high in mine.items() if high >= rung)
            if 100 * len(kept) >= 80 * len(t):
                templates.setdefault((len(t), *t[:3], kept), []).append((t, own))
    gone = {t for found in templates.values() if len(set().union(*[own for _, own in found])) >= 3 for t, _ in found}
    want = Counter((doc, None if text is None else "\n".join(x for x in text.split("\n") if doc is None or tokens(x) not in gone)) for doc, text in rows)
    got = Counter((r.doc_id, r.text) for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=False).collect())
    assert got == want and len(gone) > 5


def test_mixing_takes_equal_keys_in_order(spark):
    rows = [(1, "word " * 10, "s")] * 50 + [(2, "word " * 10, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame, weights=(1.0, 49.0)).collect()
    assert len(got) == 51 and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    by = {s: sum(r.taken for r in got if r.source == s) for s in "st"}
    targets = {r.source: r.target for r in got}
    assert all(abs(by[s] - targets[s]) <= 5 for s in "st")
