"""Private spans against the patterns as stated and plain co-occurrence counts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from bandlake.llm import privacy

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            value = m[0].lower() if kind == "email" else ".".join(str(int(p)) for p in m[0].split(".")) if kind == "ip" else digits
            out.append((m.start(), KINDS.index(kind), m.end(), (kind, value)))
    return out


def plain_words(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return [(m.start(), m.end(), m[0].translate(fold)) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(rows, radius, support, threshold):
    """Spans of each row, by sets of documents."""
    near, surroundings, holds, entity_docs = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    own = []
    for k, (_, text) in enumerate(rows):
        base, words = plain_base(text), plain_words(text)
        for _, _, w in words:
            holds["word", w].add(k)
            holds["class", w[:3]].add(k)
        free = [w for w in words if not any(w[0] < b and w[1] > a for a, _, b, _ in base)]
        own.append((base, free))
        by_entity = defaultdict(list)
        for a, _, b, e in base:
            before, after = [w for w in free if w[1] <= a], [w for w in free if w[0] >= b]
            by_entity[e].append((tuple(w for *_, w in before[-2:]), tuple(w for *_, w in after[:2])))
            inside = {w for *_, w in [*before[-radius:], *after[:radius], *[x for x in free if x not in before and x not in after]]}
            entity_docs[e].add(k)
            for w in inside:
                for item in (("word", w), ("class", w[:3])):
                    near[e, item].add(k)
        for e, sides in by_entity.items():
            for key in list(near):
                if key[0] == e and k in near[key]:
                    surroundings[key].add(tuple(sides))
    strong = set()
    for (e, item), docs in near.items():
        held, n = len(entity_docs[e]), len(rows)
        if len(surroundings[e, item]) >= support and held < n:
            if math.log2(n * len(docs) / (held * len(holds[item]))) / math.log2(n / held) >= threshold:
                strong.add((e, item))
    out = []
    for (doc_id, _), (base, free) in zip(rows, own, strict=True):
        spans = [(a, k, b) for a, k, b, _ in base]
        mine = {e for r, (b, _) in zip(rows, own, strict=True) if r[0] == doc_id for *_, e in b}
        for a, b, w in free if base and doc_id is not None else ():
            told = [e for e in mine if (e, ("word", w)) in strong]
            if told:
                spans.append((a, 5 if any((e, ("class", w[:3])) in strong for e in told) else 4, b))
        out.append((doc_id, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans) if k < 4).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    filler = "the of and river stone Über naïve 漢字 cloud paper market winter yellow simple matter".split()
    prose = lambda n: " ".join(rng.choice(filler) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    people = [("zorblat@mail.example.com", "Zorblatov"), ("+1 (555) 123-4567", "quixel"), ("10.20.30.40", "stonewall"), ("4539 1488 0343 6467", "vexhollow"), ("Ann.Lee@Example.org", "rivulet")]
    rows = []
    for k in range(240):
        text = prose(rng.randrange(3, 40))
        if k % 4 == 0:
            contact, name = rng.choice(people)
            text += f" {prose(2)} {name.upper() if k % 8 else name} {contact} {prose(3)} {name if k % 3 else ''} {prose(rng.randrange(20))} {name}"
        if k % 30 == 7:
            text += f" {people[4][1]} alone"  # said elsewhere, too
        if k % 20 == 3:
            text += " rivals rivets "
        rows.append((k, text))
    odd = [
        None, "", " ", "@", "a@b", "a@b.c", "x.y@z-.q..w", "a@@b.cc", "p@q.r@s.t", "é@x.yz", "né.a@x.yz", "256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4", "1.2.3", "9" * 5000, "4111111111111111", "4111 1111 1111 1112", "4111-1111-1111-1111 2",
        "79927398713", "+12", "+1 2345678", "+1 23456789 ", "+1 (23) 456.789-0+49 30 1234567", "+" * 50 + "1 2 3 4 5 6 7 8 9)", "mail: 漢字 a.b@c.de, ip 8.8.8.8; +44 20 7946 0958" * 3, "w" * 3000 + "@" + "h" * 3000 + ".com", ("word " * 3000) + "a@b.cd " + "é" * 4000,
        "0000000000000000", "4111\n1111", "1.2.3.4@h.io", "+49 4111111111111111",
    ]
    rows += [(1000 + k, t) for k, t in enumerate(odd)] + [(0, rows[0][1]), (None, rows[0][1]), (4, "another text of that id quixel")]
    return rows


SCHEMA = "doc_id long, text string, spans int, kept int, terms int, sanitised int"


@pytest.mark.parametrize(("radius", "support", "threshold"), [(10, 3, 0.9), (3, 2, 0.6), (5, 1, 0.8)])
def test_spans_equal_the_plain_version(spark, radius, support, threshold):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)
    found = privacy.span_digests(privacy.find_private(frame, limits=privacy.Limits(radius, support, threshold))).collect()
    want = plain(rows, radius, support, threshold)
    assert Counter((r.doc_id, r.spans, r.base_sha256) for r in found) == Counter(want)
    for r in found:
        kinds = [s.split(":")[0] for s in r.spans.split(",")]
        assert [r[f"n_{k}"] for k in KINDS] == [kinds.count(k) for k in KINDS]
    if threshold == 0.9:
        assert any("generalised" in s for _, s, _ in want) and any("removed" in s for _, s, _ in want)


def test_blocks_of_long_texts_are_cut_between_words(monkeypatch):
    text = ("abc défg 漢字, " * 50 + "x" * 100).encode()
    whole = privacy._words(__import__("numpy").frombuffer(text, "u1"))
    monkeypatch.setattr(privacy.textbits, "BLOCK", 16)
    for a, b in zip(privacy._text_words(text), whole, strict=True):
        assert a.tolist() == b.tolist()


def test_sanitised_text_keeps_columns(spark):
    rows = [(k, f"word{k} Zorblatov z@mail.com then {k}", 7, 8, 9, 10) for k in range(6)] + [(100 + k, "nothing here, zebra", 7, 8, 9, 10) for k in range(60)] + [(200, None, 1, 1, 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = privacy.sanitise(frame)
    assert out.columns == frame.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "wor* [removed] [email] [removed] 0" or texts[0].split()[1] == "[removed]" and "[email]" in texts[0]
    assert texts[100] == "nothing here, zebra" and texts[200] is None and len(texts) == 67
    assert "Zorblatov" not in " ".join(t for t in texts.values() if t)


def test_empty_table(spark):
    assert privacy.span_digests(privacy.find_private(spark.createDataFrame([], SCHEMA))).count() == 0
    (row,) = privacy.span_digests(privacy.find_private(spark.createDataFrame([(None, None, 1, 1, 1, 1)], SCHEMA))).collect()
    assert (row.doc_id, row.spans, row.base_sha256) == (None, "", hashlib.sha256(b"").hexdigest())
