import math
import random
import re
from itertools import combinations

import pytest

from bandlake.llm import chat, components, decontaminate, langid, licenses, linededup, media, mixing, ngram_join, quality, toxicity
from bandlake.llm.samples import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, target int, n_lines int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, long = prose(1, 120), prose(2, 4000)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [base, base, near, "", None, "   ", "one", "ONE", "a b c d", long, prose(3, 80), "漢字 ü é", "!!! 123"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 0.5, "x", 1, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id text here", None, None, None, None, None, None, None)], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_targets_and_edges(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 * max(1, total) or total > 3 * sum({r.source: r.source_size for r in rows}.values())
    sizes = {r.source: r.source_size for r in rows}
    weights = dict(zip(sorted((s for s in sizes if s is not None)), (5, 2, 1), strict=False)) | {None: 5}
    want, open_, left = {}, set(sizes), float(total)
    while True:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        for s in over or open_:
            want[s] = 3.0 * sizes[s] if over else left * weights[s] / w
        if not over:
            break
        left -= sum(want[s] for s in over)
        open_ -= over
    assert all(abs(want[s] - targets[s]) < 1e-6 for s in want)
    assert mixing.mix_sources(nothing(spark)).count() == 0
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == sorted(map(str, rows))
    assert set(mixing.apply_mix(docs).columns) == set(docs.columns) | {"repeats", "taken"}


def brute_components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(b)] = root(a)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [j for m, (j, _) in enumerate(sets) if root(m) == root(k) and j is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, docs, size, percent):
    base = prose(9, 60).split()
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):  # chains of edits around the threshold, and a passage that many share
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(9)}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, " ".join(base[:20]) + " " + prose(50 + k, 30)) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(frame, size=size, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, size, percent)


def test_ngram_join_of_nothing(spark, docs):
    assert ngram_join.ngram_components(nothing(spark)).count() == 0
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [0, 3, 4, 5, 6, 8, 9, 10, 11, 12]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == got[101] == got[100] == 100


def test_decontamination(spark, docs):
    item = "the quick brown fox jumps over the lazy dog and runs through the green field at noon today"
    edited = item.replace("quick", "quik").replace("noon", "nooon")
    far = item[::-1]
    rows = [(1, f"intro words {item.upper()} outro"), (2, f"x\n{edited}\ny"), (3, far), (4, None), (5, item[: len(item) // 2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_hits(frame, bench).collect()}
    assert got == {(1, 7): 0, (2, 7): 2}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4, 5]
    small = decontaminate.benchmark_hits(frame, bench, block_chars=10)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(got)
    assert decontaminate.benchmark_hits(nothing(spark), bench).count() == 0


def test_line_dedup(spark, docs):
    rows = [(i, f"own text {' '.join(chr(97 + i) + w for w in WORDS)}\nPosted by user{i} on page {i * 7} of the forum today here\nAll rights reserved.") for i in range(5)]
    rows += [(50, None), (51, ""), (52, "All rights reserved.\nAll rights reserved.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(frame).collect()}
    assert all(got[i].n_dropped == 2 and got[i].text.startswith("own text") for i in range(5))
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[52].text == ""
    kept = {r.doc_id: r.text for r in linededup.drop_recurring_lines(frame, keep_first=True).collect()}
    assert kept[0].count("\n") == 2 and kept[1].count("\n") == 0
    assert linededup.drop_recurring_lines(nothing(spark)).count() == 0
    assert linededup.drop_recurring_lines(docs, counts=False).columns == docs.columns


def test_licences(spark):
    texts = ["Released under the MIT License.", "UNDER THE MIT  LICENSE under the mit license", "apache license, version 2.0", None, "under the mit licence", "Permission is hereby granted, free of charge, to any person getting a copy"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licence_summary(licenses.licence_hits(frame)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels) == (1, 1, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 4)
    assert got[2].base_labels == "apache-2" and got[3].n_words == 0 and got[3].first_word is None and got[3].score == 0.0
    assert got[4].n_base == 0 and got[4].base_labels == "" and got[5].labels == "mit" and got[5].base_labels == ""
    assert licenses.licence_hits(nothing(spark)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be brief"), *[(1, k, "user" if k % 2 else "assistant", prose(k, 40) + " </s>[INST]\\e<") for k in range(1, 30)], (2, 0, "user", None), (2, 0, "user", None), (None, 3, None, "x"), (3, 5, "assistant", "\\k\\\\l<<[["), (3, 5, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(frame, budget=100, history=2)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    import hashlib

    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    first = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 3 and all(w.text.startswith("[TURN]system") for w in first)
    assert all("</s>" not in w.text and "[INST]" not in w.text for w in first)
    assert chat.read_back(chat.chat_windows(frame.where("false"))).count() == 0


def test_language(spark, docs):
    rows = [(i, " ".join(random.Random(i).choice(("the", "and", "thing", "with") if i % 2 else ("der", "und", "nicht", "ein")) for _ in range(30)), "en" if i % 2 else "de") for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the things and with"), (2, "UND NICHT einer"), (3, "123 !"), (4, None), (5, "qqq zzz")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(test, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0) and 0 <= got[5][1] <= 1
    assert langid.identify(nothing(spark), model).count() == 0
    assert langid.fit(nothing(spark)).languages == ()


def test_quality_and_toxicity(spark, docs):
    good = [(i, prose(i, 50), 1, 0) for i in range(60)]
    bad = [(100 + i, " ".join(w + "%%%" for w in prose(i, 50).split()), 0, 0) for i in range(60)]
    rude = [(200 + i, prose(i, 25) + " you idiot loser " + prose(i + 7, 25), 1, 1) for i in range(60)]
    rows = spark.createDataFrame([*good, *bad, *rude], "doc_id long, text string, quality int, toxic int")
    ranked = quality.score(rows, quality.fit(labelled_sample(rows, rows, "quality", max_rows=1000)), keep=("doc_id", "quality"))
    assert ranked.where("(score >= 0.5) <> (quality = 1)").count() == 0
    assert quality.keep_best(ranked, 0.5).count() >= 90
    model = toxicity.fit(labelled_sample(rows, rows, "toxic", max_rows=1000), max_iter=3)
    assert toxicity.score(rows, model, keep=("doc_id", "toxic")).where("(score >= 0.7) <> (toxic = 1)").count() == 0
    for scored in (quality.score(docs, quality.RankingModel((0.0,) * len(quality.FEATURES), 0.0, 0.0)), toxicity.score(docs, model)):
        assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.plain("id1ot!") == ("idiot", True) and toxicity.plain("word,") == ("word", False)


def test_images(spark):
    vectors = [(i, [random.Random(i * 64 + k).uniform(-1, 1) for k in range(64)]) for i in range(12)] + [(50, [random.Random(k).uniform(-1, 1) for k in range(64)]), (60, None), (61, [0.0] * 64)]
    images = media.images_of_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    broken = spark.createDataFrame([(900, 4, 4, b"12"), (901, None, 3, None)], "image_id long, width int, height int, gray binary")
    got = {r.image_id: r.component_id for r in media.image_components(images.unionByName(broken)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(1, 12)) and got[100] == got[0] == got[101]
    assert got[900] == 900 and got[901] == 901
    assert media.image_components(broken.where("false")).count() == 0


def test_best_rows_by_quantile(spark):
    scores = [k / 97 for k in range(90)] + [0.5] * 30
    frame = spark.createDataFrame(list(enumerate(scores)), "doc_id long, score double")
    for share in (0.1, 0.5, 0.8, 1.0):
        rows = quality.mark_best(frame, share).collect()
        kept = sorted(r.score for r in rows if r.kept)
        left = sorted(r.score for r in rows if not r.kept)
        floor = sorted(scores)[max(0, math.ceil((1 - share) * len(scores) - 1e-9) - 1)]
        assert kept == [s for s in sorted(scores) if s >= floor] and (not left or left[-1] < kept[0])
        assert quality.keep_best(frame, share).count() == len(kept)
    assert quality.mark_best(frame.where("false"), 0.5).count() == 0
