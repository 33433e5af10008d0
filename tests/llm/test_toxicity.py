import random

import pytest

from bandlake.llm import toxicity

WORDS = "the house stood by a river and we walked there in the evening light with friends from town".split()
LEXICON = toxicity.Lexicon({"dolt": 3.0}, {"nincom": 2.0})


def features(text):
    return dict(zip(toxicity.FEATURES, toxicity.text_features(text, LEXICON, {}), strict=True))


def test_closeness_of_second_person():
    gap = " ".join(["word"] * 50)
    near, far = features(f"you idiot {gap}"), features(f"you {gap} idiot")
    assert (near["closest"], far["closest"]) == (1.0, 1 / 51) and near["addressed"] > far["addressed"] == 0.0
    same = [k for k in toxicity.FEATURES if k not in ("closest", "addressed")]
    assert all(near[k] == far[k] for k in same)


def test_features_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        tokens = [rng.choice([*WORDS, "you", "Your", "idiot", "DOLT!", "nincompoop", "id1ot", "stop!"]) for _ in range(rng.randrange(0, 60))]
        got, plain = features(" ".join(tokens)), [toxicity.plain(t) for t in tokens]
        hit = [i for i, (w, _) in enumerate(plain) if w in toxicity.INSULTS or w == "dolt" or w[:6] == "nincom" and len(w) >= 6]
        you = [i for i, (w, _) in enumerate(plain) if w in toxicity.SECOND_PERSON]
        apart = [max(1, min(abs(i - j) for j in you)) for i in hit] if you else []
        n = max(1, len(tokens))
        assert got["closest"] == pytest.approx(1 / min(apart) if apart else 0.0)
        assert got["addressed"] == pytest.approx(sum(d <= toxicity.REACH for d in apart) / n)
        assert got["second_person"] == pytest.approx(len(you) / n)
        assert got["insults"] == pytest.approx(sum(w in toxicity.INSULTS for w, _ in plain) / n)
        assert got["obfuscated"] == pytest.approx(sum(veiled and (w in toxicity.INSULTS or w == "dolt") for w, veiled in plain) / n)


def test_one_label_and_none(spark):
    schema = "doc_id long, text string, label double"
    rows = [(i, "some text here", 1.0) for i in range(20)]
    texts = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "you " * 30_000)], "doc_id long, text string")
    for sample, want in ((rows, 1.0), ([(i, t, 0.0) for i, t, _ in rows], 0.0), ([], 0.0)):
        model = toxicity.fit(spark.createDataFrame(sample, schema))
        assert [r.score for r in toxicity.score(texts, model).collect()] == [want] * 5
        assert toxicity.score(texts.where("false"), model).count() == 0
