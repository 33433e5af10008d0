import random

import pytest

from bandlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_long_turns_stand_alone(spark):
    rows = [(1, 0, "system", "be brief"), *[(1, k, "user", "word " * 200) for k in range(1, 5)], (1, 5, "user", "word " * 80), (1, 6, "user", "word")]
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), budget=100).orderBy("window").collect()
    assert [w.tokens for w in windows] == [6, 204, 204, 204, 204, 90, 11 + 84]
    assert [[s.idx for s in w.spans] for w in windows] == [[0], [1], [2], [3], [4], [0, 5], [0, 5, 6]]


@pytest.mark.parametrize("budget", [40, 100, 512])
def test_windows_keep_the_budget(spark, budget):
    rng, rows = random.Random(budget), []
    for conv in range(30):
        rows += [(conv, 0, "system", "rule " * rng.choice((1, 10, 40, 700)))] * (conv % 3 > 0)
        rows += [(conv, k, "user" if k % 2 else "assistant", "word " * rng.choice((0, 1, 7, 20, 60, 300, 1500))) for k in range(1, rng.randrange(2, 90))]
    of = {(c, i): len(t.split()) + chat.MARK_TOKENS for c in range(30) for i, (_, _, _, t) in enumerate(sorted(r for r in rows if r[0] == c))}
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), budget=budget).collect()
    owned = []
    for w in windows:
        idx = [s.idx for s in w.spans]
        own = [s.idx for s in w.spans if not s.carried]
        assert w.tokens == sum(of[w.conv_id, i] for i in idx) and (w.tokens <= budget or len(idx) == 1)
        assert idx == sorted(set(idx)) and own == list(range(own[0], own[-1] + 1)) and w.window == own[0] and not any(s.loss for s in w.spans if s.carried)
        carried = [i for i in idx if i < own[0]]
        recent = [i for i in carried if i > 0 or idx[0] > 0]
        assert len(recent) <= 3 and recent in ([], list(range(recent[0], own[0])) if recent else [])
        owned += [(w.conv_id, i) for i in own]
    assert sorted(owned) == sorted(of)
