import random
from itertools import combinations

from bandlake.llm import ngram_join


def test_links_inside_components(spark):
    rng, base = random.Random(6), [f"w{k}" for k in range(300)]
    texts = [" ".join(base)] * 2
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(300)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    texts += ["", None, "other words here"]
    links, members = ngram_join.ngram_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    of = {r.doc_id: r["class"] for r in members.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in enumerate(texts) if (w := (t or "").split())}
    want = {tuple(sorted((of[a], of[b]))) for a, b in combinations(sets, 2) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 26
    assert of[0] == of[1] and of[27] is None and of[28] is None
