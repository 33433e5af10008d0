import random

import corpus_pipeline
from bandlake.llm import decontaminate

WORDS = "the and with from there under over house river mountain walking talking green yellow morning evening".split()


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))
    item = " ".join(f"{rng.choice(WORDS)}x{k}" for k in range(30))
    clean = [text(80) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1].replace("the", "teh", 1)), (102, f"{text(40)} {item} {text(40)}"), (103, "12 34 !!"), (104, None)]
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sets = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == frame.columns
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        sets.append({r.doc_id for r in docs.collect()})
    everything = {i for i, _ in rows}
    assert sets[0] == everything - {103, 104}
    assert sets[1] == sets[0]
    assert sets[2] == sets[1] - {100, 101}
    assert sets[3] == {i for i in sets[2] if i == 100 or not list(decontaminate.Matcher([(1, decontaminate.normalise(item))], 0.08).hits(decontaminate.normalise(dict(rows)[i])))}
    assert 102 not in sets[3] and sets[4] <= sets[3] and len(sets[4]) > 10
