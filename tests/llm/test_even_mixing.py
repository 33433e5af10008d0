from collections import Counter

from pyspark.sql import functions as F

from bandlake.llm import langid, mixing


def test_buckets_of_a_junk_rich_source_are_even_and_ordered(spark):
    for junk in ("CASE WHEN id % 5 = 0 THEN 0.2 ELSE 1.0 END", "1.0", "1.0 / (1 + id % 21)"):
        rows = spark.range(200_000).selectExpr("id AS doc_id", "'=s' AS src", f"CAST({junk} AS DOUBLE) AS weight")
        keyed = rows.withColumn("sample_key", mixing.exponential_key(F.col("doc_id"), F.col("weight"), 42))
        found = mixing.even_buckets(keyed).groupBy("bucket").agg(F.count("*").alias("n"), F.min("sample_key").alias("lo"), F.max("sample_key").alias("hi")).orderBy("bucket").collect()
        assert sum(r.n for r in found) == 200_000 and max(r.n for r in found) < 4 * 447
        assert all(a.hi <= b.lo for a, b in zip(found[:-1], found[1:], strict=True))


def test_mix_against_a_plain_loop_with_many_copies(spark):
    rows = [(1, "three short words", "s")] * 25_000 + [(k, "w " * (k % 7) + "!" * (k % 3), "s" if k % 2 else None) for k in range(2, 300)] + [(None, None, "s"), (7, "other text", "s"), (None, "no id here", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame, max_epochs=3).collect()
    assert len(got) == len(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for source in ("s", "t", None):
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.sample_key, r.doc_id is not None, r.doc_id or 0, r.tie, not r.selected))
        left, before = own[0].target - own[0].epochs * own[0].source_size, 0
        assert own[0].source_size == sum(r.size for r in own)
        for r in own:
            assert r.selected == (r.size > 0 and before + r.size / 2 <= left), r
            assert r.taken == r.size * (r.epochs + r.selected)
            before += r.size


def test_every_language_has_its_share_of_the_sample(spark):
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(f"{name(lang)}word {name(k)}{name(lang)} text", name(lang)) for lang in range(20) for k in range(100)] + [("same old text", "one")] * 500
    frame = spark.createDataFrame(rows, "text string, lang string")
    for most in (20, 63):
        model = langid.fit(frame, max_rows=most, min_count=1)
        per = max(1, most // 21)
        assert len(model.languages) == 21
        assert all(f"{name(lang)}word" in model.words for lang in range(20)) and "same" in model.words
        assert sum(w not in ("text", "same", "old") and not w.endswith("word") for w in model.words) == 20 * per
        assert langid.predict(model, "same old")[0] == "one"
