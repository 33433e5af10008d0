import pytest

import corpus_pipeline
from bandlake.llm import decontaminate, langid, linededup, mixing, ngram_join, quality, toxicity

NAMES = ("kept", "text_", "features", "raw", "cell", "word", "bits", "gone", "key", "tie", "at", "sig", "line", "component", "head", "n", "drop", "once", "size", "src", "score_", "lang_found", "part", "__text", "__id", "a b")
EXTRA = ", ".join(f"`{n}` string" for n in NAMES)
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
WORDS = "the river house stood green under morning light walking there with friends from town".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(WORDS[k % 13] + str(k * k % 50) for k in range(90))
    texts = [base, base, base + " end", "", None, " ", "one", "!!! 12", "shared line of text here\nown 1", "shared line of text here\nown 2", "shared line of text here\nown 3", " ".join(WORDS) * 9000]
    rows = [(k, t, "en", f"s{k % 2}" if k % 3 else None, None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, base, None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], SCHEMA)


def same_columns(got, docs):
    assert got.columns == docs.columns and got.where(" AND ".join(f"`{n}` = 'x'" for n in NAMES)).count() == got.count()
    return got


def test_operators_keep_columns_of_any_name(spark, docs):
    keep = tuple(f"`{c}`" for c in docs.columns)
    kept = [c for c in docs.columns]
    model = langid.fit(docs)
    for got, extra in (
        (langid.identify(docs, model, keep=keep), ["lang_pred", "score"]),
        (quality.score(docs, quality.RankingModel((0.0,) * len(quality.FEATURES), 1.0, 0.0), keep=keep), ["score"]),
        (toxicity.score(docs, toxicity.ToxicityModel(toxicity.Lexicon({}, {}), None, None), keep=keep), ["score"]),
        (linededup.drop_recurring_lines(docs), ["n_lines", "n_dropped"]),
    ):
        assert got.columns == kept + extra and got.count() == 16
    assert same_columns(linededup.drop_long_lines(docs), docs).count() == 16
    near = same_columns(ngram_join.drop_near_duplicates(docs), docs)
    assert sorted(r.doc_id for r in near.where("doc_id IS NOT NULL").collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    bench = spark.createDataFrame([(1, docs.first().text, "x")], "item_id long, text string, gone string")
    assert sorted(r.doc_id for r in same_columns(decontaminate.decontaminate(docs, bench), docs).where("doc_id IS NOT NULL").collect()) == [3, 4, 5, 6, 7, 8, 9, 9, 10, 11]
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == [*docs.columns, "target", "repeats", "taken"]
    assert mixing.mix_sources(docs).count() == ngram_join.ngram_components(docs).count() == 16


def test_repeated_rows_are_one_set(spark, docs):
    """Rows repeated many times give one pair to verify, not the square of their number."""
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(k, base if k % 2 else base + " end") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    links, _ = ngram_join.ngram_links(frame)
    assert links.count() == 1
    assert {r.component_id for r in ngram_join.ngram_components(frame).collect()} == {0}


def test_more_languages_than_rows(spark):
    rows = [(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} some letters", f"l{k:02}") for k in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=10, min_count=1)
    assert len(model.languages) == 30 and len(model.words) == 32


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, "a benchmark item of some length that stands in no document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.where("false")):
        now, empty = start, start.isEmpty()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            assert now.columns[: len(docs.columns)] == docs.columns and (k == 4 or len(now.columns) == len(docs.columns))
            path = f"{tmp_path}/{empty}{k}"
            now.write.parquet(path)
            now = spark.read.parquet(path)
            assert now.isEmpty() == empty
