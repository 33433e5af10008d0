"""What line dedup sends through Python, and which way its joins take."""

import pytest

from bandlake.llm import linededup


@pytest.fixture
def given(monkeypatch):
    """Rows given and returned by each function in tasks, by its name."""
    seen, real = {}, linededup.in_tasks

    def noted(df, function, schema):
        out = real(df, function, schema)
        seen.setdefault(function.func.__name__, []).append((df, out))
        return out

    monkeypatch.setattr(linededup, "in_tasks", noted)
    return seen


def test_only_documents_that_lose_lines_leave_spark(spark, given):
    rows = [(k, f"own words number{chr(97 + k)} of it\n\nend{chr(97 + k)}") for k in range(20)] + [(k, f"the same line for all\nrest{chr(77 + k)}") for k in range(20, 24)] + [(24, None), (25, ""), (None, "the same line for all\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_recurring_lines(docs).collect()}
    assert got == {k: (t, 3, 0) for k, t in rows[:20]} | {k: (t.split("\n")[1], 2, 1) for k, t in rows[20:24]} | {24: (None, 0, 0), 25: ("", 1, 0), None: (rows[-1][1], 2, 0)}
    assert sum(df.count() for df, _ in given["_without"]) == 4


def test_a_class_is_read_in_its_first_document_only(spark, given):
    docs = spark.createDataFrame([(k, "the same line for all\nand one more of them") for k in range(40)], "doc_id long, text string").repartition(8)
    assert {r.n_dropped for r in linededup.drop_recurring_lines(docs).collect()} == {2}
    assert sum(out.count() for _, out in given["_wanted"]) == 2


def test_small_and_large_lists_take_one_way(spark):
    docs = spark.createDataFrame([(k, "the same line for all\n" + "x" * k) for k in range(9)], "doc_id long, text string")
    plan = linededup.drop_recurring_lines(docs)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftOuter" in line and "[doc_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
