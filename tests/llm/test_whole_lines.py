import pytest

import corpus_pipeline
from bandlake.llm import linededup


@pytest.mark.parametrize("n", [30, 10_000])
def test_recurring_field_values_stay_variable(spark, n):
    letters = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(i, f"own{i}\nThis page was written by N{letters(i % 100)} in C{letters(i // 100 + i % 100 * 2 % 200)} for the readers") for i in range(n)]
    got = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped <> 1").count() == 0


def test_long_lines_of_two_documents(spark, tmp_path):
    own = lambda k, n: " ".join(f"{chr(97 + k)}w{i}" for i in range(n))
    shared = own(20, 60)
    rows = [(1, f"{own(0, 90)}\n{shared}"), (2, f"{shared.replace(' ', '  ')}\n{own(1, 90)}"), (3, f"{own(2, 90)}\n{own(21, 49)}"), (4, f"{own(3, 90)}\n{own(21, 49)}"), (5, f"{own(4, 90)}\n{shared.replace('w7 ', 'w8 ')}"), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(rows) | {2: own(1, 90)}
    for dropped in (linededup.drop_long_lines(frame), corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path))):
        assert {r.doc_id: r.text for r in dropped.collect()} == want
    assert linededup.drop_long_lines(frame.where("false")).count() == 0


def test_lines_of_fields_stay(spark):
    rows = [(i, f"{i}2.5 3{i}.1 44.{i}\n2024-01-0{i} 2024-02-0{i} 2024-03-0{i}\na{i}@b.c d{i}@e.f g{i}@h.i\nPosted by user{i} on page {i} of the forum today here") for i in range(1, 6)]
    got = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {i: t.rsplit("\n", 1)[0] for i, t in rows}


def test_documents_count_once(spark):
    def dropped(rows):
        got = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        return sorted((r.doc_id, r.n_dropped) for r in got)

    shape = "this notice was put here by {} for all of the readers"
    three = "\n".join(shape.format(x) for x in ("anna", "bert", "carl"))
    assert dropped([(1, three), (2, "something else")]) == [(1, 0), (2, 0)]
    assert dropped([(1, three), (2, shape.format("dora")), (3, "something else")]) == [(1, 0), (2, 0), (3, 0)]
    assert dropped([(1, three), (2, shape.format("dora")), (3, shape.format("emil"))]) == [(1, 3), (2, 1), (3, 1)]
    assert dropped([(1, three)] * 4) == [(1, 0)] * 4
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(spark.createDataFrame([(1, "ok"), (2, "ok\nown line"), (3, "ok"), (None, "ok"), (4, "")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, None: 0, 4: 0}
