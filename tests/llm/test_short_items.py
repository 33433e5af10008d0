from bandlake.llm import decontaminate


def test_short_items_are_found(spark):
    items = [(1, "Who wrote it?"), (2, "法国的首都是哪里"), (3, "two cats"), (4, ""), (5, "  "), (6, None)]
    rows = [(10, "She asked: WHO  wrote\nit? Nobody."), (11, "问题：法国的首都是哪里？"), (12, "two catsuits, lotwo cats, two cat"), (13, "x. two cats"), (14, "who wrota it?"), (15, "")]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.end_char) for r in decontaminate.benchmark_hits(frame, bench).collect()}
    assert got == {(10, 1, 0, 24), (11, 2, 0, 11), (13, 3, 0, 11)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [12, 14, 15]
