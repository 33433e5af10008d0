"""Rounds of linking take no more jobs than they need."""

from bandlake.llm import components, hubs


def executions(spark) -> int:
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def settled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return executions(spark)


def test_components_take_a_query_a_round(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (5, 4), (6, 6)], "a long, b long")
    before = settled(spark)
    found = components.connected_components(edges)
    assert settled(spark) - before == 3  # the links, a round, and one that changes nothing
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_no_links_leave_labels_alone(spark):
    labels = spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")
    before = settled(spark)
    assert components.merge_labels(labels, spark.createDataFrame([], "a long, b long")) is labels
    assert settled(spark) - before <= 1
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_rounds_without_pairs_verify_nothing(spark):
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.limit(0)

    members = spark.createDataFrame([(1, s, s) for s in range(1, 6)], "key long, sig long, n long")
    labels = hubs.link_by_hubs(members, verify, fits=lambda m, h: hubs.F.col(f"{m}.n") + hubs.F.col(f"{h}.n") < 0)
    assert {tuple(r) for r in labels.collect()} == {(s, s) for s in range(1, 6)}
    assert asked == [0]  # the first comparison only
