"""Pairs that the near-duplicate stage compares first grow with the nodes, not with the bands they are in."""

from landrecon.llm import simhash


def test_two_pairs_a_node(spark):
    rows = []
    for band in range(40):  # every band of the group has another least and greatest member
        group = range(100 + band, 200 - band)
        rows += [(band, node, min(group), max(group)) for node in group]
    found = {tuple(r) for r in simhash._tried(spark.createDataFrame(rows, "key long, node long, low long, high long")).collect()}
    assert len(found) <= 2 * 100
    assert {(100, n) for n in range(101, 200)} <= found and {(n, 199) for n in range(100, 199)} <= found
