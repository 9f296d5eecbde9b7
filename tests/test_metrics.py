from hypothesis import given, settings, strategies as st

from scopekit.functions.metrics import graceful_correct, pages_overlap, strict_correct, tolerant_correct

# pred, truth, strict, tolerant, graceful (truth is the tolerance base)
CASES = [
    (100000, 100001, True, True, False),
    (100000, 100002, False, True, False),
    (90000, 100000, False, True, False),
    (100000, 90000, False, False, False),
    (111, 100, False, True, False),
    (581000, 581, False, False, True),
    (0, 1, False, True, False),
    (0, 0, True, True, True),
    (2.5, 2, True, True, True),
    (None, None, True, True, True),
    (None, 5, False, False, False),
    (5, None, False, False, False),
]


def test_accuracy_table(spark):
    df = spark.createDataFrame([(float(p) if p is not None else None, float(t) if t is not None else None)
                                for p, t, *_ in CASES], "p double, t double")
    got = df.select(strict_correct("p", "t"), tolerant_correct("p", "t"), graceful_correct("p", "t")).collect()
    assert [tuple(r) for r in got] == [tuple(c[2:]) for c in CASES]


def test_sources_overlap(spark):
    df = spark.createDataFrame([([3, 4], [4, 5]), ([], []), ([-1], [2]), (None, [1])],
                               "p array<bigint>, t array<int>")
    assert [r[0] for r in df.select(pages_overlap("p", "t")).collect()] == [True, False, False, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 9), st.integers(0, 10 ** 9)), min_size=1, max_size=40))
def test_strict_implies_tolerant_for_integers(spark, pairs):
    df = spark.createDataFrame(pairs, "p bigint, t bigint")
    for s, t in df.select(strict_correct("p", "t"), tolerant_correct("p", "t")).collect():
        assert (not s) or t


def test_strict_matches_numpy_rule(spark):
    import numpy as np
    pairs = [(1.5, 2.0), (2.5, 2.0), (1e9, 1e9 + 9999), (1e9, 1e9 + 10001), (-3.5, -4.0), (7.0, 7.49)]
    df = spark.createDataFrame(pairs, "p double, t double")
    got = [r[0] for r in df.select(strict_correct("p", "t")).collect()]
    p = np.array([a for a, _ in pairs])
    t = np.array([b for _, b in pairs])
    assert got == list(np.isclose(p.round(), t.round()))
