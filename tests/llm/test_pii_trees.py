"""The boosted trees of the personal-data operator as arrays: the values of a plain walk, in a plan that does not grow with the trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.llm import pii
from tests.llm.test_operators import plain_probability


def grown(rng, depth):
    """A random tree; some branches end early."""
    if depth == 0 or rng.random() < 0.2:
        return float(rng.normal())
    return int(rng.integers(0, len(pii.FEATURES))), float(rng.integers(0, 5)), grown(rng, depth - 1), grown(rng, depth - 1)


def judge(rng, n, depth=5):
    trees = tuple((1.0 if k == 0 else 0.4, grown(rng, depth)) for k in range(n))
    return pii.Judge(trees, 1.7, -0.2, dict.fromkeys(pii.KINDS, 0.5))


@pytest.mark.parametrize(("n", "depth"), [(0, 5), (1, 0), (3, 1), (20, 5), (7, 8)])
def test_trees_give_the_values_of_a_plain_walk(spark, n, depth):
    rng = np.random.default_rng(n)
    model = judge(rng, n, depth)
    rows = [[float(v) for v in rng.integers(-1, 6, len(pii.FEATURES))] for _ in range(300)]  # many equal a limit
    df = spark.createDataFrame([(k, f) for k, f in enumerate(rows)], "k int, f array<double>")
    got = {r.k: r.p for r in df.select("k", model.probability()(F.col("f")).alias("p")).collect()}
    assert [got[k] for k in range(len(rows))] == pytest.approx([plain_probability(model, f) for f in rows], rel=1e-14)


def test_the_plan_does_not_grow_with_the_trees(spark, capsys):
    """The driver holds, rewrites and prints the plan: with 20 trees as nested conditions it had thousands of them in each place of use."""
    docs, counts = spark.createDataFrame([("call (743) 555-3824 now",)], "text string"), []
    for n in (1, 20):
        capsys.readouterr()
        pii.redact(docs, judge(np.random.default_rng(5), n)).explain(mode="extended")
        counts.append(capsys.readouterr().out.count("CASE WHEN"))
    assert counts[0] == counts[1] > 0
