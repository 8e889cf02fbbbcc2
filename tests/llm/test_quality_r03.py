"""Finding 9 of round 3: n-grams seen once have the method's own discount."""

from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import quality

from .test_llm import gram_key


def test_f9_what_was_seen_once_has_the_methods_own_discount(spark):
    """Of the highest order: (1 - D1) / 1 of a context's only n-gram, and D1 is what it leaves."""
    rng = np.random.default_rng(4)
    grams = Counter(map(tuple, rng.zipf(1.6, (900, quality.ORDER)).clip(1, 60).tolist()))
    n = [sum(c == k for c in grams.values()) for k in range(4)]
    d1 = 1 - 2 * n[1] / (n[1] + 2 * n[2]) * n[2] / n[1]
    table = spark.createDataFrame([("en", gram_key(g), c) for g, c in grams.items()], "lang string, gram bigint, n bigint")
    found = {(r.n_order, r.key): r for r in quality.kneser_ney(table, once=True).collect()}
    contexts = Counter(g[:-1] for g in grams)
    alone = [g for g, c in grams.items() if c == 1 and contexts[g[:-1]] == 1]
    assert len(alone) > 50 and 0.05 < d1 < 0.95
    for g in alone:
        assert found[quality.ORDER, gram_key(g)].share == pytest.approx(1 - d1) and found[quality.ORDER - 1, gram_key(g[:-1])].rest == pytest.approx(d1)
    model = quality._arrays(quality.kneser_ney(table, once=True), ["en"])["en"]
    for g in [*alone[:2], (9, 9, 9, 9, 9)]:
        keys = np.array([gram_key((*g[:-1], s)) for s in range(1 << quality.BITS)], np.uint64)
        assert abs(np.exp(model.log_prob(keys)).sum() - 1) < 1e-5


def test_the_models_plan_holds_one_order_at_a_time(spark):
    """The pipeline's driver, round 3: an order's counts are read, not drawn again from those of all orders above it."""
    table = spark.createDataFrame([("en", gram_key((1, 2, 3, 4, s)), s) for s in range(1, 9)], "lang string, gram bigint, n bigint")
    text = quality.kneser_ney(table)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == quality.ORDER + 1  # contexts of each order, and shares and rests of a key together; 52 in one plan
    assert text.count("Relation [lang#") >= 2 * quality.ORDER
