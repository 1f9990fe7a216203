"""The bootstrap draws where a row lies, and hands on sums."""

import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import score as so


def test_replicates_by_hand_and_no_row_per_replicate(spark):
    rows = [(i, "x" if i % 3 else None, int(i * 7 % 11 < 4), round((i * 37 % 20) / 20, 6)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, part string, gold int, score double").repartition(3)

    def weight(i, part, rep):
        key = "|".join(str(x) for x in (1, i, part, rep) if x is not None)
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        return 1 if rep == 0 else sum(u >= p for p in so.POISSON)

    areas = []
    for rep in range(9):
        pos, neg = ([(s, weight(i, part, rep)) for i, part, g, s in rows if g == gold] for gold in (1, 0))
        won = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
        areas.append(won / (sum(a for _, a in pos) * sum(b for _, b in neg)))
    out = so.bootstrap_auc(df, ["id", "part"], replicates=8)
    r = out.first()
    assert (r.auc, r.replicates) == (pytest.approx(areas[0], abs=1e-6), 8)
    assert r.spread == pytest.approx(statistics.pstdev(areas[1:]), abs=1e-6)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_one_score_for_all_and_none(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("gold"), F.lit(0.5).alias("score"))
    assert so.bootstrap_auc(df, ["id"], replicates=2).first().auc == 0.5
    assert so.bootstrap_auc(df.limit(0), ["id"], replicates=2).first().auc is None
