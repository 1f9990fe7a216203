"""C22: every fold is scored by a model of the others."""

import random

from palimpsest.operators import downstream as ds


def _rows(spark, n=400):
    rng = random.Random(3)
    names = ["pair_id", "pair_label", "fold", *ds.FEATURES]
    out = []
    for i in range(n):
        label = ("cit", "cf", *["none"] * 38)[i % 40]
        shift = {"cit": 3.0, "cf": 2.0}.get(label, 0.0)
        out.append((i, label, i % 5 if i % 40 > 1 else (i // 40) % 5, *[rng.gauss(shift if k < 3 else 0.0, 1.0) for k in range(len(ds.FEATURES))]))
    return spark.createDataFrame(out, names).coalesce(1).cache()


def test_every_fold_is_scored(spark):
    found = ds.classify(_rows(spark)).collect()
    assert sorted(r.pair_id for r in found) == list(range(400))
    assert {r.fold for r in found} == set(range(5)) and all(r.score is not None for r in found)


def test_ten_negatives_for_each_positive(spark):
    data = ds.reference_rows(_rows(spark))
    drawn = ds.sample_negatives(data)
    assert (drawn.filter("label = 1").count(), drawn.filter("label = 0").count()) == (20, 200)


def test_macro_f1_and_coefficients(spark):
    rows = _rows(spark)
    found = {r.fold: (r.n, r.macro_f1) for r in ds.type_macro_f1(rows).collect()}
    assert {k: n for k, (n, _) in found.items()} == dict.fromkeys(range(5), 4) and all(0 <= f <= 1 for _, f in found.values())
    table = {r.feature: r for r in ds.coefficients(rows).collect()}
    assert set(table) == set(ds.FEATURES) and all(table[f].sign_agreement == 5 and table[f]["mean"] > 0 for f in ds.FEATURES[:3])


def test_a_fold_without_a_model_keeps_its_rows(spark):
    only = _rows(spark).filter("pair_label = 'none'")
    assert [r.score for r in ds.classify(only.limit(7)).collect()] == [None] * 7
