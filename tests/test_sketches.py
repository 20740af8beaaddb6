"""Sketch states: stored by group, merged over any groups, within the stated errors."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from filingsift.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 40_000
    years, words = rng.integers(2000, 2005, n), (rng.pareto(1.5, n) * 300).astype(int)
    data = [(int(y), int(w), f"c{int(c)}") for y, w, c in zip(years, words, rng.integers(0, 9000, n))]
    return spark.createDataFrame(data + [(2004, None, None)], "y int, words int, company string").repartition(6).cache()


def exact(rows, low, high):
    data = [r for r in rows.collect() if low <= r["y"] <= high]
    return np.sort([r["words"] for r in data if r["words"] is not None]), len({r["company"] for r in data if r["company"]})


def test_merged_states_keep_the_errors(spark, rows, tmp_path):
    states = sketches.store_states(sketches.build_states(rows, ["y"], ["words"], ["company"]), str(tmp_path / "s"), ["y"])
    assert states.count() == 5
    for low, high in ((2000, 2004), (2001, 2002), (2003, 2003)):
        row = sketches.estimates(sketches.merge_states(states.filter(F.col("y").between(low, high))), (0.1, 0.5, 0.9)).first()
        words, companies = exact(rows, low, high)
        assert row["n_words"] == len(words)
        for p in (10, 50, 90):
            value = row[f"p{p}_words"]
            below, upto = np.searchsorted(words, value, "left") / len(words), np.searchsorted(words, value, "right") / len(words)
            assert below - sketches.rank_error() <= p / 100 <= upto + sketches.rank_error()
        assert abs(row["distinct_company"] - companies) <= companies * sketches.count_error()


def test_a_group_built_again_replaces_its_own_state(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    sketches.store_states(sketches.build_states(rows, ["y"], ["words"]), path, ["y"])
    again = sketches.store_states(sketches.build_states(rows.filter("y = 2003").limit(10), ["y"], ["words"]), path, ["y"])
    sizes = {r["y"]: r["n_rows"] for r in again.collect()}
    assert sizes[2003] == 10 and sizes[2002] == rows.filter("y = 2002").count() and len(sizes) == 5


def test_groups_without_values(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None), (2, 5, "a")], "y int, words int, company string")
    out = {r["y"]: r for r in sketches.estimates(sketches.build_states(df, ["y"], ["words"], ["company"]), (0.5,)).collect()}
    assert (out[1]["n_rows"], out[1]["p50_words"], out[1]["distinct_company"]) == (1, None, 0)
    assert (out[2]["n_words"], out[2]["p50_words"], out[2]["distinct_company"]) == (1, 5.0, 1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sketches.stored_states(spark, str(tmp_path / "none"), df.schema)


def test_states_do_not_grow_with_their_rows(rows):
    sizes = sketches.build_states(rows.unionByName(rows).unionByName(rows), ["y"], ["words"], ["company"]).agg(
        F.max(F.octet_length("q_words")).alias("q"), F.max(F.octet_length("d_company")).alias("d")).first()
    assert sizes["q"] < 60_000 and sizes["d"] < 140_000
