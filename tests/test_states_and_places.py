"""Stored states, growing feature stores, dedup by place and encoders in tasks."""
import re

import pytest
from pyspark.sql import functions as F

from filingsift.operators import encoding, row_dedup, vectors
from filingsift.sources import states


@pytest.fixture
def rows(spark):
    data = [(i % 7, "text " * (i % 5), None if i % 3 else i % 2 == 0) for i in range(60)]
    data += [(None, None, None), (None, "", None), (None, "null", None), (None, None, None), (1, "a\u0000b", True), (1, "a", True)]
    return spark.createDataFrame(data, "k int, text string, flag boolean").repartition(4)


@pytest.mark.parametrize("most", [row_dedup.MOST_PLACES, 7, 1])
def test_rows_are_dropped_where_they_lie(spark, rows, tmp_path, most):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    got = row_dedup.drop_repeated_rows(spark, path, most)
    assert got.columns == rows.columns
    spelled = lambda df: sorted(map(repr, df.collect()))
    assert spelled(got) == spelled(rows.distinct())


def test_no_exchange_carries_a_text(spark, rows, tmp_path, capsys):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    for plan in (row_dedup.repeated_places(spark, path), row_dedup.drop_repeated_rows(spark, path)):
        capsys.readouterr()
        plan.explain("formatted")
        blocks = re.findall(r"^\(\d+\) (\w*Exchange\w*).*?\n(.*?)\n\n", capsys.readouterr().out, re.S | re.M)
        assert blocks and not any("text#" in body for _, body in blocks)


def test_blocks_cover_every_file_once():
    counts = [("a", 3, 10), ("b", 3, 5), ("c", 9, 100), ("d", 1, 0)]
    blocks = list(row_dedup._blocks(counts, 4))
    assert {f for files, _, _ in blocks for f in files} == set("abcd")
    ranges = [(first, end) for files, first, end in blocks if files == ["c"]]
    assert ranges[0][0] == 0 and ranges[-1][1] is None and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(end - first <= 4 for first, end in ranges[:-1])


def test_empty_table_and_table_without_repeats(spark, rows, tmp_path):
    for name, df in (("none", rows.limit(0)), ("unique", rows.distinct())):
        df.write.parquet(str(tmp_path / name))
        assert row_dedup.drop_repeated_rows(spark, str(tmp_path / name)).count() == df.count()


def test_state_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    table = spark.createDataFrame([(1, [0.5])], "i int, v array<double>")
    keys = states.fingerprint(spark.range(5))
    assert keys == states.fingerprint(spark.range(5).repartition(3)) != states.fingerprint(spark.range(6))
    assert states.fingerprint(spark.range(5).union(spark.range(1))) != keys
    states.save_state(spark, path, "small", {"n": 1}, {"t": table}, keys=keys)
    states.save_state(spark, path, "small", {"n": 2}, {"t": table.union(table)}, keys=keys)
    back = states.load_state(spark, path, "small", keys)
    assert back.parameters == {"n": 2} and back.table("t").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["state"]
    with pytest.raises(states.StaleState, match="other keys"):
        states.load_state(spark, path, "small", states.fingerprint(spark.range(6)))
    with pytest.raises(states.StaleState, match="wanted"):
        states.load_state(spark, path, "large")
    with pytest.raises(FileNotFoundError):
        states.load_state(spark, str(tmp_path / "nothing"), "small")
    table.select("i").write.mode("overwrite").parquet(f"{path}/tables/t")
    with pytest.raises(states.StaleState, match="not the one"):
        states.load_state(spark, path, "small").table("t")


def test_a_failed_save_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "state")
    good = spark.createDataFrame([(1,)], "i int")
    states.save_state(spark, path, "small", {"n": 1}, {"t": good})
    bad = good.select(F.raise_error(F.lit("lost")).cast("int").alias("i"))
    with pytest.raises(Exception, match="lost"):
        states.save_state(spark, path, "small", {"n": 2}, {"t": bad})
    assert states.load_state(spark, path, "small").parameters == {"n": 1}


def test_store_builds_missing_keys_only(spark, tmp_path):
    built = []

    def build(keys):
        built.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("x", F.col("id") * 2)
    store = states.FeatureStore(spark, str(tmp_path / "store"), "id", "v1")
    assert store.read() is None
    assert store.extend(spark.range(3), build).count() == 3
    out = store.extend(spark.range(1, 6), build)
    assert built == [[0, 1, 2], [3, 4, 5]]
    assert sorted((r["id"], r["x"], r["part"]) for r in out.collect()) == [(1, 2, 0), (2, 4, 0), (3, 6, 1), (4, 8, 1), (5, 10, 1)]
    assert store.extend(spark.range(6), build).count() == 6 and len(built) == 2
    with pytest.raises(states.StaleState):
        states.FeatureStore(spark, str(tmp_path / "store"), "id", "v2").read()


def test_a_part_that_was_cut_off_is_not_seen(spark, tmp_path):
    store = states.FeatureStore(spark, str(tmp_path / "store"), "id", "v1")
    with pytest.raises(ValueError, match="missing keys"):
        store.extend(spark.range(4), lambda keys: keys.filter("id > 0"))
    assert store.read() is None
    spark.range(2).write.parquet(str(tmp_path / "store" / "part-0-lost"))
    assert store.extend(spark.range(4), lambda keys: keys.withColumn("x", F.lit(1))).count() == 4 and len(store.parts()) == 1


def test_one_encoder_per_task_and_batches_of_like_length(spark):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)

        def encode(texts):
            calls.add(1)
            assert len(texts) <= 8 and [len(t) for t in texts] == sorted(len(t) for t in texts)
            return [[float(len(t)), 1.0] for t in texts]
        return encode
    df = spark.range(100).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") * 37 % 50).cast("int"))).alias("t")).repartition(3)
    out = encoding.encode_documents(df, "id", "t", make, batch=8, pool=20).collect()
    assert {r["id"]: r["embedding"] for r in out} == {i: [float(i * 37 % 50 if i != 7 else 0), 1.0] for i in range(100)}
    assert loads.value == 3 and calls.value >= 100 / 8
    assert encoding.encode_documents(df.limit(0), "id", "t", make).collect() == []
    small = encoding.encode_documents(df, "id", "t", make, batch=8, pool_bytes=10).count()
    assert small == 100


def test_encoder_equals_the_column_expression(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    made = encoding.encode_documents(docs, "doc_id", "text", encoding.word_md5_encoder(16))
    plain = docs.select("doc_id", vectors.hashed_vector("text", 16).alias("plain"))
    gaps = F.array_max(F.transform(F.arrays_zip("embedding", "plain"), lambda z: F.abs(z["embedding"] - z["plain"])))
    row = made.join(plain, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(gaps).alias("gap")).first()
    assert row["n"] == docs.count() and row["gap"] < 1e-6
