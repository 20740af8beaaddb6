"""Texts are rows of numbers once they are weighed, and are compared in blocks: same results however these are cut."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingsift.operators import novelty
from filingsift.session import materialize


def brute(rows):
    """(filing, chunk) -> (match, similarity) of all pairs of texts."""
    def terms(text):
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        out = {}
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            out[t] = out.get(t, 0) + 1
        return out
    held, found = {}, {}
    for _, filing, _, i, text in rows:
        held.setdefault(filing, {})[i] = terms(text)
    for now, ref in (("a2", "a1"), ("a3", "a2")):
        past = held[ref]
        df = {}
        for tf in past.values():
            for t in tf:
                df[t] = df.get(t, 0) + 1

        def weighed(tf):
            w = {t: (1 + np.log(n)) * (np.log((1 + len(past)) / (1 + df[t])) + 1) for t, n in tf.items() if t in df}
            size = np.sqrt(sum(x * x for x in w.values()))
            return {t: x / size for t, x in w.items()}
        there = {i: weighed(tf) for i, tf in past.items()}
        for i, tf in held[now].items():
            w = weighed(tf)
            dots = [(-round(sum(x * v.get(t, 0.0) for t, x in w.items()), 12), k) for k, v in there.items()]
            dot, match = min(dots)
            if dot < 0:
                found[(now, f"{now}_{i}")] = (f"{ref}_{match}", round(-dot, 9))
    return found


@pytest.mark.parametrize("frequent", [2, 10 ** 9])
def test_buckets_and_blocks_do_not_show(spark, monkeypatch, frequent):
    rng = np.random.default_rng(23)
    words = [f"wört{i}" for i in range(15)] + [f"w{i}" for i in range(15)]

    def text():
        return " ".join(rng.choice(words, size=rng.integers(1, 9)))
    rows = [("a", f"a{y - 2003}", y, i, text()) for y in (2004, 2005, 2006) for i in range(40)]
    rows += [("a", "a2", 2005, 40, None), ("a", "a2", 2005, 41, ""), ("a", "a3", 2006, 40, "unseen only")]
    chunks = spark.createDataFrame([(c, f, dt.date(y, 1, 1), f"{f}_{i}", i, t) for c, f, y, i, t in rows],
                                   "company string, filing_id string, filing_date date, chunk_id string, chunk_number int, chunk_text string")
    for name, value in (("BUCKET_CHARS", 900), ("NOW_TEXTS", 7), ("PAST_TEXTS", 11), ("TILE", 3), ("COLUMNS", 4), ("PRODUCTS", 5)):
        monkeypatch.setattr(novelty, name, value)
    weighed = novelty.reference_weights(chunks)
    # a text is a row for each of its roles and each bucket of terms, not a row per term
    sizes = weighed.packed.groupBy("ref", "is_past", "rep").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("w") + F.size("alone_w")).alias("terms"))
    most = sizes.agg(F.max("rows"), F.max("terms")).first()
    assert 1 < most[0] <= 8 < most[1]
    _, _, past, now = weighed
    assert past.count() + now.count() == sizes.agg(F.sum("terms")).first()[0]
    unit = novelty.unit(weighed.packed).filter("is_past").select("ref", "rep", F.explode(F.concat("w", "alone_w")).alias("w"))
    square = unit.groupBy("ref", "rep").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert square.filter("abs(s - 1) > 1e-9").count() == 0
    refs = novelty.references(chunks)
    members = chunks.select("filing_id", "chunk_id", F.sha2("chunk_text", 256).alias("text_key"))
    got = members.join(materialize(novelty.text_matches(chunks, refs, frequent)), ["filing_id", "text_key"])
    assert {(r["filing_id"], r["chunk_id"]): (r["match"], round(r["similarity"], 9)) for r in got.collect()} == brute(rows)


def test_runs_of_large_codes_are_those_of_small_ones():
    from filingsift.operators.vocab import _runs
    rng = np.random.default_rng(2)
    code, row = rng.integers(0, 9, 200), rng.integers(0, 5, 200)
    small, large = _runs(code, row), _runs(code + (1 << 61), row)
    assert (small[0] == large[0] - (1 << 61)).all() and (small[1] == large[1]).all() and (small[2] == large[2]).all()
    assert small[2].sum() == 200 and list(zip(small[1], small[0])) == sorted(set(zip(row, code)))
    assert [len(x) for x in _runs(code[:0], row[:0])] == [0, 0, 0]
