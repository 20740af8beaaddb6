"""Vector codes, source mixing and token alignment against plain versions of their definitions."""
import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingsift.llm import source_mixing, token_alignment, vector_codes
from filingsift.llm.tables import Tables


def plain_codes(rows, entries=64, rounds=2):
    """{row index: (code, error)} and codebooks, every part compared with every entry; rows of (id, vector)."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, (_, v) in enumerate(rows)]
    order = sorted(kept, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, rows[r[0]][1]))
    w = len(kept[0][1]) // 16
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v in order[:entries]] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            sums = defaultdict(list)
            for _, v in kept:
                sums[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(sums[j]) for c in zip(*sums[j])] if j in sums else c for j, c in enumerate(books[p])]
    out = {}
    for i, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(16)]
        out[i] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found))
    return out, books


def coded(spark, rows, entries=64, rounds=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    out, books = vector_codes.compress(df, Tables(spark, "t11"), entries=entries, rounds=rounds)
    return vector_codes.with_label_errors(out, Tables(spark, "t11l")).collect(), books


@pytest.mark.parametrize("dim,n", [(16, 30), (32, 300), (48, 200)])
def test_codes_equal_full_comparison(spark, dim, n):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, rng.gauss(3, .1)]) for _ in range(dim)], rng.choice("abc")) for i in range(n)]
    rows = [(i, [float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    want, books = plain_codes([r[:2] for r in rows])
    got, found = coded(spark, rows)
    assert {r["id"]: (r["code"], r["error"]) for r in got} == {rows[i][0]: x for i, x in want.items()}
    assert found.tolist() == books
    sums = Counter()
    for i, (_, e) in want.items():
        sums[rows[i][2]] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_rings_skip_comparisons_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (64, 4))
    x = (centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))).astype(np.int64)
    before, after = vector_codes.Balls(centres.astype(np.int64)), vector_codes.Balls((centres + rng.integers(-20, 20, centres.shape)).astype(np.int64))
    start, _ = before.nearest(x)
    entry, d = after.moved(x, start)
    full = vector_codes.squares(x, after.entries)
    assert (d == full.min(1)).all() and (entry == full.argmin(1)).all()
    assert after.compared < full.size / 8


def test_ties_go_to_the_lower_entry():
    entries = np.array([[0, 0], [4, 0], [0, 0], [2, 2]], np.int64)
    balls = vector_codes.Balls(entries)
    x = np.array([[2, 0], [0, 0], [1, 1], [2, 1]], np.int64)
    want = vector_codes.squares(x, entries).argmin(1)
    for start in range(4):
        entry, _ = balls.moved(x, np.full(4, start))
        assert (entry == want).all()


def test_odd_vectors(spark):
    v = [float(i % 5) for i in range(16)]
    rows = [(1, v, "a"), (1, v, None), (None, v, "a"), (2, None, "a"), (3, [float("nan")] * 16, "a"), (4, [None] * 16, "a"),
            (5, [1.0, 2.0], "b"), (6, [], None), (7, [3e38] * 16, "c"), (8, [float("inf")] + v[1:], "a")]
    got, _ = coded(spark, rows)
    assert sorted((r["id"] is None, r["id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 5), (False, 6), (False, 7), (True, 0)]
    by = {(r["id"], r["label"]): r for r in got}
    assert by[(5, "b")]["code"] is None and by[(5, "b")]["label_error"] is None and by[(6, None)]["code"] is None
    assert by[(1, "a")]["code"] == by[(1, None)]["code"] == by[(None, "a")]["code"] and by[(7, "c")]["error"] == 0
    assert coded(spark, [])[0] == []
    assert coded(spark, [(1, None, "a")])[0] == []


def test_codes_with_clashing_columns_and_hot_label(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype("float32").tolist()
    rows = [(i, v, "hot" if i % 3 else f"l{i}") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "code", "part", "entry", "n", "total", "error", "label_error", "n_rows")])
    plain, _ = coded(spark, rows)
    out, _ = vector_codes.compress(clash, Tables(spark, "t11c"))
    out = vector_codes.with_label_errors(out, Tables(spark, "t11d")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, plain))


# ---- mixing

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, want = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = {s: (want - sum(fixed.values())) * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def mix(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = source_mixing.plan_mix(df, Tables(spark, "t12"), **options)
    return source_mixing.each_row(plan).withColumn("taken", F.col("size") * F.col("copies")).collect()


def corpus(n, seed=0, sources=("b", "a", "z", None, "é", "hot", "hot", "hot", "hot")):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), rng.choice(sources)) for i in range(n)]


def checked(rows, got):
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        words = len((text or "").split())
        sizes[source] += words
        largest[source] = max(largest[source], words)
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["copies"] in (int(ratio := want[r["source"]] / max(1, sizes[r["source"]])), int(ratio) + 1) or not r["size"]
        assert r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, (s, taken[s], want[s])
    assert len(got) == len(rows)


def test_mix_meets_its_targets(spark):
    rows = corpus(5000)
    got = mix(spark, rows)
    checked(rows, got)
    assert sorted(map(tuple, mix(spark, rows[::-1]))) == sorted(map(tuple, got))


def test_probabilities_are_kept_on_average(spark):
    items = spark.range(200).select(F.col("id").alias("run")).join(spark.range(80).select(F.col("id").alias("i"))).select(
        "run", F.lit(80).alias("n"), F.struct(F.xxhash64("run", "i").alias("h"), "i", (1.0 + F.col("i") % 7).alias("s"),
                                              F.when(F.col("i") % 2 == 0, 0.25).otherwise(0.6).alias("p")).alias("item"))
    out = source_mixing.round_copies(items, Tables(spark, "t12p"), "run", "seed").select("run", "item.i", "item.s", "item.p").collect()
    assert len(out) == 200 * 80 and {r["p"] for r in out} == {0.0, 1.0}
    for want, odd in ((0.25, 0), (0.6, 1)):
        assert np.mean([r["p"] for r in out if r["i"] % 2 == odd]) == pytest.approx(want, abs=0.02)
    words = Counter()
    for r in out:
        words[r["run"]] += r["s"] * r["p"]
    aim = sum((1.0 + i % 7) * (0.6 if i % 2 else 0.25) for i in range(80))
    assert all(abs(w - aim) <= 7 for w in words.values())


def test_pivot_moves_mass_until_one_is_decided(spark):
    rng = random.Random(1)
    pairs = [(i, rng.randrange(1, 50) * 1.0, rng.random(), i + 10000, rng.randrange(1, 50) * 1.0, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(pairs, "h long, s double, p double, h2 long, s2 double, p2 double")
    t = source_mixing.pivot(F.struct("h", "s", "p"), F.struct(F.col("h2").alias("h"), F.col("s2").alias("s"), F.col("p2").alias("p")), "x")
    moved = 0.0
    for r in df.withColumn("t", t).collect():
        done, left = r["t"]["done"], r["t"]["left"]
        assert done["p"] in (0.0, 1.0) and 0 <= left["p"] <= 1 and {done["h"], left["h"]} == {r["h"], r["h2"]}
        assert done["s"] * done["p"] + left["s"] * left["p"] == pytest.approx(r["s"] * r["p"] + r["s2"] * r["p2"])
        moved += (done if done["h"] == r["h"] else left)["p"] - r["p"]
    assert abs(moved / len(pairs)) < 0.03


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "x y", "b"), (4, "x y", "b"), (4, "z", "b"), (None, "q", "b"),
            (5, "w " * 300_000, "c"), (6, "one", None), (7, "one", "d\u000bd"), (8, "  é\x0b", "\U00010000"), (9, "a", "￿")]
    got = mix(spark, rows)
    checked([(i, (t or "").replace(" ", "x"), s) for i, t, s in rows], got)
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    assert mix(spark, []) == [] and [r["taken"] for r in mix(spark, [(1, None, None)])] == [0]
    many = [(1, "same words here", "a")] * 1000 + corpus(300, 2)
    assert len(mix(spark, many)) == 1300


def test_mixed_documents_come_as_often_as_planned(spark):
    rows = corpus(400, 3) + [(0, "x", "b")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("extra")).withColumn("copies", F.lit(1))
    plan = Tables(spark, "t12m").write("plan", source_mixing.plan_mix(df, Tables(spark, "t12n")))
    out = source_mixing.mixed(df, plan)
    assert out.columns == df.columns
    want = Counter()
    for r in source_mixing.each_row(plan).collect():
        want[r["id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_mix_runs_without_python_workers(spark, sf_dir):
    plan = source_mixing.op12_source_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---- alignment

def plain_alignment(texts):
    """The contract's columns by its words, over whole texts."""
    t = token_alignment.pair()
    rows = []
    for text in texts:
        full = (" " + text).encode() if text else b""
        a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        if b"".join(t.bytes_a[i] for i in a) != full or b"".join(t.bytes_b[i] for i in b) != full:
            a, b = [], []
        ends = [set(np.cumsum([len(of[j]) for j in ids]).tolist()) for ids, of in ((a, t.bytes_a), (b, t.bytes_b))]
        cuts = sorted(ends[0] & ends[1])
        groups, links = [([], []) for _ in cuts], []
        last = {}
        for side, (ids, of) in enumerate(((a, t.bytes_a), (b, t.bytes_b))):
            end = 0
            for i in ids:
                end += len(of[i])
                groups[bisect.bisect_left(cuts, end)][side].append(i)
                last.setdefault(end, {})[side] = i
        links = [(x[0], x[1]) for x in last.values() if len(x) == 2]
        rows.append((a, b, groups, links))
    count = Counter(x for r in rows for x in r[3])
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for a, b, groups, links in rows:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), digest, sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def aligned(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    found, _ = token_alignment.align_documents(df, Tables(spark, "t13"))
    return {r["id"]: tuple(r[c] for c in NAMES) for r in found.collect()}


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    bits = ["hello", "Wörter", "прив", "日本語", " ", "  ", "\n", "\t", " ", "　", "x", "'s", "don't", "3.14", "🙂", "<s>", "<|endoftext|>", "<0x41>",
            "é", "é", "...", "-", "ß ", " a", " ", "\x00", "\r\n", "ﬁ", "ÀÉ", "\u0085", "𝒳"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_alignment_equals_whole_text_encoding(spark, monkeypatch):
    texts = odd_texts(400) + ["", None, " ", "   ", "a", "a ", " a", "a▁b", "▁", "x" * 5000, "word " * 4000, "same text", "same text"]
    want = dict(enumerate(plain_alignment(texts)))
    assert aligned(spark, texts) == want
    assert want[len(texts) - 6][0] == 0 and sum(w[0] > 0 for w in want.values()) > 350
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", 20)  # most pairs take the shuffled way
    assert aligned(spark, texts) == want


def test_alignment_of_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, plain_alignment([r["text"] for r in rows]))}
    got = token_alignment.op13_token_alignment(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in got} == want and len(got) == len(rows)


def test_units_that_do_not_join_are_encoded_alone(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_alignment, "JOINED", 3)
    pair = token_alignment.pair()
    spelled = [b" a", b" \xe2\x96\x81", b" bc", b" x\xc2\xa0", b"   ", b" def", b" ", "  é".encode(), b" q"]
    units = token_alignment.Units(pair, pa.array(spelled, pa.large_binary()))
    for u, place in zip(spelled, units.place.tolist()):
        (a,), (b,) = pair.encode([u.decode()])
        same = pair.spell(0, a).tobytes() == pair.spell(1, b).tobytes() == u
        assert (units.n_a[place], units.n_b[place]) == ((len(a), len(b)) if same else (0, 0)) and units.good[place] == same
    # a joined run that one unit spoils is encoded again unit by unit
    bounds = np.array([0, 2, 6, 8])
    ids, sizes = pair.encode_units(np.frombuffer(b" a \xe2\x96\x81 b", np.uint8), bounds, 3)[0]
    assert sizes.tolist() == [1, 0, 1] and len(ids) == 2


def test_row_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 2, (rng.integers(1, 6), 7)), rng.integers(0, 2, (7, rng.integers(1, 6)))
        of = lambda m: token_alignment.Csr.of(*np.nonzero(m), *m.shape)
        row, column, value = of(a).times(of(b)).entries()
        dense = np.zeros((len(a), b.shape[1]), int)
        dense[row, column] = value
        assert (dense == a @ b).all()
        row, column, value = of(a).transposed().entries()
        dense = np.zeros(a.T.shape, int)
        dense[row, column] = value
        assert (dense == a.T).all()


def test_link_kinds():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randrange(1, 20)
        cuts = [sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in range(2)]
        spans = [list(zip([0, *c[:-1]], c)) for c in cuts]
        matrices, in_a, in_b = token_alignment.align(*(np.array([e - s for s, e in x]) for x in spans))
        common = sorted(set(cuts[0]) & set(cuts[1]))
        group = lambda e: next(i for i, c in enumerate(common) if e <= c)
        want = {"overlap": {}, "ends": {}, "group": {}}
        for i, (s, e) in enumerate(spans[0]):
            for j, (s2, e2) in enumerate(spans[1]):
                if (shared := min(e, e2) - max(s, s2)) > 0:
                    want["overlap"][i, j] = shared
                if e == e2:
                    want["ends"][i, j] = 1
                if group(e) == group(e2):
                    want["group"][i, j] = 1
        for kind, m in matrices.items():
            assert {(i, j): v for i, j, v in zip(*(x.tolist() for x in m.entries()))} == want[kind]


def test_token_links_table(spark):
    df = spark.createDataFrame([(1, "hello wörld"), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = token_alignment.token_links(df).collect()
    assert {r["id"] for r in rows} == {1} and sum(r["value"] for r in rows) == len(" hello wörld".encode())
    assert token_alignment.token_links(df, kind="group").count() >= token_alignment.token_links(df, kind="ends").count() > 0


def test_alignment_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], "doc_id long, text string")
    clash = df.select("*", *[F.lit(0).alias(c) for c in ("id", "row", "n_a", "pairs", "times", "pair", "n", "best")])
    found, _ = token_alignment.align_documents(clash, Tables(spark, "t13c"))
    assert sorted((r["id"] or 0, r["count_sum"]) for r in found.collect()) == [(0, 1), (1, 2), (1, 2)]
    found, _ = token_alignment.align_documents(df.limit(0), Tables(spark, "t13e"))
    assert found.collect() == []
    long = spark.createDataFrame([(1, "déjà vu " * 150_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    found, _ = token_alignment.align_documents(long, Tables(spark, "t13l"))
    assert {r["id"]: r["n_groups"] > 0 for r in found.collect()} == {1: True, 2: True}
