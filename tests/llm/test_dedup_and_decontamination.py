import hashlib
import random

import numpy as np
import pytest
from brute import DOCS, hits, near_components, without_repeats
from pyspark.sql import functions as F

from filingsift.llm import components, decontaminate, near_dedup, substring_dedup
from filingsift.llm.tables import Tables

WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", "  \n\t ", "one", "two words", "é ü 日本 ß", "a" * 3000]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def corpus(seed, groups=6, copies=12):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(ODD * 2)]
    for _ in range(groups):
        base = prose(rng, rng.choice([30, 80, 300]))
        for _ in range(copies):
            rows.append((len(rows), changed(rng, base, rng.randrange(8))))
        rows.append((len(rows), base))
    rows += [(len(rows) + i, prose(rng, 60)) for i in range(10)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_near_duplicates_equal_all_pairs(spark, seed, percent):
    rows = corpus(seed)
    want = near_components(dict(rows), percent)
    got = near_dedup.near_duplicates(frame(spark, rows), Tables(spark, "t"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """A chain of copies, each a little different from the last, is one component and costs no pairs of all."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 16)
    rng = random.Random(3)
    text, rows = prose(rng, 200), []
    for i in range(120):
        rows.append((1000 - i, text))
        text = changed(rng, text, 2)
    want = near_components(dict(rows), 85)
    got = near_dedup.near_duplicates(frame(spark, rows), Tables(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_around_one_base(spark, monkeypatch, block):
    """Copies at every distance from one base text: few pairs are links, and buckets hold many components."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    rng = random.Random(12)
    base = prose(rng, 120)
    rows = [(i, changed(rng, base, rng.randrange(9))) for i in range(150)]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(frame(spark, rows), Tables(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(dict(rows), 85)


def test_near_duplicates_defined_cases(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (9, None), (8, ""), (7, "x"), (6, "X"), (None, "n u l l i d")]
    got = near_dedup.near_duplicates(frame(spark, rows), Tables(spark, "t")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == \
        [(-1, 2, -1), (3, 2, 3), (5, 2, 3), (5, 2, 3), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9)]
    assert near_dedup.near_duplicates(frame(spark, []), Tables(spark, "t")).count() == 0
    clashing = frame(spark, rows).withColumns({"n": F.lit(1), "id": F.lit(2), "component": F.lit("c"), "_gone": F.lit(0)})
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 6, 8, 9]


def test_min_max_values_agree_with_jaccard():
    import pyarrow as pa
    rng = random.Random(4)
    a = prose(rng, 400)
    values, first = near_dedup.shingle_sets(pa.array([a, changed(rng, a, 12)]))
    _, bands, _, _ = near_dedup.signatures(values, first)
    x, y = set(values[:first[1]].tolist()), set(values[first[1]:].tolist())
    share, jaccard = (bands[0] == bands[1]).mean(), len(x & y) / len(x | y)
    assert abs(share - jaccard ** 4) < 0.3


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 400), (400, 450)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"), Tables(spark, "t")).collect()
    assert {r.id: r.component for r in got} == {**{i: 0 for i in range(1, 301)}, 450: 400, 500: 400}
    assert components.components(spark.createDataFrame([], "u long, v long"), Tables(spark, "t")).count() == 0


def repeating(seed):
    rng = random.Random(seed)
    few = WORDS[:12]
    shared = [prose(rng, n) for n in (13, 20, 60)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for _ in range(40):
        parts = [prose(rng, rng.randrange(0, 40), rng.choice([few, WORDS])), rng.choice([*shared, ""]), prose(rng, rng.randrange(0, 20))]
        rows.append((len(rows), " ".join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (101, rows[21][1]), (102, " ".join(["same"] * 200)), (103, " ".join(["same"] * 90)),
             (None, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_FRAMES", 7)
    rows = repeating(seed)
    want = sorted((i or -1, len(w), len(w) - len(kept), " ".join(kept)) for i, kept, w in without_repeats(rows))
    got = substring_dedup.remove_repeats(frame(spark, rows), Tables(spark, "t")).collect()
    assert sorted((r.id or -1, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_repeats_defined_cases(spark):
    assert substring_dedup.remove_repeats(frame(spark, []), Tables(spark, "t")).count() == 0
    text = " ".join(WORDS[:20])
    docs = frame(spark, [(1, text), (2, "x  y\n" + text), (3, "left   alone\n")]).withColumns({"id": F.lit(0), "tid": F.lit(0), "kept": F.lit("k")})
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: text, 2: "x y", 3: "left   alone\n"}


def test_automaton_against_all_substrings():
    rng = random.Random(5)
    sequences = [([rng.choice("abc") for _ in range(rng.randrange(1, 30))], rng.randrange(100)) for _ in range(30)]
    automaton = substring_dedup.SuffixAutomaton()
    for words, owner in sequences:
        automaton.add(words, owner)
    automaton.finish()
    for words in [s for s, _ in sequences] + [list("abcabcaaab" * 3)]:
        want = [min([o for s, o in sequences if any(s[p:p + 4] == words[i:i + 4] for p in range(len(s) - 3))], default=substring_dedup._NONE)
                for i in range(len(words) - 3)]
        assert automaton.first_owners(words, 4) == want


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_hits_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n, WORDS[:60])) for i, n in enumerate([13, 40, 5, 2, 20, 0])] + [(7, None), (10, "Éa, w1! w2")]
    items.append((11, items[1][1]))
    rows = [(i, t) for i, t in enumerate(ODD)]
    for _ in range(30):
        inner = rng.choice(items)[1] or ""
        cut = inner.split(" ")[rng.randrange(3):]
        rows.append((len(rows), prose(rng, rng.randrange(50), WORDS[:80]) + ", " + " ".join(cut).upper() + "; " + prose(rng, rng.randrange(300))))
    rows.append(rows[-1])
    found = decontaminate.scan(frame(spark, rows), benchmark(spark, items)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        words, hit, names = hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.hit_items) == (len(words), len(hit), sorted(map(str, names)))


def test_blocks_of_the_benchmark_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, prose(rng, 20)) for i in range(12)]
    docs = frame(spark, [(i, prose(rng, 10) + " " + items[i % 12][1] + " " + items[(i * 5) % 12][1]) for i in range(30)])
    one = decontaminate.scan(docs, benchmark(spark, items)).orderBy("doc_id").collect()
    whole = decontaminate.phrase_blocks
    monkeypatch.setattr(decontaminate, "phrase_blocks", lambda b, item, text, window: whole(b, item, text, window, limit=100))
    assert decontaminate.scan(docs, benchmark(spark, items)).orderBy("doc_id").collect() == one


def test_decontamination_defined_cases(spark):
    rng = random.Random(8)
    item = prose(rng, 15)
    rows = [(1, None), (2, ""), (3, item), (4, "Before " + item + " " + prose(rng, 400)), (5, "clean  text\n"), (None, item)]
    docs = frame(spark, rows).withColumns({"n_hit": F.lit(7), "n_words": F.lit(0), "hit_spans": F.lit("x"), "row": F.lit(1)})
    kept = decontaminate.decontaminate(docs, benchmark(spark, [(1, item)]))
    assert kept.columns == docs.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == {1, 2, 4, 5} and got[5] == "clean  text\n" and got[1] is None
    assert got[4] == rows[3][1].replace(item, "")
    empty = benchmark(spark, [])
    assert decontaminate.decontaminate(docs, empty).count() == 6
    assert decontaminate.scan(frame(spark, []), benchmark(spark, [(1, item)])).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(9)
    runs = [rng.integers(0, 3, n) for n in (40, 1, 17, 60)]
    codes, starts = np.concatenate(runs), np.cumsum([0, 40, 1, 17])
    index = decontaminate.FmIndex(codes, starts, 3)
    phrases = np.array([[a, b, c] for a in range(3) for b in range(3) for c in range(3)])
    low, high = index.search(phrases)
    for phrase, l, h in zip(phrases.tolist(), low, high):
        want = [s + p for s, run in zip(starts, runs) for p in range(len(run) - 2) if run[p:p + 3].tolist() == phrase]
        assert sorted(index.locate(np.arange(l, h)).tolist()) == want


def test_query_digests(spark, sf_dir):
    row = decontaminate.op3_benchmark_decontamination(spark, sf_dir).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated


def test_copies_of_a_passage_are_not_cut_per_window(spark, monkeypatch):
    """However many documents hold the same passage, its inside is one run of windows for each anchor."""
    monkeypatch.setattr(substring_dedup, "HOT", 30)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(20)) + " " + passage + " " + " ".join(f"v{i}_{j}" for j in range(20))) for i in range(40)]
    frames, cut = [], substring_dedup.Tables.write

    def seen(self, name, table):
        out = cut(self, name, table)
        if name == "frames":
            frames.append(out.count())
        return out
    monkeypatch.setattr(substring_dedup.Tables, "write", seen)
    out = {r["id"]: r["kept"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Tables(spark, "t10copies")).collect()}
    assert out == {i: t if i == 0 else t.replace(passage + " ", "") for i, t in rows}
    # fewer than the 48 windows inside the passage
    assert frames[0] < 40 * 40


def test_an_anchor_of_many_windows_is_cut_per_window(spark, monkeypatch):
    """A few long documents whose windows share an anchor: no name holds more frames than the bound."""
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 40)
    rng = random.Random(7)
    rows = [(i, " ".join(w for _ in range(60) for w in ("common", "four", "word", "run", *(rng.choice("abc") for _ in range(4))))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frames, cut = [], substring_dedup.Tables.write

    def seen(self, name, table):
        out = cut(self, name, table)
        if name == "frames":
            frames.append(out.groupBy("name").agg(F.sum(F.size(F.split(F.decode("frame", "UTF-8"), " ")) - 12).alias("windows")).agg(F.max("windows")).first()[0])
        return out
    monkeypatch.setattr(substring_dedup.Tables, "write", seen)
    out = {r["id"]: r["kept"] for r in substring_dedup.remove_repeats(df, Tables(spark, "t10hot")).collect()}
    assert 0 < frames[0] <= 40
    first = {}
    for i, text in rows:
        words, gone = text.split(), set()
        for j in range(len(words) - 12):
            if first.setdefault(tuple(words[j:j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        assert out[i] == " ".join(w for j, w in enumerate(words) if j not in gone)


def test_frames_are_combined_before_they_are_sent_and_sent_once(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    from filingsift.llm import substring_dedup as S
    from filingsift.llm.tables import Tables
    rng = np.random.default_rng(2)
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(rng.integers(0, 99, 500)), "name": pa.array(rng.integers(0, 3, 500)), "code": pa.array(rng.integers(0, 4, 500)),
                                           "frame": pa.array([b"x" * int(n) for n in rng.integers(1, 4, 500)], pa.binary())}) for _ in range(5)]
    want = {}
    for b in batches:
        for r in b.to_pylist():
            key = (r["name"], r["code"], r["frame"])
            want[key] = min(want.get(key, 99), r["id"])
    rows = [r for b in S._combined(batches) for r in b.to_pylist()]
    assert len(rows) == len(want) and {(r["name"], r["code"], r["frame"]): r["first"] for r in rows} == want
    assert not list(S._combined([]))

    plans = {}

    class Seen(Tables):
        def write(self, name, df):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().write(name, df)
    docs = spark.createDataFrame([(i, " ".join(str(w % 50) for w in range(i, i + 40))) for i in range(60)], "doc_id long, text string")
    assert S.remove_repeats(docs, Seen(spark, "sentonce")).count() == 60
    assert plans["firsts"].count("Exchange") == 1
