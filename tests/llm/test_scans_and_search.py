import random
import re

import numpy as np
import pytest
from brute import ALNUM, lower
from pyspark.sql import functions as F

from filingsift.llm import knn_join, license_scan, url_filter


def naive_patience(a, b):
    """Number of matched words, by the definition: unique common words, longest increasing part, gaps again."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not pairs:
        return n
    best = [(1, -1)] * len(pairs)
    for x in range(len(pairs)):
        for y in range(x):
            if pairs[y][1] < pairs[x][1] and best[y][0] + 1 > best[x][0]:
                best[x] = (best[y][0] + 1, y)
    x = max(range(len(pairs)), key=lambda x: best[x][0])
    kept = []
    while x >= 0:
        kept.append(pairs[x])
        x = best[x][1]
    i0 = j0 = 0
    for i, j in [*kept[::-1], (len(a), len(b))]:
        n += naive_patience(a[i0:i], b[j0:j])
        i0, j0 = i + 1, j + 1
    return n + len(kept)


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        got = [values[i] for i in license_scan.increasing(values)]
        best = [1] * len(values)
        for x in range(len(values)):
            best[x] = 1 + max([best[y] for y in range(x) if values[y] < values[x]], default=0)
        assert got == sorted(set(got)) and len(got) == max(best, default=0)


def test_alignment_matches_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def notices():
    rng = random.Random(3)
    filler = "the of and to in a or this license software terms any version public other words here now".split()
    rows = [(0, None), (1, ""), (2, "no license at all"), (3, "license " * 500)]
    for name, text in license_scan.TEMPLATES.items():
        words = text.split(" ")
        for lost in (0, 1, len(words) // 4):
            kept = list(words)
            for _ in range(lost):
                kept[rng.randrange(len(kept))] = "changed"
            before, after = (" ".join(rng.choice(filler) for _ in range(rng.randrange(120))) for _ in range(2))
            rows.append((len(rows), f"{before}.\n{' '.join(kept)}\n{after}"))
            rows.append((len(rows), f"{before}.\n{' '.join(kept).upper()}\n{' '.join(kept)} {after}"))
    return rows + rows[-3:]


def test_licenses_equal_naive_scan(spark):
    templates = {k: ALNUM.findall(lower(v)) for k, v in license_scan.TEMPLATES.items()}
    rows = notices()
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    found = 0
    for r in got:
        words, best = ALNUM.findall(lower(texts[r.doc_id])), None
        for name in sorted(templates):
            b = templates[name]
            for left, right in license_scan.windows(len(words), len(b)):
                n = naive_patience(words[left:right], b)
                if n / len(b) >= license_scan.COVERAGE - 1e-9 and (best is None or (n / len(b), len(b)) > best[:2]):
                    best = (n / len(b), len(b), name)
        assert (r.license, r.coverage) == ((best[2], best[0]) if best else (None, 0.0)), texts[r.doc_id]
        found += r.license is not None
    assert found > 20


def test_every_notice_kind_of_the_documents_is_found(spark, sf_dir):
    kinds = {"All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
             "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
        noticed = documents.filter(F.col("text").rlike(r"(?im)^.*(licen[sc]e|rights reserved|copyright).*$"))
        assert noticed.count() and license_scan.scan(noticed).filter("license is null").count() == 0
    rows = [(i, f"A page.\n{line}\nPage 2 of 2.") for i, line in enumerate(kinds)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.coverage) for r in got] == [(name, 1.0) for name in kinds.values()]


def test_common_license_texts_are_told_apart(spark):
    rows = [(name, f"Some words.\n{text}\nVersion 2 of 3 pages.") for name, text in license_scan.TEMPLATES.items()]
    got = {r.doc_id: (r.license, r.coverage) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: (name, 1.0) for name in license_scan.TEMPLATES}
    families = {"all-rights", "apache", "bsd-2", "bsd-3", "mit", "isc", "bsl", "epl", "mpl", "unlicense", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3",
                "agpl-3", "cc0", *(f"cc-{x}-4" for x in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"))}
    assert all(any(name.startswith(x) for name in license_scan.TEMPLATES) for x in families)


def test_every_license_of_a_text_is_returned(spark):
    t = license_scan.TEMPLATES
    filler = " ".join(f"word{i}" for i in range(400))
    damaged = t["gpl-2.0"].replace("work", "book")
    rows = [(0, f"{t['mit']} {filler} {t['gpl-3.0']}"), (1, f"{t['gpl-3.0']} {filler} {damaged} {filler} {t['gpl-3.0']}"),
            (2, t["cc-by-nc-4.0"]), (3, filler), (4, f"{t['mit-text']} All rights reserved. {t['apache-2.0-header']} {filler} {t['mit-text']}")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[x.license for x in r.licenses] for r in got] == [
        ["gpl-3.0", "mit"], ["gpl-3.0", "gpl-2.0"], ["cc-by-nc-4.0"], [], ["mit-text", "apache-2.0-header", "all-rights-reserved"]]
    assert [tuple(x) for x in got[0].licenses] == [("gpl-3.0", 1.0, 405, 416), ("mit", 1.0, 0, 4)]
    assert got[1].licenses[1].first_word == 412 and got[1].licenses[1].coverage == 11 / 12
    for r in got:
        assert (r.license, r.coverage, r.first_word, r.last_word) == (tuple(r.licenses[0]) if r.licenses else (None, 0.0, None, None))


def test_license_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string").withColumn("license", F.lit("old"))
    row = license_scan.scan(docs).first()
    assert (row.license, row.coverage, row.first_word, row.last_word) == ("mit", 1.0, 0, 4)
    assert license_scan.scan(docs.limit(0)).count() == 0


URLS = ["https://a.example.org/es/x", "http://EXAMPLE.ORG/en/12?q", "http://example.org", "http://notexample.org/es/", "https://x.com/de/",
        "http://x.com/en", "http://x.com/fr/1#t", "http://y.net/de/", "ftp://com/de/a", None, "", "no-scheme.org/x", "://org/x", "a://b://c/d",
        "http://user@h.org:80/p?x=/y", "http://ü.org/\nz", "http://x.com/de/", "http://z.net/é?", "http:///path"]


def judged(urls, rules):
    out = []
    for url in urls:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, rest = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
            host, path = lower(host), re.match(r"(?s)[^?#]*", rest)[0]
        fits = [(len(r), r, v) for r, v in rules
                if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
        _, rule, verdict = max(fits, default=(0, None, None))
        out.append((host, path, rule, verdict))
    listed = {h for h, _, _, v in out if v == "block"}
    return [(h, p, r, v or ("block" if h in listed else "allow")) for h, p, r, v in out]


def test_urls_equal_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, url_filter.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == judged(URLS, url_filter.RULES)
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(pages, []).filter("rule is not null or verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("shard_keys,block_bytes", [(1 << 18, 1 << 25), (300, 200)])
def test_cascade_is_exact(spark, shard_keys, block_bytes):
    keys = spark.range(5000).select(F.concat(F.lit("host"), "id").alias("k"))
    listed = spark.range(0, 9000, 3).select(F.concat(F.lit("host"), "id").alias("l")).union(spark.sql("select cast(null as string)"))
    cascade = url_filter.Cascade(keys.union(keys), listed, shard_keys, block_bytes)
    assert (len(cascade.blocks) > 1) == (block_bytes == 200)
    got = keys.withColumn("yes", cascade.contains(F.col("k")))
    assert got.filter(F.col("yes") != (F.substring("k", 5, 9).cast("long") % 3 == 0)).count() == 0
    nothing = url_filter.Cascade(keys, listed.limit(0))
    assert keys.filter(nothing.contains(F.col("k"))).count() == 0


def test_cascade_levels_shrink():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 62, 20000).astype(np.uint64) for _ in range(2))
    levels = url_filter.build_cascade(a, b, np.arange(20000) < 500)
    assert 2 < len(levels) < 40 and sum(len(t) for t, _ in levels) < 500 * 24


def neighbours(rows, k, scale=256):
    clean = {(i, tuple(int(np.floor(scale * float(c))) for c in v)) for i, v in rows
             if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q, x in clean:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in clean if i != q and len(y) == len(x))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(seed, n=300, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(5)] + 0.2 * rng.normal(size=dim))]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one vector with many copies
    rows += [(2000, None), (2005, [None] * dim), (2010, [float("nan")] * dim), (2015, [float("inf")] * dim), (None, rows[1][1]),
             (2020, [0.5, 0.5]), (2025, [0.25, 0.5]), (2030, [0.0] * dim), (2035, [0.0] * dim), (2040, []), (10, rows[10][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(knn_join, "QUERY_BLOCK", 7)
        monkeypatch.setattr(knn_join, "DATA_CHUNK", 40)
        monkeypatch.setattr(knn_join, "QUERIES_PER_PIVOT", 4)
    rows = vectors(1)
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = knn_join.top_k(table, lambda id: id % 5 == 0)
    assert {tuple(r) for r in got.collect()} == neighbours(rows, 5)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn_join.top_k(spark.createDataFrame([], schema), lambda id: id % 5 == 0).count() == 0
    assert knn_join.top_k(spark.createDataFrame([(0, [1.0])], schema), lambda id: id % 5 == 0).count() == 0
    got = knn_join.top_k(spark.createDataFrame([(0, [1.0]), (3, [-2.0])], schema), lambda id: id % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, -131072)]


def test_groups_far_away_get_no_copies():
    rng = np.random.default_rng(2)
    centres = np.array([[4000, 0, 0], [0, 4000, 0], [0, 0, 4000]])
    data = np.concatenate([c + rng.integers(-50, 50, (200, 3)) for c in centres])
    cells = knn_join.Cells(centres, float(np.square(data.astype(float)).sum(1).max()))
    cell, away = cells.nearest(data, True)
    near = [(c, d) for g in range(3) for c, d in sorted(zip(cell[cell == g], away[cell == g]), key=lambda x: x[1])[:6]]
    cells.bound(np.array([np.linalg.norm([10, 10, 10]), np.nan, np.nan]) + cells.nearest(centres, False)[1][0], near, 6)
    wanted = cells.wanted(data)
    assert not wanted[:, 1:].any() and wanted[:200, 0].all()
