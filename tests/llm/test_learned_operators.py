import random

import numpy as np
import pyarrow as pa
import pytest
from brute import DOCS
from pyspark.sql import functions as F

from filingsift.llm import html_extraction, language_id, piece_sampling, toxicity

EN = "the ship sailed out of the harbour with the tide and nobody on the quay saw where it went that night".split()
DE = "das schiff fuhr mit der flut aus dem hafen und niemand am kai sah wohin es in jener nacht ging".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else DE, 20), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    profiles = language_id.learn(docs(spark, rows))
    odd = [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "12 34 !?", "de", "s", 0), (103, "日本語の文章です。" * 9, "en", "s", 0),
           (104, prose(rng, EN, 4000), None, "s", 0), (104, "THE SHIP ON THE QUAY", "de", "s", 0)]
    test = docs(spark, odd).withColumns({"score": F.lit("x"), "lang_pred": F.lit("x"), "row": F.lit(1)})
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify(test, profiles).collect()}
    assert {k for k in got if k[0] != 103} == {(100, "und"), (101, "und"), (102, "und"), (104, "en")}
    assert got[100, "und"] == 0 and all(0 <= s <= 1 for s in got.values())
    kept = language_id.accepted(test, profiles)
    assert kept.columns == test.columns and sorted(r.doc_id for r in kept.collect()) == [104, 104]


def test_languages_without_any_to_learn(spark):
    none = docs(spark, [(1, "some text", None, "s", 0)])
    assert [tuple(r)[1:] for r in language_id.identify(none, language_id.learn(none), ["doc_id"]).drop("text").collect()] == [("und", 0.0)]
    assert language_id.identify(none.limit(0), language_id.learn(none)).count() == 0


def test_text_vectors_equal_the_definition():
    text = "ab, Ca"
    letters = {c: language_id.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in "abc "}
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in [" ab", "ab ", "b c", " ca", "ca "])
    got = language_id.text_vectors(pa.array(["zz", text, None, "q"]))
    assert (got[1] == want).all() and not got[2].any()


def test_language_scores_do_not_depend_on_order_or_cut(spark):
    rng = random.Random(4)
    texts = ["q", "", None, "12", " é!", "The ship", "x", "...das Boot", "B", prose(rng, DE, 30), "-a-", "ß"]
    vectors = {t: language_id.text_vectors(pa.array([t], pa.string()))[0] for t in texts}
    assert [t for t in texts if not vectors[t].any()] == ["", None, "12"]
    for _ in range(60):
        order = rng.sample(texts, len(texts))
        cuts = [0, *sorted(rng.sample(range(1, len(order)), rng.randrange(4))), len(order)]
        for a, b in zip(cuts, cuts[1:]):
            got = language_id.text_vectors(pa.array(order[a:b], pa.string()))
            assert all((row == vectors[t]).all() for row, t in zip(got, order[a:b]))
    profiles = language_id.learn(docs(spark, [(i, prose(rng, EN if i % 2 else DE, 20), "en" if i % 2 else "de", "s", 0) for i in range(60)]))
    test = docs(spark, [(i, t, None, "s", 0) for i, t in enumerate(texts)])
    answers = [sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in language_id.identify(rows, profiles).collect())
               for rows in (test.coalesce(1), test.repartition(len(texts), "doc_id"), test.coalesce(1).orderBy(F.desc("doc_id")))]
    assert answers[0] == answers[1] == answers[2] and [r[0] for r in answers[0] if r[1] == "und"] == [1, 2, 3]
    assert {r.doc_id for r in language_id.accepted(test.coalesce(1), profiles).collect()} >= {0, 4, 6}


def test_language_query_on_held_out_texts(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = language_id.op4_language_id(spark, sf_dir).join(truth, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == truth.count() and len(held) > 20
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def roc_auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.asarray(scores)[order]
    ranks[order] = [(np.searchsorted(values, v, "left") + np.searchsorted(values, v, "right") + 1) / 2 for v in values]
    y = np.asarray(labels, bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_query_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op6_toxicity(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = got.join(truth, "doc_id").filter("held_out").collect()
    assert roc_auc([r.score for r in held], [r.toxic for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def mentions(spark):
    """Toxic texts happen to mention one group more often than harmless ones do."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(EN) for _ in range(12)] + (["idiot"] if toxic and i % 8 else [])
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")
        if rng.random() < 0.2:
            words.append("christian")
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_reduce_the_score_of_neutral_mentions(spark):
    texts, labels = mentions(spark)
    neutral = pa.array(["a muslim on the quay", "a christian on the quay", "a hindu on the quay", "an idiot on the quay"])
    plain = toxicity.learn(texts, labels, fairness=0.0).score(neutral)
    fair = toxicity.learn(texts, labels).score(neutral)
    assert fair[:3].max() - fair[:3].min() < 0.25 * (plain[:3].max() - plain[:3].min())
    assert fair[0] < plain[0] and fair[3] > fair[0]


def test_toxicity_defined_cases(spark):
    texts, labels = mentions(spark)
    odd = docs(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]).withColumn("score", F.lit("x"))
    model = toxicity.learn(texts, labels.unionByName(labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))))
    got = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(got) == 3 and len(set(got)) == 1
    for only, want in ((labels.filter("toxic = 1"), 1), (labels.filter("toxic = 0"), 0), (labels.limit(0), 0)):
        score = toxicity.score(odd, toxicity.learn(texts, only)).first().score
        assert abs(score - want) < 1e-6


def test_swap_stays_in_a_list():
    assert toxicity.swap("Women met a Muslim; blackboard") == "men met a jewish; blackboard"


@pytest.fixture(scope="module")
def vocab():
    return piece_sampling.vocabulary()


ODD = [None, "", " ", "  a  b ", "the cat\nsat\t!", "▁mark▁", "日本語 😀 \x00", "é" * 40, "x" * 2000, " " * 50, "naïve\u00a0space"]


def test_pieces_decode_to_the_text(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 2)] + [(None, "no key")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pieces", F.lit(1))
    coded = piece_sampling.encode(table)
    assert coded.filter("not lossless").count() == 0
    back = {r.doc_id: r.text for r in piece_sampling.decode(coded.drop("text")).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert piece_sampling.encode(table.limit(0)).count() == 0


def test_samples_depend_on_key_and_seed_alone(spark, monkeypatch):
    table = spark.createDataFrame([(i, "an unpredictable segmentation of several longer words " * 3) for i in range(40)], "doc_id long, text string")
    one = {r.doc_id: r.pieces for r in piece_sampling.encode(table.repartition(7)).collect()}
    monkeypatch.setattr(piece_sampling, "BLOCK_BYTES", 300)
    monkeypatch.setattr(piece_sampling, "PART_CHARS", 20)
    two = {r.doc_id: r.pieces for r in piece_sampling.encode(table.coalesce(1)).collect()}
    assert one == two and len({tuple(p) for p in one.values()}) > 30
    assert {r.doc_id: r.pieces for r in piece_sampling.encode(table, seed=3).collect()} != one


def all_ways(word, vocab, sharpness):
    """Probability of every segmentation of a word into pieces, by enumeration."""
    piece = {vocab.bytes[i].decode(): i for i in vocab.ids}
    ways = {}

    def extend(at, ids, weight):
        if at == len(word):
            ways[tuple(ids)] = weight
        for end in range(at + 1, min(len(word), at + vocab.longest) + 1):
            i = piece.get(word[at:end])
            if i is not None:
                extend(end, [*ids, i], weight * np.exp(sharpness * vocab.log[i]))

    extend(0, [], 1.0)
    total = sum(ways.values())
    return {k: v / total for k, v in ways.items()}


@pytest.mark.parametrize("word,sharpness", [("thing", 0.5), ("other", 1.0)])
def test_samples_follow_the_exact_distribution(vocab, word, sharpness):
    n = 20000
    ids, first = piece_sampling.encode_block(pa.array([word] * n), np.arange(n, dtype=np.uint64) * np.uint64(7919), vocab, sharpness)
    counts = {}
    for a, b in zip(first[:-1], first[1:]):
        key = tuple(ids[a:b].tolist())
        counts[key] = counts.get(key, 0) + 1
    want = all_ways(" " + word, vocab, sharpness)
    assert set(counts) <= set(want)
    for key, p in want.items():
        assert abs(counts.get(key, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy &amp; save now.</div>
<article><h1>A &lt;title&gt;</h1><p><b>Bold</b> text,<br>second   line &copy; here.<p>Unclosed &amp paragraph with x < y.<blockquote>Quoted
words.</blockquote><script>no()</script></article><footer>&copy; site &middot; Some words.</footer>"""


@pytest.fixture(scope="module")
def field(spark):
    return html_extraction.learn(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_main_text_of_a_page(spark, field):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<<<"), (5, "u", PAGE[:-900]), (1, "u", PAGE)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = [(r.page_id, r.text) for r in html_extraction.extract(table, field).collect()]
    want = "A <title>\nBold text, second line © here.\nUnclosed & paragraph with x < y.\nQuoted words."
    assert got[0] == (1, want) and got[-1] == (1, want) and got[1] == (2, "") and got[2] == (3, "")
    assert html_extraction.extract(table.limit(0), field).count() == 0


@pytest.mark.parametrize("layout", range(len(html_extraction.WRITTEN)))
def test_written_layouts(field, layout):
    blocks = html_extraction.read_blocks(html_extraction.WRITTEN[layout])
    main = [t.startswith("+") for t in blocks.texts]
    blocks.texts = [t.lstrip("+-") or "x" for t in blocks.texts]
    codes, first = html_extraction.coded(html_extraction.features(blocks))
    got = field.viterbi(field.scores(codes, first), np.array([0, len(main)]))
    assert np.mean(got == np.array(main)) > 0.9


@pytest.mark.parametrize("html,want", [
    ('<p class="x>Hello', ["Hello"]), ("<p title=it's>Hello</p>", ["Hello"]), ("<p <b>x", ["x"]), ('<p title="a > b">x', ["x"]),
    ("<p>Energy <math><mi>E</mi>=<mi>mc</mi></math> is</p>", ["Energy E=mc is"]), ("a<button>Share</button>b", ["a b"]), ("<button>x", ["x"]),
    ("<xmp><b>x</b> &amp; y</xmp>z", ["<b>x</b> &amp; y", "z"]), ("<p>a <svg><title>i</title><text>label</text></svg>", ["a label"]),
    ("<noscript>Enable scripts</noscript>ok", ["ok"]), ("<!-->a<!-- x --!>b", ["ab"]), ("<a href=/a/>link</a> t", ["link t"]),
    ("<script>var a = '</p>';</script >x", ["x"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<p>a<div>b</p>c", ["a", "b", "c"])])
def test_markup_is_read_as_a_browser_reads_it(html, want):
    assert html_extraction.read_blocks(html).texts == want


@pytest.mark.parametrize("piece", ["<b>x<p>y</p>", "<b></i>", "<button>x", "<zz%d>q", "<p title='>a", "<div><p><i>", "<li><a>x"])
def test_long_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        html = "".join(piece % i if "%" in piece else piece for i in range(n))
        start = time.perf_counter()
        html_extraction.read_blocks(html)
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(160000) < 40 * seconds(10000) + 1  # a quadratic reader takes 256 times


def test_every_feature_has_its_own_place():
    assert len(html_extraction._PLACE) == len(html_extraction._names())
    blocks = html_extraction.read_blocks(PAGE + "<unknown class='comments ad'><section class=sidebar>Some · text</section>")
    assert len(html_extraction.coded(html_extraction.features(blocks))[1]) == len(blocks.texts) + 1


def test_a_page_of_a_million_characters(spark, field):
    html = "<nav><a>Menu</a></nav><article><h1>Title</h1><p>" + "word " * 300000 + "</p></article>"
    got = html_extraction.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), field).first()
    assert got.text == "Title\n" + ("word " * 300000).strip()


def test_held_out_pages(spark):
    """Trained without every fifth page, the field finds the articles of those."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = F.pmod(F.xxhash64("html"), F.lit(5)) == 0
    field = html_extraction.learn(pages.filter(~held))
    rows = pages.filter(held).collect()
    found = {r.page_id: r.text for r in html_extraction.extract(pages.filter(held), field, ("page_id",)).collect()}
    right = 0
    for r in rows:
        blocks = html_extraction.read_blocks(r.html)
        right += found[r.page_id] == "\n".join(t for t, x in zip(blocks.texts, blocks.traits) if "in:article" in x)
    assert len(rows) > 20 and right >= 0.95 * len(rows)


def test_pages_of_the_corpus(spark):
    """The article's blocks of given pages, found by another parser."""
    import re
    from html import unescape
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.open, self.parts, self.out = 0, [], []

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.out += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.open += tag == "article"
            if tag == "br":
                self.parts.append(" ")
            elif tag in html_extraction.BLOCK_TAGS:
                self.cut()

        def handle_endtag(self, tag):
            if tag in html_extraction.BLOCK_TAGS:
                self.cut()
            self.open -= tag == "article"

        def handle_data(self, data):
            if self.open:
                self.parts.append(data)

        def handle_entityref(self, name):
            self.handle_data(f"&{name};")

        def handle_charref(self, name):
            self.handle_data(unescape(f"&#{name};"))

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_extraction.op8_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    same = 0
    for r in rows:
        parser = Article()
        parser.feed(re.sub(r"&amp;?|&quot;?", lambda m: {"a": "&#38;", "q": "&#34;"}[m[0][1]], r.html))
        parser.close()
        parser.cut()
        same += "\n".join(parser.out) == got[r.page_id]
    assert same >= 0.95 * len(rows)


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product
    rng = np.random.default_rng(1)
    field = html_extraction.Field()
    field.pair, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores, pages = rng.normal(size=(11, 2)), np.array([0, 5, 5, 6, 11])
    got = field.viterbi(scores, pages)
    for a, b in zip(pages[:-1], pages[1:]):
        if b > a:
            weight = {y: field.start[y[0]] + sum(scores[a + i, v] for i, v in enumerate(y)) + sum(field.pair[u, v] for u, v in zip(y, y[1:]))
                      for y in product((0, 1), repeat=b - a)}
            assert tuple(got[a:b].tolist()) == max(weight, key=weight.get)
