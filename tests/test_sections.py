"""Sections, paragraphs and chunks against plain re-statements of the rules."""
import random
import re

import pytest
from pyspark.sql import functions as F

from filingsift.functions import text as tx
from filingsift.operators import dedup, sections


def extract(spark, *bodies):
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, html string")
    out = sections.extract_sections(docs.select("id"), docs, "id", "html").orderBy("id").collect()
    return out


BODY = "".join(f"<p>Sentence number {i} speaks of some risk.</p>" for i in range(60))
END = "<h2>Item 1B. Unresolved Staff Comments</h2>"


def test_plain_section(spark):
    row = extract(spark, f"<h1>Item 1A. Risk Factors</h1>{BODY}{END}<p>None</p>")[0]
    assert row["extraction_status"] == "candidate_needs_review" and row["word_count"] == 420
    assert row["section_text"].startswith("Sentence number 0") and row["start_line"] == 0 and row["end_line"] == 61


def test_title_over_three_lines_and_entities(spark):
    row = extract(spark, f"<p>ITEM&nbsp;1A</p><p>Risk</p><p>Factors:</p>{BODY}<p>Item 2</p><p>Properties</p>")[0]
    assert row["word_count"] == 420 and row["end_line"] == 63


@pytest.mark.parametrize("head", [
    "<p>Item 1A. Risk Factors</p><p>12</p>",                                     # page number follows
    "<p>Item 1A</p><p>Risk Factors</p><p>of our business</p><p>17-19</p><p>Item 1B</p><p>x</p>",  # contents entry
    "<p>Item 1A. Risk Factors" + " and much more prose that is not a title" * 2 + "</p>",
    "<p>Item 1A. Risk Factors</p><p>” under the sub-caption “Credit”</p>",
    "<p>see Item 1A. Risk Factors</p>",
])
def test_rejected_starts(spark, head):
    row = extract(spark, head + BODY + END)[0]
    assert row["extraction_status"] == "no_plausible_section" and row["candidate_count"] == 0


def test_missing_end_ambiguity_and_not_downloaded(spark):
    section = f"<h1>Item 1A. Risk Factors</h1>{BODY}{END}"
    rows = extract(spark, f"<h1>Item 1A. Risk Factors</h1>{BODY}", section + section, None)
    assert [r["extraction_status"] for r in rows] == ["no_plausible_section", "ambiguous_needs_review", "not_downloaded"]
    assert rows[1]["start_line"] == 0 and rows[1]["plausible_count"] == 2 and rows[2]["section_text"] == ""


def test_flags(spark):
    df = spark.createDataFrame([("", 3, 5000), ("x", 2, 5000), ("x", 1, 999), ("x", 1, 1000)],
                               "section_text string, plausible_count int, word_count int")
    assert [r[0] for r in df.select(sections.qa_flag()).collect()] == [
        "no_text", "multiple_candidates", "short_section", "manual_review_required"]


def test_context_and_diagnostics(spark):
    docs = spark.createDataFrame([(1, ["a", "See Item 1A", "b", "c", "d", "e"])], "id int, lines array<string>")
    got = sections.line_context(docs, ["id"]).orderBy("offset").collect()
    assert [(r["offset"], r["context_line"]) for r in got] == [(-1, "a"), (0, "See Item 1A"), (1, "b"), (2, "c"), (3, "d")]
    row = sections.heading_diagnostics(docs, ["id"]).first()
    assert (row["line_number"], row["previous_line"], row["next_line"]) == (1, "a", "b")


def test_paragraphs_renumber_after_filter(spark):
    long = "word " * 20
    docs = spark.createDataFrame([("f", f"{long}\n \n\nshort\n\n  {long}x")], "id string, t string")
    rows = sections.paragraphs(docs, "id", "t").orderBy("paragraph_number").collect()
    assert [(r["paragraph_id"], r["word_count"]) for r in rows] == [("f_p0001", 20), ("f_p0002", 21)]


def expected_chunks(text, target, most):
    """Straight statement of the chunking rules."""
    clean = " ".join(text.split())
    done, cur, size = [], [], 0
    for s in re.split(r"(?<=[.!?]) (?=[A-Z])", clean) if clean else []:
        n = len(s.split())
        if n > most or (cur and size + n > most):
            if cur:
                done.append(" ".join(cur))
            cur, size = [], 0
        if n > most:
            w = s.split()
            done += [" ".join(w[i:i + most]) for i in range(0, n, most)]
            continue
        cur, size = cur + [s], size + n
        if size >= target:
            done.append(" ".join(cur))
            cur, size = [], 0
    if cur:
        done.append(" ".join(cur))
    out = []
    for c in done:
        if out and len(c.split()) < 50:
            out[-1] += " " + c
        else:
            out.append(c)
    if len(out) > 1 and len(out[0].split()) < 50:
        out[:2] = [out[0] + " " + out[1]]
    return out


def test_chunks_match_the_rules_and_lose_nothing(spark):
    rng = random.Random(3)
    texts = ["", "One.", "x " * 700]
    for _ in range(60):
        sentences = []
        for _ in range(rng.randint(1, 60)):
            n = rng.choice([1, 3, 8, 20, 45, 70, 230, 500]) if rng.random() < 0.5 else rng.randint(1, 30)
            sentences.append("W" + " w" * (n - 1) + rng.choice([".", "!", "?", ""]))
        texts.append(rng.choice([" ", "\n", "  "]).join(sentences))
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = sections.chunks(docs, "id", "t").collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk_number"])):
        got[r["id"]].append(r["chunk_text"])
        assert r["chunk_id"] == f"{r['id']}_c{r['chunk_number']:04d}"
    assert got == {i: expected_chunks(t, 150, 220) for i, t in enumerate(texts)}
    report = dedup.conservation_report(docs, spark.createDataFrame(rows), "id", tx.word_count("t"), F.col("word_count")).first()
    assert report["words_lost"] == 0 and report["missing_keys"] == 1


def test_long_documents_are_read_whole(spark):
    text = "Alpha beta gamma. " * 30000 + "Last words here."
    docs = spark.createDataFrame([(1, text)], "id int, t string")
    rows = sections.chunks(docs, "id", "t").orderBy("chunk_number").collect()
    assert rows[-1]["chunk_text"].endswith("Last words here.") and sum(r["word_count"] for r in rows) == 90003
