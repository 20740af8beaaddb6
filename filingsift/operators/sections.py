"""Find sections in raw documents and cut them into pieces.

A document is one row from raw content to its candidates: lines, headings and candidates live in
array columns, so none of these steps shuffles. Tables of lines or pieces come out by explode.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions import text as tx
from filingsift.functions.keys import unroll

# The headings that open and close a section, and what disqualifies them.
START_LINE = r"(?i)^item\s*1\s*a\s*[.\-:–—]?\s*(.*)$"
END_LINE = r"(?i)^item\s*(?:1\s*b|2)\s*[.\-:–—]?\s*(.*)$"
START_TITLES = ["riskfactors"]
END_TITLES = ["unresolvedstaffcomments", "properties"]
PAGE_NUMBER = r"^\d{1,4}(?:\s*[-–—]\s*\d{1,4})?$"
NEXT_ITEM = r"(?i)^item\s*(?:1\s*b|2)\b"
SUB_CAPTION = r'^["”] under the sub-caption'
LONGEST_REMAINDER = 55
REFERENCE_LINE = r"(?i)\bitem\s*1\s*[.\-]?\s*a\b"
ITEM_LINE = r"(?i)\bitem\s*1\s*a\b|\bitem\s*1\s*b\b|\bitem\s*2\b"


def document_lines(content) -> Column:
    """Clean, non-empty lines of a markup document in order; scripts and styles are dropped."""
    c = F.col(content) if isinstance(content, str) else content
    bare = F.regexp_replace(F.regexp_replace(c, tx.COMMENT, "\n"), tx.UNSEEN_ELEMENT, "\n")
    text = tx.decode_entities(F.regexp_replace(bare, tx.TAG, "\n"))
    lines = F.transform(F.split(text, tx.LINE_BREAK), lambda s: tx.collapse(s))
    return F.filter(lines, lambda s: s != "")


def line_table(docs: DataFrame, id_col, lines="lines") -> DataFrame:
    return unroll(docs, [id_col], F.col(lines), "line", "line_no")


def _letters(c) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def _indices(lines) -> Column:
    n = F.size(lines)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _headings(lines, pattern, titles, reject_caption) -> Column:
    """(line, body_start) of every line that opens a title spread over at most three lines."""
    def body_start(i):
        rest = F.trim(F.regexp_extract(F.get(lines, i), pattern, 1))
        one = _letters(rest)
        two = F.concat(one, _letters(F.get(lines, i + 1)))
        three = F.concat(two, _letters(F.get(lines, i + 2)))
        return (F.when(F.length(rest) > LONGEST_REMAINDER, None).when(one.isin(titles), i + 1)
                .when(two.isin(titles), i + 2).when(three.isin(titles), i + 3))

    def follows(found):
        after = F.coalesce(F.get(lines, found["body_start"]), F.lit(""))
        bad = after.rlike(PAGE_NUMBER)
        if reject_caption:
            bad = bad | after.rlike(SUB_CAPTION)
        return found["body_start"].isNotNull() & ~bad
    hits = F.filter(_indices(lines), lambda i: F.get(lines, i).rlike(pattern))
    return F.filter(F.transform(hits, lambda i: F.struct(i.alias("line"), body_start(i).alias("body_start"))), follows)


def with_headings(docs: DataFrame, lines="lines") -> DataFrame:
    """Add ``starts`` and ``ends``: arrays of (line, body_start)."""
    c = F.col(lines)
    return docs.withColumns({"starts": _headings(c, START_LINE, START_TITLES, True),
                             "ends": _headings(c, END_LINE, END_TITLES, False)})


def _in_contents(lines, body_start) -> Column:
    """A page number among the next three lines and another item heading among the next six."""
    page = F.exists(F.slice(lines, body_start + 1, 3), lambda s: s.rlike(PAGE_NUMBER))
    item = F.exists(F.slice(lines, body_start + 1, 6), lambda s: s.rlike(NEXT_ITEM))
    return page & item


def reject_contents(docs: DataFrame, lines="lines") -> DataFrame:
    """Drop start headings that belong to a table of contents."""
    c = F.col(lines)
    return docs.withColumn("starts", F.filter("starts", lambda s: ~_in_contents(c, s["body_start"])))


def heading_table(docs: DataFrame, id_col) -> DataFrame:
    kinds = F.concat(
        F.transform("starts", lambda s: F.struct(F.lit("start").alias("kind"), s["line"].alias("line"),
                                                 s["body_start"].alias("body_start"))),
        F.transform("ends", lambda s: F.struct(F.lit("end").alias("kind"), s["line"].alias("line"),
                                               s["body_start"].alias("body_start"))))
    return unroll(docs, [id_col], kinds, "h").select(id_col, "h.*")


def with_candidates(docs: DataFrame, lines="lines") -> DataFrame:
    """Pair every start with the first end after it; the text between is a candidate."""
    c = F.col(lines)
    pairs = F.transform("starts", lambda s: F.struct(
        s["line"].alias("start_line"), s["body_start"].alias("body_start"),
        F.array_min(F.transform(F.filter("ends", lambda e: e["line"] > s["line"]), lambda e: e["line"])).alias("end_line")))
    kept = F.filter(pairs, lambda p: p["end_line"] > p["body_start"])
    texts = F.transform(kept, lambda p: F.struct(
        F.array_join(F.slice(c, p["body_start"] + 1, p["end_line"] - p["body_start"]), "\n").alias("text"),
        p["start_line"].alias("start_line"), p["end_line"].alias("end_line")))
    counted = F.transform(texts, lambda t: F.struct(
        t["text"].alias("text"), tx.word_count(t["text"]).alias("word_count"), t["start_line"].alias("start_line"),
        t["end_line"].alias("end_line"), F.lit("risk_factors_heading").alias("heading_evidence")))
    return docs.withColumn("candidates", counted)


def candidate_table(docs: DataFrame, id_cols) -> DataFrame:
    return (unroll(docs, id_cols, F.col("candidates"), "c", "_p")
            .select(*id_cols, (F.col("_p") + 1).alias("candidate_number"), "c.*"))


def choose_section(docs: DataFrame, content=None, least=200, most=100000) -> DataFrame:
    """The longest plausible candidate (the earlier one on a tie) and the extraction status.

    A document whose ``content`` is null was not downloaded.
    """
    plausible = F.filter("candidates", lambda c: c["word_count"].between(least, most))
    best = F.array_max(F.transform(F.col("_plausible"), lambda c: F.struct(
        c["word_count"].alias("word_count"), (-c["start_line"]).alias("neg"), c["end_line"].alias("end_line"),
        c["text"].alias("text"))))
    status = (F.when(F.size("_plausible") == 0, "no_plausible_section")
              .when(F.size("_plausible") > 1, "ambiguous_needs_review").otherwise("candidate_needs_review"))
    if content is not None:
        status = F.when(F.col(content).isNull(), "not_downloaded").otherwise(status)
    empty = F.array().cast("array<struct<text:string,word_count:int,start_line:int,end_line:int,heading_evidence:string>>")
    return (docs.withColumn("candidates", F.coalesce("candidates", empty))
            .withColumn("_plausible", plausible).withColumn("_best", best)
            .withColumns({
                "extraction_status": status, "candidate_count": F.size("candidates"),
                "plausible_count": F.size("_plausible"),
                "word_count": F.coalesce("_best.word_count", F.lit(0)), "start_line": -F.col("_best.neg"),
                "end_line": F.col("_best.end_line"), "section_text": F.coalesce("_best.text", F.lit(""))})
            .drop("_plausible", "_best"))


def extract_sections(metadata: DataFrame, raw: DataFrame, id_col, content) -> DataFrame:
    """One extraction result per filing; a filing without a raw document was not downloaded.

    Extraction happens where the raw document is read; only its results meet the metadata, never the markup.
    """
    lined = raw.select(id_col, content).withColumn("lines", document_lines(content))
    chosen = choose_section(with_candidates(reject_contents(with_headings(lined))), content).drop("lines", "starts", "ends", content)
    results = [c for c in chosen.columns if c != id_col]
    joined = metadata.drop(*results).join(chosen, id_col, "left")
    # no raw row at all: what the extraction gives for a null document
    absent = F.col("extraction_status").isNull()
    nothing = {"extraction_status": F.lit("not_downloaded"), "candidate_count": F.lit(0), "plausible_count": F.lit(0),
               "word_count": F.lit(0), "section_text": F.lit(""), "candidates": F.array().cast(chosen.schema["candidates"].dataType)}
    return joined.withColumns({c: F.when(absent, v).otherwise(F.col(c)) for c, v in nothing.items() if c in results})


def qa_flag(text="section_text", plausible="plausible_count", words="word_count") -> Column:
    """First reason to look at an extraction."""
    return (F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "no_text")
            .when(F.col(plausible) > 1, "multiple_candidates")
            .when(F.coalesce(F.col(words).try_cast("int"), F.lit(0)) < 1000, "short_section")
            .otherwise("manual_review_required"))


REVIEW_FIELDS = ["correct_start", "correct_end", "toc_contamination", "review_decision", "review_notes"]


def review_sheet(report: DataFrame, cols=None) -> DataFrame:
    """Report columns and five empty fields for the reviewer."""
    return report.select(*(cols or report.columns), *[F.lit("").alias(f) for f in REVIEW_FIELDS])


def _matching(lines, pattern, longest=None) -> Column:
    def hit(i):
        line = F.get(lines, i)
        return line.rlike(pattern) if longest is None else line.rlike(pattern) & (F.length(line) <= longest)
    return F.filter(_indices(lines), hit)


def heading_diagnostics(docs: DataFrame, id_cols, lines="lines", pattern=REFERENCE_LINE, width=250, around=150) -> DataFrame:
    """Every line that refers to the section, with its neighbours, shortened for reading."""
    c = F.col(lines)
    i = F.col("line_number")
    return (unroll(docs, [*id_cols, lines], _matching(c, pattern), "line_number")
            .select(*id_cols, "line_number", F.substring(F.get(c, i), 1, width).alias("matched_line"),
                    F.when(i > 0, F.substring(F.get(c, F.greatest(i - 1, F.lit(0))), 1, around)).otherwise("")
                    .alias("previous_line"),
                    F.coalesce(F.substring(F.get(c, i + 1), 1, around), F.lit("")).alias("next_line")))


def line_context(docs: DataFrame, id_cols, lines="lines", pattern=ITEM_LINE, before=2, after=3, longest=300,
                 width=180) -> DataFrame:
    """Lines around every match: one row per match and offset."""
    c = F.col(lines)
    hits = unroll(docs, [*id_cols, lines], _matching(c, pattern, longest), "line_number")
    n = F.size(c)
    offsets = F.sequence(F.greatest(-F.col("line_number"), F.lit(-before)),
                         F.least(n - 1 - F.col("line_number"), F.lit(after)))
    at = F.col("line_number") + F.col("offset")
    return (hits.withColumn("offset", F.explode(offsets))
            .select(*id_cols, "line_number", "offset", F.substring(F.get(c, at), 1, width).alias("context_line")))


def numbered_pieces(docs: DataFrame, id_col, pieces: Column, prefix, number, text, keep=()) -> DataFrame:
    """One row per array element with a stable 1-based number and an id such as ``<doc>_c0001``."""
    pos = F.col("_pos") + 1
    digits = F.greatest(F.lit(4), F.length(pos.cast("string")))
    return (unroll(docs, [id_col, *keep], pieces, text, "_pos")
            .withColumn(f"{number}_id", F.concat(F.col(id_col).cast("string"), F.lit(f"_{prefix}"),
                                                 F.lpad(pos.cast("string"), digits, F.lit("0"))))
            .withColumn(f"{number}_number", pos).drop("_pos"))


def paragraphs(docs: DataFrame, id_col, text, keep=(), least=20) -> DataFrame:
    """Blocks between blank lines with at least ``least`` words, numbered after filtering."""
    blocks = F.transform(F.split(F.col(text), rf"\n{tx.SPACE}*\n+"), lambda b: tx.collapse(b))
    kept = F.filter(blocks, lambda b: tx.word_count(b) >= least)
    return (numbered_pieces(docs, id_col, kept, "p", "paragraph", "paragraph_text", keep)
            .withColumn("word_count", tx.word_count("paragraph_text")))


def chunk_array(text, target=150, most=220, least=50) -> Column:
    """Sentence-aligned chunks of a text as an array.

    Sentences fill a chunk until it has ``target`` words and never past ``most``; a longer sentence is
    cut every ``most`` words; a chunk under ``least`` words joins its predecessor (the first one its
    successor), which may exceed ``most``. No word is lost.
    """
    nothing = F.array().cast("array<string>")

    def grow(state, sentence):
        s, c = sentence["text"], sentence["words"]
        huge = c > most
        full = (state["n"] > 0) & (state["n"] + c > most)
        closed = F.when((huge | full) & (state["n"] > 0), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        opened = F.when(huge, F.lit("")).when(full | (state["n"] == 0), s).otherwise(F.concat(state["open"], F.lit(" "), s))
        n = F.when(huge, 0).when(full, c).otherwise(state["n"] + c)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((c - 1) / most).cast("int")),
                             lambda k: F.array_join(F.slice(F.split(s, " "), k * most + 1, F.lit(most)), " "))
        done = F.when(huge, F.concat(closed, pieces)).when(n >= target, F.concat(closed, F.array(opened))).otherwise(closed)
        ready = n >= target
        return F.struct(done.alias("done"), F.when(ready, F.lit("")).otherwise(opened).alias("open"),
                        F.when(ready, 0).otherwise(n).alias("n"))
    start = F.struct(nothing.alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    counted = F.transform(tx.split_sentences(text), lambda t: F.struct(
        t.alias("text"), F.regexp_count(t, F.lit("[^ ]+")).alias("words")))
    grown = F.aggregate(counted, start, grow,
                        lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))

    def join_short(acc, chunk):
        short = (F.size(acc) > 0) & (F.size(F.split(chunk, " ")) < least)
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(F.concat(F.get(acc, F.size(acc) - 1), F.lit(" "), chunk)))
        return F.when(short, merged).otherwise(F.concat(acc, F.array(chunk)))

    def fix_first(acc):
        short = (F.size(acc) > 1) & (F.size(F.split(F.get(acc, F.lit(0)), " ")) < least)
        head = F.array(F.concat(F.get(acc, F.lit(0)), F.lit(" "), F.get(acc, F.lit(1))))
        return F.when(short, F.concat(head, F.slice(acc, F.lit(3), F.greatest(F.size(acc) - 2, F.lit(0))))).otherwise(acc)
    return F.aggregate(grown, nothing, join_short, fix_first)


def chunks(docs: DataFrame, id_col, text, keep=(), target=150, most=220) -> DataFrame:
    """Numbered chunks; a text that would not be reproduced by its chunks raises."""
    pieces = docs.withColumn("_chunks", chunk_array(text, target, most))
    lossless = F.array_join("_chunks", " ") == tx.collapse(text)
    checked = pieces.withColumn("_chunks", F.when(lossless | F.col(text).isNull(), F.col("_chunks")).otherwise(
        F.raise_error(F.lit("text integrity check failed during chunking"))))
    return (numbered_pieces(checked, id_col, F.col("_chunks"), "c", "chunk", "chunk_text", keep)
            .withColumn("word_count", tx.word_count("chunk_text"))
            .withColumn("segmentation_method", F.lit("heuristic_sentence_chunking_v2")))
