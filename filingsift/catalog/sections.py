"""Sections of raw documents, paragraphs, sentences and chunks."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import text as tx
from filingsift.operators import describe, sections

TAG_SQL = """<[A-Za-z/!?](?:[^"''>]|"[^"]*"|''[^'']*'')*>"""


def lines_sql(source, id_col, keep=""):
    return f""", x as (select {id_col}{keep}, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g'),
    '(?is)<script\\b[^>]*>.*?</script\\s*>', chr(10), 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', chr(10), 'g'), '{TAG_SQL}', chr(10), 'g') as t
  from {source}),
p as (select {id_col}{keep}, unnest(string_split(t, chr(10))) as part, generate_subscripts(string_split(t, chr(10)), 1) as ord from x),
q as (select {id_col}{keep}, ord, trim(regexp_replace(replace(replace(replace(replace(part, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
  '&amp;', '&'), '\\s+', ' ', 'g')) as line from p),
lines as (select {id_col}{keep}, line, cast(row_number() over (partition by {id_col} order by ord) - 1 as int) as line_no from q where line <> '')
"""


LINES = lines_sql("v4", "doc_id", ", company")
HEADS = LINES + r"""
, arr as (select doc_id, any_value(company) as company, list(line order by line_no) as ls from lines group by doc_id),
hit as (select l.doc_id, l.line_no as i, l.line, a.ls from lines l join arr a on l.doc_id = a.doc_id
  where regexp_matches(l.line, '(?i)^item\s*(1\s*[ab]|2)')),
r as (select *, regexp_matches(line, '(?i)^item\s*1\s*a\s*[.\-:–—]?\s*(.*)$') as opens,
  trim(regexp_extract(line, '(?i)^item\s*(?:1\s*a|1\s*b|2)\s*[.\-:–—]?\s*(.*)$', 1)) as rest from hit),
a as (select *, regexp_replace(lower(rest), '[^a-z]', '', 'g') as n0,
  regexp_replace(lower(rest || coalesce(ls[i + 2], '')), '[^a-z]', '', 'g') as n1,
  regexp_replace(lower(rest || coalesce(ls[i + 2], '') || coalesce(ls[i + 3], '')), '[^a-z]', '', 'g') as n2 from r),
b as (select *, case when opens then ['riskfactors'] else ['unresolvedstaffcomments', 'properties'] end as wanted from a),
c as (select *, case when length(rest) > 55 then null when n0 in wanted then i + 1 when n1 in wanted then i + 2 when n2 in wanted then i + 3 end
  as body from b),
heads as (select doc_id, case when opens then 'start' else 'end' end as kind, cast(i as int) as line, cast(body as int) as body_start, ls from c
  where body is not null and not regexp_matches(coalesce(ls[body + 1], ''), '^\d{1,4}(?:\s*[-–—]\s*\d{1,4})?$')),
starts as (select * from heads where kind = 'start' and not (
  len(list_filter(ls[body_start + 1 : body_start + 3], lambda s: regexp_matches(s, '^\d{1,4}(?:\s*[-–—]\s*\d{1,4})?$'))) > 0
  and len(list_filter(ls[body_start + 1 : body_start + 6], lambda s: regexp_matches(s, '(?i)^item\s*(?:1\s*b|2)\b'))) > 0)),
pairs as (select s.*, (select min(e.line) from heads e where e.doc_id = s.doc_id and e.kind = 'end' and e.line > s.line) as end_line from starts s),
cand as (select doc_id, line as start_line, end_line, array_to_string(ls[body_start + 1 : end_line], chr(10)) as text from pairs where end_line > body_start),
cw as (select *, len(regexp_extract_all(text, '[^\s]+')) as word_count, cast(row_number() over (partition by doc_id order by start_line) as int)
  as candidate_number from cand),
plaus as (select *, row_number() over (partition by doc_id order by word_count desc, start_line) as rk, count(*) over (partition by doc_id) as k
  from cw where word_count between 200 and 100000),
chosen as (select v.doc_id, case when p.doc_id is null then 'no_plausible_section' when p.k > 1 then 'ambiguous_needs_review'
    else 'candidate_needs_review' end as extraction_status, (select count(*) from cw where cw.doc_id = v.doc_id) as candidate_count,
  coalesce(p.k, 0) as plausible_count, coalesce(p.word_count, 0) as word_count, p.start_line, p.end_line, coalesce(p.text, '') as section_text
  from v4 v left join plaus p on v.doc_id = p.doc_id and p.rk = 1)
"""


def lined(spark, sf):
    docs = view(spark, sf, "v4")
    return docs.select("doc_id", "company", sections.document_lines("html").alias("lines"))


def extracted(spark, sf):
    docs = view(spark, sf, "v4")
    return sections.extract_sections(docs.select("doc_id", "company"), docs, "doc_id", "html")


@query("h1_document_lines", lines_sql("pages", "page_id").replace(", x as", "with x as", 1) + "select page_id, line_no, line from lines")
def h1(spark, sf):
    docs = table(spark, sf, "pages").withColumn("lines", sections.document_lines("html"))
    return sections.line_table(docs, "page_id")


@query("h2_headings", HEADS + "select doc_id, kind, line, body_start from heads", ["v4"])
def h2(spark, sf):
    return sections.heading_table(sections.with_headings(lined(spark, sf)), "doc_id")


@query("h3_contents_rejected", HEADS + "select doc_id, kind, line, body_start from starts", ["v4"])
def h3(spark, sf):
    return sections.heading_table(sections.reject_contents(sections.with_headings(lined(spark, sf))), "doc_id").filter("kind = 'start'")


@query("h4_section_candidates", HEADS + "select doc_id, candidate_number, start_line, end_line, word_count, md5(text) as digest from cw", ["v4"])
def h4(spark, sf):
    docs = sections.with_candidates(sections.reject_contents(sections.with_headings(lined(spark, sf))))
    return sections.candidate_table(docs, ["doc_id"]).select(
        "doc_id", "candidate_number", "start_line", "end_line", "word_count", F.md5("text").alias("digest"))


@query("h5_chosen_sections", HEADS + """
select doc_id, extraction_status, candidate_count, plausible_count, word_count, start_line, end_line, md5(section_text) as digest from chosen""", ["v4"])
def h5(spark, sf):
    return extracted(spark, sf).select("doc_id", "extraction_status", "candidate_count", "plausible_count", "word_count", "start_line",
                                       "end_line", F.md5("section_text").alias("digest"))


@query("e31_extraction_status", HEADS + "select extraction_status, count(*) as n from chosen group by 1", ["v4"])
def e31(spark, sf):
    return describe.status_counts(extracted(spark, sf), "extraction_status")


FLAG_SQL = """case when trim(section_text) = '' then 'no_text' when plausible_count > 1 then 'multiple_candidates'
  when word_count < 1000 then 'short_section' else 'manual_review_required' end"""


@query("h6_qa_flags", HEADS + f"select doc_id, {FLAG_SQL} as qa_flag from chosen", ["v4"])
def h6(spark, sf):
    return extracted(spark, sf).select("doc_id", sections.qa_flag().alias("qa_flag"))


@query("h7_review_sheet", HEADS + f"""select doc_id, extraction_status, word_count, {FLAG_SQL} as qa_flag, '' as correct_start, '' as correct_end,
  '' as toc_contamination, '' as review_decision, '' as review_notes from chosen""", ["v4"])
def h7(spark, sf):
    report = extracted(spark, sf).withColumn("qa_flag", sections.qa_flag())
    return sections.review_sheet(report, ["doc_id", "extraction_status", "word_count", "qa_flag"])


@query("h8_heading_diagnostics", LINES + r"""
, n as (select *, lag(line) over w as pl, lead(line) over w as nl from lines window w as (partition by doc_id order by line_no))
select doc_id, company, line_no as line_number, left(line, 250) as matched_line, coalesce(left(pl, 150), '') as previous_line,
  coalesce(left(nl, 150), '') as next_line from n where regexp_matches(line, '(?i)\bitem\s*1\s*[.\-]?\s*a\b')""", ["v4"])
def h8(spark, sf):
    return sections.heading_diagnostics(lined(spark, sf), ["doc_id", "company"])


@query("f4_line_context", LINES + r"""
, m as (select doc_id, line_no from lines where length(line) <= 300 and regexp_matches(line, '(?i)\bitem\s*1\s*a\b|\bitem\s*1\s*b\b|\bitem\s*2\b'))
select m.doc_id, m.line_no as line_number, cast(l.line_no - m.line_no as int) as "offset", left(l.line, 180) as context_line
from m join lines l on m.doc_id = l.doc_id and l.line_no between m.line_no - 2 and m.line_no + 3""", ["v4"])
def f4(spark, sf):
    return sections.line_context(lined(spark, sf), ["doc_id"])


@query("h9_paragraphs", r"""
with b as (select doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) as block,
  generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) as ord from documents),
c as (select doc_id, ord, trim(regexp_replace(block, '\s+', ' ', 'g')) as t from b),
k as (select doc_id, t, len(regexp_extract_all(t, '[^\s]+')) as word_count, row_number() over (partition by doc_id order by ord) as n from c
  where len(regexp_extract_all(t, '[^\s]+')) >= 20)
select doc_id, cast(doc_id as varchar) || '_p' || lpad(cast(n as varchar), 4, '0') as paragraph_id, cast(n as int) as paragraph_number,
  t as paragraph_text, word_count from k""")
def h9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return sections.paragraphs(docs, "doc_id", "text")


@query("h10_sentences", r"""
with s as (select doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'),
  chr(10)) as p from documents),
u as (select doc_id, unnest(p) as sentence, generate_subscripts(p, 1) as n from s)
select doc_id, cast(n as int) as sentence_number, sentence from u where sentence <> ''""")
def h10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.split_sentences("text")).alias("p", "sentence"))
    return docs.select("doc_id", (F.col("p") + 1).alias("sentence_number"), "sentence")


# one sentence a step, as the operator folds them; then chunks of under 50 words join their neighbours
CHUNKS = r"""
with recursive d as (select doc_id, source as company, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
  '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as p from documents),
g as (select doc_id, p, 0 as i, cast([] as varchar[]) as done, '' as o, cast(0 as bigint) as n from d
  union all
  select doc_id, p, i + 1, case when huge then list_concat(closed, list_transform(range(0, cast(floor((c - 1) / 220) as bigint) + 1),
      lambda k: array_to_string(string_split(s, ' ')[k * 220 + 1 : (k + 1) * 220], ' '))) when n1 >= 150 then list_append(closed, o1) else closed end,
    case when n1 >= 150 then '' else o1 end, case when n1 >= 150 then 0 else n1 end
  from (select *, case when (huge or whole) and n > 0 then list_append(done, o) else done end as closed,
      case when huge then '' when whole or n = 0 then s else o || ' ' || s end as o1, case when huge then 0 when whole then c else n + c end as n1
    from (select *, c > 220 as huge, n > 0 and n + c > 220 as whole
      from (select *, p[i + 1] as s, len(regexp_extract_all(p[i + 1], '[^ ]+')) as c from g where i < len(p))))),
grown as (select doc_id, case when n > 0 then list_append(done, o) else done end as q from g where i = len(p)),
j as (select doc_id, q, 0 as i, cast([] as varchar[]) as acc from grown
  union all
  select doc_id, q, i + 1, case when len(acc) > 0 and len(string_split(q[i + 1], ' ')) < 50
    then list_append(acc[1 : len(acc) - 1], acc[len(acc)] || ' ' || q[i + 1]) else list_append(acc, q[i + 1]) end from j where i < len(q)),
f as (select doc_id, case when len(acc) > 1 and len(string_split(acc[1], ' ')) < 50 then list_concat([acc[1] || ' ' || acc[2]], acc[3 : len(acc)]) else acc end as acc
  from j where i = len(q)),
u as (select doc_id, unnest(acc) as t, generate_subscripts(acc, 1) as n from f)
select u.doc_id, company, cast(u.doc_id as varchar) || '_c' || lpad(cast(n as varchar), cast(greatest(4, length(cast(n as varchar))) as int), '0') as chunk_id,
  cast(n as int) as chunk_number, t as chunk_text, len(regexp_extract_all(t, '[^\s]+')) as word_count, 'heuristic_sentence_chunking_v2' as segmentation_method
from u join d on d.doc_id = u.doc_id
"""


@query("h11_chunks", CHUNKS)
def h11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("company"), "text")
    return sections.chunks(docs, "doc_id", "text", ["company"])


@query("f3_piece_ids", r"""
with s as (select doc_id, string_split(text, chr(10)) as p from documents), u as (select doc_id, unnest(p) as line, generate_subscripts(p, 1) as n from s)
select doc_id, cast(doc_id as varchar) || '_c' || lpad(cast(n as varchar), cast(greatest(4, length(cast(n as varchar))) as int), '0') as piece_id,
  cast(n as int) as piece_number, line from u""")
def f3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sections.numbered_pieces(docs, "doc_id", F.split("text", "\n"), "c", "piece", "line")
