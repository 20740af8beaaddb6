"""Vocabularies, weights, novelty, vectors and models."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from filingsift.catalog.joining import LABELLED_SQL, labelled
from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import text as tx
from filingsift.operators import boosting, classify, describe, encoding, evaluate, forest, novelty, splits, topics, vectors, vocab
from filingsift.plans import anomaly_job, supervised_job
from filingsift.session import materialize

# frequent words of the fixture languages in the role of a stop list
STOPS = ["the", "and", "of", "to", "in", "that", "is", "der", "die", "und", "que", "el", "la", "le", "les", "et"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOPS)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


TOKENS = r"""
, tk as (select doc_id, year(filing_date) as y, list_filter(regexp_extract_all(lower(mda), '[\p{L}\p{Nl}\p{No}_]+'),
  lambda t: length(t) between 2 and 15 and t not like '\_%' escape '\') as tokens from v3)
"""


@query("h12_topic_tokens", TOKENS + "select doc_id, len(tokens) as n, md5(array_to_string(tokens, ' ')) as digest from tk", ["v3"])
def h12(spark, sf):
    t = tx.topic_tokens("mda")
    return view(spark, sf, "v3").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


VOCAB = TOKENS + """
, tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from tk) group by 1, 2),
voc as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf group by 1
  having count(*) >= 2 and count(*) <= floor(0.25 * (select count(*) from v3)))
"""


def topic_counts(spark, sf):
    docs = view(spark, sf, "v3")
    return docs, vocab.term_counts(docs, "doc_id", tx.topic_tokens("mda"))


@query("h13_vocabulary", VOCAB + "select term, df, cf from voc", ["v3"])
def h13(spark, sf):
    docs, counts = topic_counts(spark, sf)
    return vocab.topic_vocabulary(counts, docs.count())


@query("h14_bag_of_words", VOCAB + "select doc_id, tf.term, tf from tf join voc on tf.term = voc.term", ["v3"])
def h14(spark, sf):
    docs, counts = topic_counts(spark, sf)
    counts = materialize(counts, "counts")
    return vocab.bag_of_words(counts, vocab.topic_vocabulary(counts, docs.count()))


TFIDF = r"""
, tk as (select doc_id, year(filing_date) as y, list_filter(regexp_extract_all(lower(mda), '[\p{L}\p{N}_]{2,}'),
  lambda t: t not in (""" + STOP_SQL + r""")) as w from v3),
g as (select doc_id, y, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from tk),
tf as (select doc_id, y, term, count(*) as tf from g group by all),
n as (select count(*) as n from v3 where year(filing_date) <= 2017),
st as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf where y <= 2017 group by 1),
voc as (select term, df, cf, ln((1 + n) / (1 + df)) + 1 as idf, row_number() over (order by term) - 1 as idx from (
  select term, df, cf, n from st, n where df >= 5 and df <= 0.95 * n order by cf desc, term limit 20000)),
raw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join voc using (term)),
wt as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)
"""


def tfidf(spark, sf):
    docs = view(spark, sf, "v3")
    train = docs.filter(F.year("filing_date") <= 2017)
    return docs, vocab.fit_tfidf(train, "doc_id", "mda", STOPS)


@query("h15_tfidf_vocabulary", TFIDF + "select cast(idx as int) as idx, term, df, cf, round(idf, 6) as idf from voc", ["v3"])
def h15_vocabulary(spark, sf):
    return rounded(tfidf(spark, sf)[1].vocabulary, "idf")


@query("h15_tfidf_weights", TFIDF + """
select doc_id, count(*) as terms, round(sum(weight), 6) as total, round(max(weight), 6) as largest, round(sum(weight * weight), 6) as norm
from wt group by doc_id""", ["v3"])
def h15(spark, sf):
    docs = view(spark, sf, "v3")
    # tokenised once for the fit and the weights
    counts = materialize(vocab.tfidf_counts(docs, "doc_id", "mda", STOPS), "counts")
    train = docs.filter(F.year("filing_date") <= 2017).select("doc_id")
    model = vocab.fit_tfidf(train, "doc_id", "mda", STOPS, counts=counts.join(train, "doc_id", "left_semi"))
    weights = vocab.weigh(counts, model, "doc_id")
    out = weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("largest"),
                                        F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    return rounded(out, "total", "largest", "norm")


NOVELTY = r"""
, tk as (select company, filing_id, chunk_id, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]{2,}') as w from v5),
g as (select filing_id, chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from tk),
tf as (select filing_id, chunk_id, term, count(*) as tf from g group by all),
sz as (select filing_id, count(*) as n from v5 group by 1),
df as (select filing_id, term, count(*) as df from tf group by 1, 2),
idfs as (select df.filing_id, term, ln((1 + n) / (1 + df)) + 1 as idf from df join sz on df.filing_id = sz.filing_id),
ref as (select company, filing_id, filing_date, lag(filing_id) over w as ref, lag(filing_date) over w as ref_date
  from (select distinct company, filing_id, filing_date from v5) window w as (partition by company order by filing_date, filing_id)),
pw as (select t.filing_id as ref, t.chunk_id as match, t.term, (1 + ln(tf)) * idf as w from tf t join idfs i on t.filing_id = i.filing_id and t.term = i.term),
past as (select ref, match, term, w / sqrt(sum(w * w) over (partition by ref, match)) as p from pw),
cw as (select r.ref, t.filing_id, t.chunk_id, t.term, (1 + ln(tf)) * i.idf as w from tf t join ref r on t.filing_id = r.filing_id
  join idfs i on i.filing_id = r.ref and i.term = t.term),
now as (select ref, filing_id, chunk_id, term, w / sqrt(sum(w * w) over (partition by ref, chunk_id)) as w from cw),
"""
SCORES = NOVELTY + """
sims as (select n.chunk_id, p.match, sum(n.w * p.p) as s from now n join past p on n.ref = p.ref and n.term = p.term group by all),
best as (select s.chunk_id, s.match, least(greatest(s.s, 0), 1) as s, row_number() over (partition by s.chunk_id order by round(s.s, 12) desc, v.chunk_number, s.match) as r
  from sims s join v5 v on s.match = v.chunk_id),
scored as (select v.company, v.filing_id, v.filing_date, v.chunk_id, r.ref as reference_filing_id, r.ref_date as reference_filing_date,
  case when r.ref is not null then b.match end as matched_chunk_id,
  case when r.ref is not null then coalesce(b.s, 0) end as max_similarity from v5 v join ref r on v.filing_id = r.filing_id
  left join best b on v.chunk_id = b.chunk_id and b.r = 1),
result as (select *, 1 - max_similarity as novelty_score, case when reference_filing_id is null then 'no_history' when max_similarity >= 0.8 then 'potential_boilerplate'
  when max_similarity >= 0.4 then 'modified_disclosure' else 'potential_novel_disclosure' end as boilerplate_category,
  case when reference_filing_id is null then 'no_history' when matched_chunk_id is null then 'no_shared_terms' else 'scored' end as scoring_status from scored)
"""


def chunk_table(spark, sf):
    """The chunk view as the written table the novelty job expects."""
    return materialize(view(spark, sf, "v5"), "chunks")


@query("h16_reference_weights", NOVELTY.rstrip().rstrip(",") + """
select 'past' as side, ref, count(*) as terms, round(sum(p), 5) as total from past where ref in (select ref from ref where ref is not null) group by ref
union all select 'now' as side, ref, count(*) as terms, round(sum(w), 5) as total from now group by ref""", ["v5"])
def h16(spark, sf):
    chunks = chunk_table(spark, sf)

    def totals(some, pairs):
        rows = novelty.unit(novelty.reference_weights(some, pairs).packed).filter("rep is not null")
        # identical texts of a filing share one vector; the copies are counted back in
        held, total = F.size("w") + F.size("alone_w"), F.aggregate(F.concat("w", "alone_w"), F.lit(0.0), lambda a, x: a + x)
        side = F.when(F.col("is_past"), "past").otherwise("now").alias("side")
        return rows.groupBy(side, "ref").agg(F.sum(F.col("copies") * held).alias("terms"), F.round(F.sum(F.col("copies") * total), 5).alias("total"))
    return novelty.in_rounds(chunks, novelty.references(chunks), totals)


@query("c11_best_match", SCORES + """
select chunk_id, match as matched_chunk_id, round(s, 6) as similarity from best where r = 1""", ["v5"])
def c11(spark, sf):
    chunks = chunk_table(spark, sf)
    matches = novelty.in_rounds(chunks, novelty.references(chunks), novelty.text_matches)
    members = chunks.select("filing_id", "chunk_id", F.sha2("chunk_text", 256).alias("text_key"))
    return members.join(matches, ["filing_id", "text_key"]).select(
        "chunk_id", F.col("match").alias("matched_chunk_id"), F.round(F.least("similarity", F.lit(1.0)), 6).alias("similarity"))


@query("h17_novelty_scores", SCORES + """
select chunk_id, filing_id, reference_filing_id, reference_filing_date, matched_chunk_id, round(max_similarity, 6) as max_similarity,
  round(novelty_score, 6) as novelty_score, boilerplate_category, scoring_status from result""", ["v5"])
def h17(spark, sf):
    out = novelty.score_chunks(chunk_table(spark, sf)).select(
        "chunk_id", "filing_id", "reference_filing_id", "reference_filing_date", "matched_chunk_id", "max_similarity", "novelty_score",
        "boilerplate_category", "scoring_status")
    return rounded(out, "max_similarity", "novelty_score")


@query("e26_filing_summary", SCORES + """
select company, filing_id, filing_date, count(*) as total_chunks, count(max_similarity) as scored_chunks, round(avg(max_similarity), 6) as mean_similarity,
  round(avg(novelty_score), 6) as mean_novelty, """ + ", ".join(
    f"count(*) filter (boilerplate_category = '{c}') as {c}" for c in novelty.CATEGORIES) + " from result group by 1, 2, 3", ["v5"])
def e26(spark, sf):
    scores = materialize(novelty.score_chunks(chunk_table(spark, sf)).drop("chunk_text", "matched_chunk_text"), "scores")
    return rounded(describe.novelty_summary(scores), "mean_similarity", "mean_novelty")


@query("c6_attach_category_counts", """
, s as (select company, filing_id, count(*) as chunks from v5 group by 1, 2),
k as (select filing_id, count(*) filter (chunk_id >= 1000000) as repeated, count(*) filter (chunk_id < 1000000) as own from v5 group by 1)
select s.*, repeated, own from s left join k using (filing_id)""", ["v5"])
def c6(spark, sf):
    rows = view(spark, sf, "v5").withColumn("kind", F.when(F.col("chunk_id") >= 1000000, "repeated").otherwise("own"))
    summary = rows.groupBy("company", "filing_id").agg(F.count(F.lit(1)).alias("chunks"))
    return describe.attach_one_to_one(summary, describe.crosstab(rows, "filing_id", "kind", ["repeated", "own"]), "filing_id")


@query("e27_chunk_quality", r"""
, w as (select *, len(regexp_extract_all(chunk_text, '[^\s]+')) as word_count from v5),
f as (select company, filing_id, count(*) as n from w group by 1, 2), c as (select company, count(*) as n from w group by 1)
select count(*) as chunks, count(*) filter (word_count < 50) as under_low, count(*) filter (word_count > 220) as over_high,
  count(*) filter (chunk_text is null) as missing_text, count(*) - count(distinct chunk_id) as duplicate_ids,
  (select count(*) from f) as filings, (select max(n) from f) as most_per_filing, round((select avg(n) from f), 6) as mean_per_filing,
  (select count(*) from c) as companies, (select max(n) from c) as most_per_company from w""", ["v5"])
def e27(spark, sf):
    return rounded(describe.chunk_quality(view(spark, sf, "v5").withColumn("word_count", tx.word_count("chunk_text"))), "mean_per_filing")


@query("h18_token_windows", TOKENS + r"""
, k as (select doc_id, tokens, unnest(range(0, cast(ceil(len(tokens) / 64.0) as bigint))) as i from tk)
select doc_id, cast(i as int) as window_no, len(tokens[i * 64 + 1 : i * 64 + 64]) as size,
  md5(array_to_string(tokens[i * 64 + 1 : i * 64 + 64], ' ')) as digest from k""", ["v3"])
def h18(spark, sf):
    docs = view(spark, sf, "v3").select("doc_id", tx.topic_tokens("mda").alias("tokens"))
    out = docs.select("doc_id", F.posexplode(tx.token_windows("tokens", 64)).alias("window_no", "w"))
    return out.select("doc_id", "window_no", F.size("w").alias("size"), F.md5(F.array_join("w", " ")).alias("digest"))


# ---- models -------------------------------------------------------------------------------------------------------------

# the term limit that topic models of this kind are trained with
TOPIC_TERMS = 100_000

TRAIN_VOCAB = TOKENS + """
, tf as (select distinct doc_id, term from (select doc_id, unnest(tokens) as term from tk where y <= 2017)),
voc as (select term from tf group by 1 having count(*) >= 2 and count(*) <= floor(0.25 * (select count(*) from v3 where year(filing_date) <= 2017)))
"""


def counted_texts(spark, sf):
    docs = view(spark, sf, "v3").select("doc_id", "filing_date", "fraudulent", tx.topic_tokens("mda").alias("tokens"))
    docs = materialize(docs, "tokens")
    train = docs.filter(F.year("filing_date") <= 2017)
    terms = topics.fit_vocabulary(train, "doc_id", "tokens", TOPIC_TERMS)
    return topics.count_vectors(docs, "tokens", terms), terms


@query("i1_topic_vectors", TRAIN_VOCAB + """
, known as (select distinct doc_id from (select doc_id, unnest(tokens) as term from tk) join voc using (term))
select doc_id, 100 as topics, cast(doc_id in (select doc_id from known) as double) as total, true as in_range from v3""", ["v3"])
def i1(spark, sf):
    """Weights of all topics in every document: how many there are, their sum (0 without a known term) and range."""
    counted, _ = counted_texts(spark, sf)
    model = topics.fit_topics(counted.filter(F.year("filing_date") <= 2017), k=100, passes=10)
    out = topics.topic_vectors(model, counted, ["doc_id"])
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size("topics").alias("topics"), F.round(total, 6).alias("total"),
                      F.forall("topics", lambda x: x.between(0, 1)).alias("in_range"))


@query("i2_topic_count_sweep", "select cast(unnest(range(10, 151, 10)) as int) as k, true as bounded, true as coherent")
def i2(spark, sf):
    counted, terms = counted_texts(spark, sf)
    y = F.year("filing_date")
    sweep = topics.topic_count_sweep(counted.filter(y <= 2017), counted.filter(y.between(2018, 2023)), range(10, 151, 10),
                                     tokens="tokens", vocabulary=terms)
    return sweep.select("k", (F.col("log_perplexity") < 0).alias("bounded"), F.col("coherence").between(-1, 1).alias("coherent"))


COHERENCE = TOKENS + r"""
, l as (select tk.doc_id, v3.state as topic, tokens from tk join v3 on tk.doc_id = v3.doc_id),
df as (select topic, term, count(distinct doc_id) as df from (select doc_id, topic, unnest(tokens) as term from l) group by 1, 2),
tt as (select topic, term from df qualify row_number() over (partition by topic order by df desc, term) <= 20),
terms as (select distinct term from tt),
pos as (select doc_id, greatest(1, len(tokens) - 109) as nw, unnest(tokens) as term, generate_subscripts(tokens, 1) - 1 as p from tk where len(tokens) > 0),
hits as (select doc_id, nw, p, pos.term from pos join terms on pos.term = terms.term),
inside as (select distinct doc_id, term, unnest(range(greatest(0, p - 109), least(p, nw - 1) + 1)) as s from hits),
pc as (select a.term as a, b.term as b, count(*) as n from inside a join inside b on a.doc_id = b.doc_id and a.s = b.s group by 1, 2),
tot as (select cast(sum(greatest(1, len(tokens) - 109)) as double) as total from tk where len(tokens) > 0),
pairs as (select x.topic, x.term as a, y.term as b, coalesce(pc.n, 0) / total as pj, sa.n / total as pa, sb.n / total as pb
  from tt x join tt y on x.topic = y.topic cross join tot left join pc on pc.a = x.term and pc.b = y.term
  left join pc sa on sa.a = x.term and sa.b = x.term left join pc sb on sb.a = y.term and sb.b = y.term),
np as (select topic, a, b, case when pa * pb > 0 then ln((pj + 1e-12) / (pa * pb)) / -ln(pj + 1e-12) else 0 end as v from pairs),
wh as (select topic, b, sum(v) as s from np group by 1, 2),
co as (select np.topic, a, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) as c from np join wh on np.topic = wh.topic and np.b = wh.b group by 1, 2)
select topic, round(avg(c), 6) as coherence from co group by topic
"""


@query("i3_topic_coherence", COHERENCE, ["v3"])
def i3(spark, sf):
    """Coherence of the twenty most common terms of every language."""
    docs = view(spark, sf, "v3").select("doc_id", F.col("state").alias("lang"), tx.topic_tokens("mda").alias("tokens"))
    docs = materialize(docs, "tokens")
    df = (docs.select("lang", "doc_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("lang", "term")
          .agg(F.count(F.lit(1)).alias("df")))
    order = Window.partitionBy("lang").orderBy(F.col("df").desc(), "term")
    best = df.withColumn("r", F.row_number().over(order)).filter("r <= 20").select(F.col("lang").alias("name"), "term")
    # the operator reads the topics' terms anyway; a language's number is its place in the alphabet
    ids = best.select("name").distinct().withColumn("topic", F.row_number().over(Window.orderBy("name")) - 1)
    best, ids = materialize(best, "terms"), materialize(ids, "languages")
    scored = topics.coherence(docs, "tokens", best.join(ids, "name").select("topic", "term"))
    return scored.join(ids, "topic").select(F.col("name").alias("topic"), F.round("coherence", 6).alias("coherence"))


def labelled_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    return materialize(splits.stratified_split(rows, "vec_id", "y", 0.3, 7, names=("train", "test")), "vectors")


def part(rows, name):
    return rows.filter(F.col("split") == name)


VECTORS = """with b as (select vec_id, embedding, cast(label = 0 as int) as y from embeddings),
h as (select *, row_number() over (partition by y order by md5('7:' || cast(vec_id as varchar)), vec_id) as r, count(*) over (partition by y) as n from b),
lv as (select vec_id, y, case when r <= floor(n * 0.3 + 0.5) then 'test' else 'train' end as split from h)
"""
CHECKED = VECTORS + "select vec_id, y, true as in_range, true as agrees from lv where split = 'test'"


def checked(scored, most=1.0, cut=0.5):
    """Keys, labels, and whether probability and prediction are in range and agree."""
    p = F.col("probability")
    return scored.select("vec_id", "y", p.between(0, most).alias("in_range"), (F.col("prediction") == (p > cut).cast("int")).alias("agrees"))


@query("i4_weighted_forest", CHECKED)
def i4(spark, sf):
    rows = labelled_vectors(spark, sf)
    model = classify.fit_random_forest(part(rows, "train"), "embedding", "y")
    return checked(classify.predict(model, part(rows, "test"), "embedding"))


@query("i5_boosted_trees", CHECKED)
def i5(spark, sf):
    rows = labelled_vectors(spark, sf)
    train = splits.stratified_split(part(rows, "train").drop("split"), "vec_id", "y", 0.25, 8)
    model, _, _ = boosting.fit_boosted(part(train, "train"), part(train, "validation"), "embedding", "y")
    return checked(classify.predict(model, part(rows, "test"), "embedding"))


@query("i6_positive_unlabelled", VECTORS + "select vec_id, y, true as in_range, true as agrees, true as scaled from lv where split = 'test'")
def i6(spark, sf):
    rows = labelled_vectors(spark, sf)
    train = splits.hide_positives(part(rows, "train"), "vec_id", "y", 10)
    fitted = classify.fit_positive_unlabelled(train, "vec_id", "embedding", "pu_label")
    out = classify.predict_positive_unlabelled(fitted, part(rows, "test"), "embedding")
    scaled = F.abs(F.col("probability") * fitted[1] - F.col("base_probability")) < 1e-9
    return out.select("vec_id", "y", F.col("base_probability").between(0, 1).alias("in_range"),
                      (F.col("prediction") == (F.col("probability") > 0.5).cast("int")).alias("agrees"), scaled.alias("scaled"))


@query("i7_hidden_positive_sweep", VECTORS + """
, s as (select y, row_number() over (order by md5('9:' || cast(vec_id as varchar)), vec_id) as r, count(*) over () as n from lv where split = 'train')
select cast(unnest(range(0, greatest((select count(*) from s where y = 1 and r <= floor(2 * n / 3)) - 5, 0), 5)) as int) as hidden,
  true as in_range, true as best_is_first_maximum, true as test_in_range""")
def i7(spark, sf):
    """The vectors have some thirty positives, so they are hidden by fives down to five."""
    rows = labelled_vectors(spark, sf)
    both = splits.shuffled_split(part(rows, "train").drop("split"), "vec_id", 9)
    sweep, hidden, scored = classify.sweep_and_refit(part(both, "train"), part(both, "validation"), part(rows, "test"), "vec_id", "embedding",
                                                     "y", step=5, spare=5)
    test = evaluate.macro_scores(scored, "y", "prediction").select("macro_f1").scalar()
    first = sweep.filter(F.col("pu_f1") == sweep.agg(F.max("pu_f1")).scalar()).agg(F.min("hidden")).scalar()
    measures = [c for c in sweep.columns if c != "hidden"]
    # a point whose held-out positives have no score keeps its row, without measures
    return sweep.select("hidden", F.forall(F.array(*measures), lambda x: x.isNull() | x.between(0, 1)).alias("in_range"),
                        (first == F.lit(hidden)).alias("best_is_first_maximum"), test.between(0, 1).alias("test_in_range"))


def reduced(spark, sf, components=300):
    docs = view(spark, sf, "v3").select("doc_id", "mda", "filing_date", "fraudulent")
    y = F.year("filing_date")
    return anomaly_job.text_vectors(docs.filter(y <= 2017), docs.filter(y > 2017), "doc_id", "mda", components, STOPS)


@query("i8_truncated_svd", TFIDF + """
select v3.doc_id, case when year(filing_date) <= 2017 then 'train' else 'later' end as split,
  cast(least(300, (select count(*) from voc) - 1, (select n from n) - 1) as int) as components, true as within_unit_ball,
  v3.doc_id in (select doc_id from wt) as nonzero_possible, true as explains from v3""", ["v3"])
def i8(spark, sf):
    """Rows of unit length are projected on orthonormal components, so no vector is longer than one."""
    train, rest, tfidf_model, model = reduced(spark, sf)
    both = train.withColumn("split", F.lit("train")).unionByName(rest.withColumn("split", F.lit("later")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return both.select("doc_id", "split", F.size("vector").alias("components"), (square <= 1 + 1e-9).alias("within_unit_ball"),
                       (square > 0).alias("nonzero_possible"), F.lit(0 < float(model.explained_variance_ratio) <= 1 + 1e-6).alias("explains"))


@query("i9_isolation_forest", "select cast(unnest(range(300)) as int) as tree, true as full_binary, true as depth_limit, true as offset_negative")
def i9(spark, sf):
    rows = labelled_vectors(spark, sf)
    model = forest.fit_isolation_forest(part(rows, "train"), "vec_id", "embedding")
    return model.nodes.groupBy("tree").agg((F.count(F.lit(1)) % 2 == 1).alias("full_binary"), (F.max("depth") <= 8).alias("depth_limit")) \
        .withColumn("offset_negative", F.lit(model.offset < 0))


@query("i10_anomaly_scores", VECTORS + """
select split, count(*) as n, true as in_range, case when split = 'train' then cast(ceil(0.02 * (count(*) - 1)) as bigint) end as above from lv group by split""")
def i10(spark, sf):
    """The threshold leaves the contamination share of the train rows above zero."""
    rows = labelled_vectors(spark, sf)
    model = forest.fit_isolation_forest(part(rows, "train"), "vec_id", "embedding")
    scored = forest.anomaly_scores(rows, model, "embedding")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("anomaly_score").between(-1, 1)).alias("in_range"),
                                       F.count_if(F.col("anomaly_score") > 0).alias("above")) \
        .withColumn("above", F.when(F.col("split") == "train", F.col("above")))


@query("i11_pooled_vectors", """
with u as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings)
select label, cast(dim as int) as dim, round(avg(cast(v as double)), 6) as value from u group by 1, 2""")
def i11(spark, sf):
    pooled = vectors.pool_vectors(table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("dim", "value")), "value")


@query("i11_masked_token_pooling", """
with u as (select label, vec_id % 5 as chunk, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings where vec_id % 4 <> 0),
c as (select label, chunk, dim, avg(cast(v as double)) as v from u group by 1, 2, 3)
select label, cast(dim as int) as dim, round(avg(v), 6) as value from c group by 1, 2""")
def i11_masked(spark, sf):
    """Vectors as tokens of chunks of a document, every fourth of them padding: unmasked tokens to chunks, chunks to documents."""
    tokens = table(spark, sf, "embeddings").withColumn("chunk", F.col("vec_id") % 5).withColumn("mask", (F.col("vec_id") % 4 != 0).cast("int"))
    pooled = vectors.pool_tokens(tokens, "label", "chunk", "embedding")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("dim", "value")), "value")


@query("i12_validate_embeddings", """
select (select count(*) from embeddings) as vectors, 0 as non_finite, (select min(len(embedding)) from embeddings) as min_dim,
  (select max(len(embedding)) from embeddings) as max_dim, (select count(*) from documents) as keys,
  (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as missing_keys, 0 as valid""")
def i12(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    return vectors.validate_embeddings(table(spark, sf, "embeddings"), keys, "vec_id", "embedding")


@query("i12_split_sizes", """
, k as (select doc_id, case when year(filing_date) <= 2017 then 'train' when year(filing_date) between 2018 and 2023 then 'test' else 'excluded' end as split from v3)
select split, count(*) as keys, count(vec_id) as vectors, cast(count(*) = count(vec_id) as int) as agree
from k left join embeddings on doc_id = vec_id group by split""", ["v3"])
def i12_splits(spark, sf):
    keys = view(spark, sf, "v3").select(F.col("doc_id").alias("vec_id"), splits.temporal_split("filing_date").alias("split"))
    return vectors.split_sizes_agree(table(spark, sf, "embeddings"), keys, "vec_id", "split")


def encoded(spark, sf):
    """Vectors of all texts by a small encoder that tasks build for themselves."""
    return encoding.encode_documents(view(spark, sf, "v3"), "doc_id", "mda", encoding.word_md5_encoder(32), element="float64")


@query("i13_encoded_documents", r"""
, w as (select doc_id, unnest(regexp_extract_all(lower(mda), '[\p{L}\p{N}_]+')) as t from v3),
h as (select doc_id, cast('0x' || substr(md5(t), 1, 8) as bigint) % 32 as dim, case when cast('0x' || substr(md5(t), 9, 1) as int) % 2 = 1 then 1 else -1 end as sign from w),
c as (select doc_id, dim, sum(sign) as v from h group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) as norm from c group by 1),
k as (select doc_id, unnest(range(32)) as dim from v3)
select k.doc_id, cast(k.dim as int) as dim, round(coalesce(case when norm > 0 then v / norm end, 0), 6) as value
from k left join c on c.doc_id = k.doc_id and c.dim = k.dim left join n on n.doc_id = k.doc_id""", ["v3"])
def i13(spark, sf):
    return rounded(encoded(spark, sf).select("doc_id", F.posexplode("embedding").alias("dim", "value")), "value")


def in_range(df):
    """Whether every measure of a metrics record that is not null lies in [0, 1]."""
    measures = [c for c in df.columns if c.startswith(("roc_auc", "pr_auc", "precision", "recall"))]
    return F.forall(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in measures]), lambda x: x.between(0, 1))


@query("i14_text_anomaly_job", """
, t as (select fraudulent from v3 where year(filing_date) between 2018 and 2023 and len(regexp_extract_all(mda, '[^\\s]+')) >= 200)
select 'tfidf_iforest' as experiment, count(*) as n_samples, cast(sum(fraudulent) as bigint) as n_fraud, round(avg(fraudulent), 6) as fraud_ratio,
  true as in_range from t""", ["v3"])
def i14(spark, sf):
    docs = view(spark, sf, "v3").withColumn("filing_date", F.col("filing_date").cast("string"))
    scored = anomaly_job.score_text(docs, "doc_id", stop_words=STOPS)
    record = anomaly_job.report(scored, "doc_id", "fraudulent", "tfidf_iforest")
    return record.select("experiment", "n_samples", "n_fraud", F.round("fraud_ratio", 6).alias("fraud_ratio"), in_range(record).alias("in_range"))


@query("i14_vector_anomaly_job", VECTORS + """
select 'vectors_iforest' as experiment, count(*) as n_samples, cast(sum(y) as bigint) as n_fraud, round(avg(y), 6) as fraud_ratio,
  true as in_range from lv where split = 'test'""")
def i14_vectors(spark, sf):
    record = anomaly_job.report(anomaly_job.score_vectors(labelled_vectors(spark, sf), "vec_id", "embedding", "y"), "vec_id", "y", "vectors_iforest")
    return record.select("experiment", "n_samples", "n_fraud", F.round("fraud_ratio", 6).alias("fraud_ratio"), in_range(record).alias("in_range"))


def planted(rows, far=6.0):
    """Ready vectors with known anomalies: in the test part, those of every twentieth id lie ``far`` times as far out."""
    out = (F.col("split") == "test") & (F.col("vec_id") % 20 == 0)
    return rows.select("vec_id", "split", out.cast("int").alias("is_planted"), F.when(out, F.transform("embedding", lambda x: x * F.lit(far)))
                       .otherwise(F.transform("embedding", lambda x: x * F.lit(1.0))).alias("embedding"))


def planted_found(scored, least=0.95):
    """Rows, planted rows, and whether the scores put these before the others, as scores without information cannot."""
    found = evaluate.roc_auc(scored, "is_planted", "anomaly_score").select((F.col("roc_auc") >= least).alias("ranked_first"))
    counts = scored.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("is_planted").cast("long").alias("n_planted"))
    return counts.withColumn("ranked_first", found.scalar())


@query("i14_planted_anomalies", VECTORS + """
select count(*) as n_samples, cast(count(*) filter (vec_id % 20 = 0) as bigint) as n_planted, true as ranked_first from lv where split = 'test'""")
def i14_planted(spark, sf):
    return planted_found(anomaly_job.score_vectors(planted(labelled_vectors(spark, sf)), "vec_id", "embedding", "is_planted"))


@query("i15_expanding_evaluation", """
, w as (select fraudulent, year(filing_date) as y, cast(e as int) as window_end from v3, range(2003, 2015) r(e)
  where year(filing_date) between 2003 and e or year(filing_date) = e + 3),
s as (select window_end, count(*) filter (y <> window_end + 3) as train_rows, count(*) filter (y = window_end + 3) as test_rows,
  count(distinct fraudulent) filter (y <> window_end + 3) as classes from w group by 1)
select window_end, train_rows, test_rows, case when classes > 1 and test_rows > 0 then test_rows end as evaluated,
  case when classes > 1 and test_rows > 0 then true end as in_range from s""", ["v3"])
def i15(spark, sf):
    rows = encoded(spark, sf).join(view(spark, sf, "v3").select("doc_id", "filing_date", "fraudulent"), "doc_id")
    windows = splits.expanding_windows(materialize(rows, "encoded"), "filing_date")
    out = classify.expanding_evaluation(windows, "embedding", "fraudulent")
    scores = F.array("accuracy", "macro_precision", "macro_recall", "macro_f1")
    return out.select("window_end", "train_rows", "test_rows", F.col("n").alias("evaluated"),
                      F.when(F.col("n").isNotNull(), F.forall(scores, lambda x: x.between(0, 1))).alias("in_range"))


def outcome(compared):
    """What SQL can derive of a comparison: rows and classes of the test part, and measures in range."""
    scores = F.array("accuracy", "macro_precision", "macro_recall", "macro_f1", "roc_auc")
    return compared.select("model", "n", (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"),
                           F.forall(scores, lambda x: x.between(0, 1)).alias("in_range"),
                           ((F.col("model") == "forest") | F.col("best_round").between(1, 1000)).alias("stopped"))


@query("supervised_topic_job", """
, t as (select fraudulent from v3 where year(filing_date) = 2011)
select unnest(['forest', 'boosted']) as model, count(*) as n, count(*) filter (fraudulent = 0) as negatives, count(*) filter (fraudulent = 1) as positives,
  true as in_range, true as stopped from t""", ["v3"])
def supervised_topics(spark, sf):
    docs = view(spark, sf, "v3").withColumn("word_count", tx.word_count("mda"))
    train, validation, test = supervised_job.delayed_parts(docs, "doc_id", "filing_date", "fraudulent", words="word_count")
    parts = supervised_job.topic_features(train, [validation, test], "doc_id", "mda", TOPIC_TERMS, keep=["fraudulent"])
    return outcome(supervised_job.compare_classifiers(*parts, "topics", "fraudulent"))


@query("supervised_tabular_job", LABELLED_SQL + """
select unnest(['forest', 'boosted']) as model, count(*) as n, count(*) filter (fraudulent = 0) as negatives, count(*) filter (fraudulent = 1) as positives,
  true as in_range, true as stopped from kept where year(reporting_date) >= 2000""", ["v1", "v2"])
def supervised_tabular(spark, sf):
    rows = labelled(spark, sf).select("filing_id", "cik", "name", "city", "state", "sic", "incorp_state", "filing_type", "reporting_date",
                                      "filing_date", "amount", "fraudulent")
    rows = materialize(rows.withColumn("year", F.year("reporting_date")), "rows")
    made = supervised_job.tabular_features(rows, ["filing_id", "fraudulent", "year"], ["city", "state", "sic", "incorp_state", "filing_type"],
                                           ["reporting_date", "filing_date"])
    made = materialize(made, "features")
    early = materialize(splits.stratified_split(made.filter("year < 2000"), "filing_id", "fraudulent", 0.2), "early")
    return outcome(supervised_job.compare_classifiers(part(early, "train"), part(early, "validation"), made.filter("year >= 2000"), "features", "fraudulent"))
