from brute import hits, near_components, without_repeats

import corpus_pipeline
from filingsift.llm import language_id


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "12 345 !", "en", "s", 0), (9004, "ça va", None, None, None)],
                                docs.schema)
    docs = docs.unionByName(odd)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now = [(r.doc_id, r.text) for r in docs.collect()]
    predicted = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf_dir)
        got = {r.doc_id: r for r in result.collect()}
        if number == 0:
            now = [(i, t) for i, t in now if predicted[i].lang_pred != "und" and (predicted[i].score >= 0.1 or len(t) < 60)]
            assert not {9001, 9002, 9003} & {i for i, _ in now}
        elif number == 1:
            group = near_components(dict(now), 80)
            now = [(i, t) for i, t in now if group[i] == i]
        elif number == 2:
            cut = {i: " ".join(kept) if len(kept) < len(w) else None for i, kept, w in without_repeats(now)}
            now = [(i, t if cut[i] is None else cut[i]) for i, t in now if cut[i] != ""]
        elif number == 3:
            kept = []
            for i, t in now:
                words, hit, _ = hits(t, items) if any(item[:20].lower() in t.lower() or True for _, item in items[:1]) else ([], set(), set())
                if not (hit and 20 * len(hit) >= len(words)):
                    kept.append((i, t, bool(hit)))
            assert {i: got[i].text for i, _, h in kept if not h} == {i: t for i, t, h in kept if not h}
            now = [(i, got[i].text) for i, _, _ in kept]
        else:
            assert all(r.lossless and r.n_pieces == len(r.pieces) for r in got.values())
        if number < 4:
            assert result.columns == docs.columns
            docs = result
        assert {i: r.text for i, r in got.items()} == dict(now)
    assert len(now) > 50


def test_run_on_the_tables(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.filter("not lossless or n_pieces <> size(pieces)").count() == 0 and rows.count() > 50
