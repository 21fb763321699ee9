import random

import corpus_pipeline
from strandloom.llm import exact_dedup, sentencepiece_codec, source_mixing, toxicity
from tests.llm.test_dedup import _family, brute


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    rows = _family(rng, 80, 30, 2, 0) + _family(rng, 90, 10, 0, 100)
    for i in range(160):
        words = ["".join(rng.choices("klmnrst", k=3)) + rng.choice("aeiou") for _ in range(60)]
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rng.randrange(60), "vorg" + rng.choice("aeiou") + rng.choice("bdfg"))
        rows.append((200 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int("vorg" in t)) for i, t in rows if i >= 200], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    left = [(i, t) for i, t in rows if scorer.score(scorer.evidence(t)[1]) < toxicity.THRESHOLD]
    assert not any("vorg" in t for _, t in left) and len(left) == sum("vorg" not in t for _, t in rows)
    last = {t.lower(): i for i, t in sorted(left)}
    left = [(i, t) for i, t in left if last[t.lower()] == i]
    same = brute(left, 5, 80)
    left = [(i, t) for i, t in left if same[i][1] == i]
    kept = docs.join(spark.createDataFrame([(i,) for i, _ in left], "doc_id long"), "doc_id", "left_semi")
    copies = {r.doc_id: r.copies for r in source_mixing.taken(kept).collect()}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    want = sorted((i, codec.encode(t)) for i, t in left for _ in range(copies[i]))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "source_mixing", "sentencepiece"]


def test_edges_and_held_results(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, evidence string, ids string, row long, digest string"
    texts = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "some words that only one row has here"), (4, "Twice the same text in capitals and not"), (5, "twice THE same text in capitals and not"), (6, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, None, None if i == 6 else "s", 0, "mine", "mine", 7, "mine") for i, t in texts], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = exact_dedup.resolve(docs)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {*docs.columns, "n_tokens"} - {"text"} and dict(got.dtypes)["ids"] == "array<int>"
    rows = got.collect()
    assert all(r.evidence == "mine" and r.row == 7 and r.digest == "mine" for r in rows)
    assert {r.doc_id for r in rows} <= {2, 3, None, 5, 6} and held.count() == len(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [0, 2, 3, 5, 6]
    # both texts of five words or more that differ in case are near copies; texts without words all stay
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 1, 2, 2, 3, 4, 6]
