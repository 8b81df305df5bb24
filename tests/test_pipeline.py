from pyspark.ml.feature import Word2VecModel

from dupelens.plans.pipeline import Settings, Study
from dupelens.sources import tables


def test_study_from_texts_to_evaluation(spark, small, tmp_path):
    study = Study(spark, str(tmp_path), Settings(measures=("jaccard", "tfidf"), parts=("title", "title_body_tags_answer"), n_candidates=(5, 20), undersampling=0.25, search_iterations=0, forest={"numTrees": 3, "maxDepth": 3}))
    study.ingest("all", tables.questions(spark, small), tables.answers(spark, small), tables.dup_pairs(spark, small))
    study.subset_by_tags("all", "english", ["EN"])
    study.sample("all", "half", 100, 7)
    assert study.read("question_texts", dataset="half").count() == 100
    assert study.read("dup_pairs", dataset="english").count() <= study.read("dup_pairs", dataset="all").count()
    study.run(["all"])
    assert study.read("all_pair_ranks", dataset="all").count() == 4
    evaluated = study.read("candidates_evaluation").collect()
    assert sorted(r["candidates"] for r in evaluated) == [5, 20] and all(0 <= r["rr_20"] <= 1 for r in evaluated)
    assert study.read("cross_dataset_performance").count() == 1
    assert "top_ranked_url" in study.read("misclassified_duplicates", dataset="all").columns


def letters():
    return lambda texts: [[float(t.count(c)) for c in "aeinorst"] for t in texts]


def test_study_with_encoders_and_models(spark, small, tmp_path):
    study = Study(spark, str(tmp_path), Settings(measures=("bm25",), dense=("doc2vec",), encoders={"mpnet": letters}, parts=("title",), retrieval=("bm25", "title"), n_candidates=(10,), undersampling=0.25, forest={"numTrees": 2, "maxDepth": 2}, search_iterations=1, folds=2))
    study.ingest("all", tables.questions(spark, small), tables.answers(spark, small), tables.dup_pairs(spark, small))
    study.sample("all", "some", 60, 3)
    assert study.read_all("question_texts", ["all", "some"]).groupBy("dataset").count().count() == 2
    for stage in (study.preprocess, study.id_sets, study.representations, study.ranks, study.candidates, study.features):
        stage("all")
    assert {r["feature"] for r in study.read("all_pair_ranks", dataset="all").collect()} == {"bm25", "doc2vec", "mpnet"}
    wide = study.read("test_set", dataset="all", n=10)
    assert {"title_bm25_sim", "title_doc2vec_sim", "title_mpnet_sim"} <= set(wide.columns)
    assert Word2VecModel.load(study.catalog.path("feature_model", dataset="all", model="doc2vec", col="title")).getVectorSize() == 30


def test_dense_measures_are_ranked(spark, tmp_path):
    study = Study(spark, str(tmp_path), Settings(measures=(), dense=("doc2vec",), parts=("title",)))
    for name, rows, schema in (
        ("dup_pairs", [(2, 1)], "dup_id long, main_id long"),
        ("comparison_question_ids", [(1,), (2,), (3,)], "id long"),
        ("duplicate_question_ids", [(2,)], "id long"),
    ):
        study.write(spark.createDataFrame(rows, schema), name, dataset="x")
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    study.write(vectors, "embedding", dataset="x", model="doc2vec", col="title")
    assert [(r["feature"], r["col"], r["recall_5"]) for r in study.ranks("x").collect()] == [("doc2vec", "title", 1.0)]
    assert study.read("pair_ranks", dataset="x", feature="doc2vec", col="title").first()["rank"] == 1.0
