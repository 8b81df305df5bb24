import math
import random

import pytest
from pyspark.sql import functions as F

from dupelens.functions import porter
from dupelens.operators import candidates, corpus, dense, features, ids, index, ml, ranking, reports, similarity, sparse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_best_answer(spark):
    schema = "id int, question_id int, score int, body string, post_date string, accepted boolean"
    answers = spark.createDataFrame(
        [(1, 1, 1, "", "d3", True), (2, 1, 9, "", "d2", False), (3, 1, 2, "", "d1", False), (4, 2, 9, "", "d2", False), (5, 2, 2, "", "d1", False), (6, 3, 5, "", "d2", False), (7, 3, 5, "", "d1", False)],
        schema,
    )
    assert rows(corpus.best_answers(answers)) == [(1, 1), (4, 2), (7, 3)]


def test_tags_match_whole(spark):
    q = spark.createDataFrame([(1, "Unity3D,c#"), (2, "unity3d-gui"), (3, None)], "id int, tags string")
    assert [r["id"] for r in corpus.with_any_tag(q, ["unity3d"]).collect()] == [1]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(7)
    assert rows(corpus.dense_index(df, "id", "n").select("id", "n")) == [(k, k) for k in range(1000)]
    assert corpus.dense_index(spark.range(0), "id", "n").count() == 0


def tf_of(spark, docs):
    tokenized = spark.createDataFrame(docs, "id long, toks array<string>")
    return tokenized, index.term_freq(tokenized, "toks")


def test_bm25_with_negative_idf(spark):
    tokenized, tf = tf_of(spark, [(1, ["black", "cat", "white", "cat"]), (2, ["cat", "outer", "space"]), (3, ["wag", "dog"])])
    idf = {r["term"]: r["idf"] for r in index.bm25_idf(tf, 3).collect()}
    one = math.log(2.5) - math.log(1.5)
    # seven terms, of which one has a negative idf
    mean = (6 * one - one) / 7
    assert idf["dog"] == pytest.approx(one) and idf["cat"] == pytest.approx(0.25 * mean)
    w = {(r["id"], r["term"]): r["w"] for r in index.bm25(tf, index.lengths(tokenized, "toks"), 3).collect()}
    assert w[1, "cat"] == pytest.approx(2 * idf["cat"] * 1.05 / (2 + 0.05 * (1 - 0.03 + 0.03 * 4 / 3)))
    found = {r["id"]: r["score"] for r in similarity.bm25_query(index.bm25(tf, index.lengths(tokenized, "toks"), 3), ["dog", "dog", "none"]).collect()}
    assert found == {3: pytest.approx(2 * w[3, "dog"])}


def test_tfidf_rows_have_unit_length(spark):
    _, tf = tf_of(spark, [(1, ["a", "b", "b"]), (2, ["b"]), (3, [])])
    w = {(r["id"], r["term"]): r["w"] for r in index.tfidf(tf, 3).collect()}
    a, b = math.log(4 / 2) + 1, 2 * (math.log(4 / 3) + 1)
    assert w[1, "a"] == pytest.approx(a / math.hypot(a, b)) and w[2, "b"] == pytest.approx(1)


def test_jaccard_of_arrays(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(similarity.jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]


def test_vector_measures(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("x"), F.col("y"))).collect()] == [0.0, 1.0, 0.0]
    jsd = [r[0] for r in df.limit(2).select(similarity.jensen_shannon(F.col("x"), F.col("y"))).collect()]
    assert jsd == [pytest.approx(1 - math.sqrt(math.log(2))), pytest.approx(1)]


def test_ties_share_the_mean_rank(spark):
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.5), (1, 5, 0.1)], "dup_id long, main_id long, score double")
    assert [r["rank"] for r in ranking.average_ranks(scores).orderBy("main_id").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_questions_that_share_nothing_are_counted_in_ranks(spark):
    comp = spark.createDataFrame([(k,) for k in (2, 3, 4, 5, 6)], "id long")
    pairs = spark.createDataFrame([(1, 3), (7, 2), (9, 8)], "dup_id long, main_id long")
    scores = spark.createDataFrame([(1, 2, 0.4)], "dup_id long, main_id long, score double")
    assert rows(ranking.pair_ranks(scores, pairs, comp)) == [(1, 3, 0.0, 3.5), (7, 2, 0.0, 3.0)]
    negative = spark.createDataFrame([(1, 3, -0.4), (1, 2, 0.4)], "dup_id long, main_id long, score double")
    assert rows(ranking.pair_ranks(negative, pairs.where("dup_id = 1"), comp)) == [(1, 3, -0.4, 5.0)]


def test_candidates_are_filled_up(spark):
    comp = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    dups = spark.createDataFrame([(1,), (9,)], "id long")
    scores = spark.createDataFrame([(1, 4, 0.5)], "dup_id long, main_id long, score double")
    got = candidates.top_candidates(scores, dups, comp, 3)
    assert rows(got.select("dup_id", "rk", "candidate_id", "score")) == [(1, 1, 4, 0.5), (1, 2, 2, 0.0), (1, 3, 3, 0.0), (9, 1, 1, 0.0), (9, 2, 2, 0.0), (9, 3, 3, 0.0)]


def test_undersampling_quotas(spark):
    data = [(d, 100 * d + k, 0.0, k, k == 0 and d < 3, False) for d in range(1, 5) for k in range(6)]
    c = spark.createDataFrame(data, "dup_id long, candidate_id long, score double, rk int, is_dup boolean, is_noise boolean")
    got = candidates.undersample(c, 0.25)
    assert rows(got.where("not is_dup").groupBy("dup_id").count()) == [(1, 2), (2, 2), (3, 1), (4, 1)]
    assert got.where("is_dup").count() == 2
    assert candidates.undersample_if_rare(c, 0.01).count() == 24


def test_folds(spark):
    c = spark.createDataFrame([(k, k >= 7) for k in range(9)], "dup_id long, is_noise boolean")
    got = rows(ids.folds(c, 5).groupBy("fold").count())
    assert got == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 1)]


def test_sampling_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        ids.sample(spark.range(3), 4)
    assert ids.sample(spark.range(3), 4, clip=True).count() == 3


def test_large_samples_are_those_of_small_ones(spark, monkeypatch):
    ids_ = spark.range(500).repartition(5)
    one = rows(ids.sample(ids_, 137, seed=3))
    monkeypatch.setattr(ids, "SMALL_SAMPLE", 0)
    assert rows(ids.sample(ids_, 137, seed=3)) == one and len(one) == 137
    assert ids.sample(ids_, 900, clip=True).count() == 500


def test_terms_are_counted_in_their_documents(spark):
    docs = [(1, ["b", "a", "b", "x’y_z"]), (2, []), (3, None), (4, ["a"])]
    tokenized = spark.createDataFrame(docs, "id long, toks array<string>").repartition(2)
    tf = index.term_freq(tokenized, "toks")
    assert rows(tf) == [(1, "a", 1), (1, "b", 2), (1, "x’y_z", 1), (4, "a", 1)]
    # runs of two or more word characters
    assert rows(index.words_of_terms(tf)) == [(1, "y_z", 1)]
    stems = tokenized.select("id", porter.stemmed(F.array_append("toks", "games")).alias("s"))
    assert rows(stems)[1:] == [(2, ["game"]), (3, None), (4, ["a", "game"])]


def test_features_of_pairs_come_from_shared_terms(spark):
    tokenized, tf = tf_of(spark, [(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, ["d"])])
    w = {"jaccard": tf, "tfidf": index.tfidf(tf, 3), "bm25": index.bm25(tf, index.lengths(tokenized, "toks"), 3)}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "dup_id long, main_id long")
    got = {(r["dup_id"], r["main_id"]): r for r in similarity.score_features(pairs, {("p", m): x for m, x in w.items()}).collect()}
    for m, weights in w.items():
        every = {(r["dup_id"], r["main_id"]): r["score"] for r in similarity.score_all(weights, m, tokenized.select("id"), tokenized.select("id")).collect()}
        assert all(got[k][f"p_{m}_sim"] == pytest.approx(every.get(k, 0.0)) for k in got)


def test_score_all_serves_vectors(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, v array<double>")
    got = similarity.score_all(v, "mpnet", v.where("id < 2").select("id"), v.select("id"))
    assert got.count() == 8 and all(-1 <= r["score"] <= 1 for r in got.collect())


def test_the_two_recall_rates_have_their_own_denominators(spark):
    pred = spark.createDataFrame([(1, 10, True, 0.9), (1, 11, False, 0.5), (2, 12, False, 0.5)], "dup_id long, candidate_id long, is_dup boolean, pred double")
    assert ranking.recall_by_score(pred, "pred", ks=(1,)).first()[0] == 0.5
    ranks = spark.createDataFrame([(1, 10, 1.0)], "dup_id long, main_id long, rank double")
    assert ranking.recall_rates(ranks, ks=(1,)).first()[0] == 1.0


def test_misclassified(spark):
    schema = "dup_id long, candidate_id long, is_dup boolean, pred double"
    pred = spark.createDataFrame([(1, 10, True, 0.9), (2, 20, False, 0.9), (2, 21, True, 0.1), (3, 30, False, 0.2)], schema)
    pairs = spark.createDataFrame([(3, 33), (3, 32), (2, 21)], "dup_id long, main_id long")
    got = reports.misclassified(pred, pairs, 1)
    assert rows(got.select("dup_id", "main_id", "top_ranked", "has_dup")) == [(2, 21, 20, True), (3, 32, 30, False)]
    assert reports.misclassified(pred.where("false"), pairs).count() == 0
    assert tuple(reports.misclassified_counts(pred, got).first()) == (3, 2, 67, 1, 50)


def test_classifier_and_search(spark):
    data = [(d, 100 + 10 * d + k, k == 0, False, float(k == 0) + 0.01 * k) for d in range(12) for k in range(4)]
    pairs = spark.createDataFrame(data, "dup_id long, candidate_id long, is_dup boolean, is_noise boolean, a_sim double")
    model = ml.train_classifier(pairs, {"numTrees": 5, "maxDepth": 3, "balanced": True})
    assert ml.evaluate(model, pairs).first()["rr_5"] == 1.0
    found = ml.search(pairs, 2, 3, grid={"numTrees": (2, 3), "maxDepth": (2,)})
    assert found.count() == 2 and "numTrees" in ml.best_params(found)
    assert features.feature_faults(pairs, pairs).first().asDict() == {"self_pairs": 0, "repeated": 0, "nulls": 0, "missing": 0}


def test_topics_take_every_term_and_every_document(spark):
    n = 270_000  # more than the library's own bound of 1 << 18
    tokenized = spark.range(270).select("id", F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda x: F.concat(F.lit("t"), x.cast("string"))).alias("toks"))
    model, counts = ml.topic_model(tokenized, "toks", k=2, iterations=1)
    assert model.vocabSize() == n and all(r["counts"].numNonzeros() == 1000 for r in counts.limit(3).collect())
    assert model.getSubsamplingRate() == 1.0
    found = ml.topics(tokenized.limit(5), "toks", k=2, iterations=1).collect()
    assert len(found) == 5 and all(sum(r["v"]) == pytest.approx(1) for r in found)


@pytest.mark.parametrize("measure", ["dense", "topic_jsd"])
def test_dense_ranks_and_best_are_those_of_a_complete_table(spark, measure, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    # 40 vectors, with equal ones and one of zeros
    v = spark.createDataFrame([(k, [float(k % 5), float(k % 3 + 1), float(k % 4)]) for k in range(40)] + [(40, [0.0, 0.0, 0.0])], "id long, v array<double>")
    if measure == "topic_jsd":
        v = v.where("id < 40").select("id", F.transform("v", lambda x: x / F.aggregate("v", F.lit(0.0), lambda s, y: s + y)).alias("v"))
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 9), (5, 33), (6, 6), (7, 99)], "dup_id long, main_id long")
    dups, comp = pairs.selectExpr("dup_id id").distinct(), v.select("id")
    every = dups.selectExpr("id dup_id").crossJoin(comp.selectExpr("id main_id")).where("dup_id != main_id")
    scores = similarity.vector_pairs(every, v, similarity.DENSE[measure])
    mine = rows(dense.pair_ranks(v, measure, pairs, comp))
    assert len(mine) == 4
    for a, b in zip(mine, rows(ranking.pair_ranks(scores, pairs, comp)), strict=True):
        assert a == pytest.approx(b)
    best = sorted(((r["dup_id"], -round(r["score"], 6), r["main_id"]) for r in scores.collect()))
    want = [(d, m) for d in sorted({x[0] for x in best}) for m in [x[2] for x in best if x[0] == d][:10]]
    got = dense.top_candidates(v, measure, dups, comp, 10).orderBy("dup_id", "rk").collect()
    assert [(r["dup_id"], r["candidate_id"]) for r in got] == want


def test_document_vectors_take_25_passes(spark):
    tokenized = spark.createDataFrame([(k, [f"w{(k + j) % 7}" for j in range(12)]) for k in range(20)], "id long, toks array<string>")
    found, named, one = (dict(rows(ml.document_vectors(tokenized, "toks", size=4, **more))) for more in ({}, {"iterations": 25}, {"iterations": 1}))
    assert found == named != one


@pytest.mark.parametrize("measure", ["jaccard", "tfidf", "bm25"])
def test_blocks_of_postings_give_what_every_pair_does(spark, measure, monkeypatch):
    """Many small blocks, frequent and rare terms, ties, negative and zero weights, questions without a term, duplicates among the comparison questions."""
    draw = random.Random(7)
    docs = {k: {w: draw.choice([-0.25, 0.0, 0.5, 1.0]) if measure == "bm25" else draw.choice([0.25, 0.5, 1.0]) for w in draw.choices("abcdefghijklmnop", [2.0**-j for j in range(16)], k=draw.randrange(0, 7))} for k in range(90)}
    weights = spark.createDataFrame([(k, w, 1 + (k + ord(w)) % 3, x) for k, terms in docs.items() for w, x in terms.items()], "id long, term string, tf long, w double")
    dups, comp = [k for k in docs if k % 2], [k for k in docs if k % 3]
    side = {"jaccard": lambda k, w: (1.0, 1.0), "tfidf": lambda k, w: (docs[k][w],) * 2, "bm25": lambda k, w: (1.0 + (k + ord(w)) % 3, docs[k][w])}[measure]
    every = {}
    for a in dups:
        for b in comp:
            if a != b and (common := docs[a].keys() & docs[b].keys()):
                s = sum(side(a, w)[0] * side(b, w)[1] for w in common)
                every[a, b] = s / (len(docs[a]) + len(docs[b]) - s) if measure == "jaccard" else s
    monkeypatch.setattr(sparse, "BLOCK", 20)
    monkeypatch.setattr(sparse, "POSTINGS", 60)
    left, right = (spark.createDataFrame([(k,) for k in x], "id long") for x in (dups, comp))
    got = {(r["dup_id"], r["main_id"]): r["score"] for r in similarity.score_all(weights, measure, left, right).collect()}
    assert got.keys() == every.keys() and all(got[k] == pytest.approx(v) for k, v in every.items())
    table = spark.createDataFrame([(*k, v) for k, v in every.items()], "dup_id long, main_id long, score double")
    assert rows(candidates.top_candidates(similarity.score_best(weights, measure, left, right, 5), left, right, 5)) == rows(candidates.top_candidates(table, left, right, 5))
    pairs = spark.createDataFrame([(a, b) for a in dups for b in comp[a % 5 :: 9]] + [(1, 1), (3, 999)], "dup_id long, main_id long")
    mine, theirs = rows(sparse.pair_ranks(weights, measure, pairs, right)), rows(ranking.pair_ranks(table, pairs, right))
    assert len(mine) > 300 and mine == [(a, b, pytest.approx(s), r) for a, b, s, r in theirs]


def test_only_compared_documents_have_rows_and_are_not_shuffled(spark):
    tokenized, tf = tf_of(spark, [(1, ["a_b", "b_b", "b_b"]), (2, ["b_b", "c_c"]), (3, ["d_d", "b_b"]), (4, []), (5, None)])
    some = tokenized.where("id < 3")
    made = dict(zip(("jaccard", "tfidf", "bm25"), similarity.represent(tokenized, "toks", "jaccard", "tfidf", "bm25", some=some), strict=True))
    want = {"jaccard": tf, "tfidf": index.tfidf(index.words_of_terms(tf), 5), "bm25": index.bm25(tf, index.lengths(tokenized, "toks"), 5)}
    for measure, documents in made.items():
        assert documents.count() == 2
        got, every = index.postings(documents), want[measure].where("id < 3")
        assert [pytest.approx(x) if isinstance(x, float) else x for r in rows(every.select(*got.columns)) for x in r] == [x for r in rows(got) for x in r]
        plan = sparse.documents(documents, some, sparse.factors(measure)[0])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_neighbours_and_features_in_small_blocks_are_those_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK", 5)
    monkeypatch.setattr(sparse, "PRODUCTS", 7)
    draw = random.Random(3)
    tokenized, tf = tf_of(spark, [(k, draw.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], [64, 32, 16, 8, 4, 2, 1], k=draw.randrange(0, 6))) for k in range(40)])
    w = index.bm25(tf, index.lengths(tokenized, "toks"), 40)
    ids_ = tokenized.where("id % 4 = 1").select("id")
    every = {(r["dup_id"], r["main_id"]): r["score"] for r in similarity.score_all(w, "bm25", tokenized.select("id"), tokenized.select("id")).collect()}
    got = similarity.most_similar(tokenized, "toks", ids_, 3).collect()
    for d in range(1, 40, 4):
        best = sorted((-round(s, 6), m) for (a, m), s in every.items() if a == d)[:3]
        assert [(pytest.approx(r["score"]), r["main_id"]) for r in sorted(got, key=lambda r: r["rk"]) if r["dup_id"] == d] == [(-s, m) for s, m in best]
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a % 3, 40, 3)] + [(1, 99)], "dup_id long, main_id long")
    found = similarity.score_features(pairs, {("p", "bm25"): w}).where("dup_id != main_id").collect()
    assert len(found) > 400 and all(r["p_bm25_sim"] == pytest.approx(every.get((r["dup_id"], r["main_id"]), 0.0)) for r in found)


def test_nothing_shuffled_is_left_when_a_table_is_stored(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    there, setting = files(), spark.conf.get(index.CLEANUP)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert index.stored(counted).count() == 7 and rows(index.stored(counted)) == rows(counted)
    one = files()
    index.stored(counted)
    assert spark.conf.get(index.CLEANUP) == setting and files() <= one
    index.stored(spark.range(1000).repartition(3))
    assert files() <= one | there
