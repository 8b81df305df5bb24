"""The registered queries: each runs operators over whole tables. SQL equivalents are in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, porter, text
from ..operators import candidates, corpus, dense, features, ids, index, ml, ranking, reports, similarity, sparse
from ..sources import tables, xml

PART = "title_body_tags_answer"
TOP = 20
STUDY_TAGS = ["fr", "de", "src3", "SRC7"]


def _words(spark: SparkSession, d: str, part: str = PART, ids: DataFrame | None = None) -> DataFrame:
    """id and the words of one part, of all questions or of those with the ids. The texts of documents hold no HTML, so none is taken off."""
    q = tables.texts(spark, d)
    joined = corpus.with_best_answer_apart(q if ids is None else index.among(q, "id", ids), tables.answers(spark, d))
    merged = corpus.merged_parts(joined)
    return merged.select("id", text.tokens(F.col(part)).alias(part))


def _tokenized(spark: SparkSession, d: str, part: str = PART, ids: DataFrame | None = None) -> DataFrame:
    """id and the stemmed tokens of one part."""
    return _words(spark, d, part, ids).select("id", porter.stemmed(F.col(part)).alias(part))


def _world(spark: SparkSession, d: str):
    """questions, pairs, duplicates and comparison questions."""
    q, p = tables.questions(spark, d), tables.dup_pairs(spark, d)
    return q, p, ids.duplicates(q, p), ids.comparison(q, p)


def _kept_world(spark: SparkSession, d: str):
    """_world(), with all but the questions computed once: texts are hashed for the pairs."""
    q, p = tables.questions(spark, d), index.stored(tables.dup_pairs(spark, d))
    return q, p, index.stored(ids.duplicates(q, p)), index.stored(ids.comparison(q, p))


def _represented(spark: SparkSession, d: str, *measures: str, ids: DataFrame | None = None) -> list[DataFrame]:
    """Weights with a row a document, of all or of those with the ids; frequencies are those of all."""
    return similarity.represent(_tokenized(spark, d), PART, *measures, some=None if ids is None else _tokenized(spark, d, PART, ids))


def _weights(spark: SparkSession, d: str, measure: str, ids: DataFrame | None = None) -> DataFrame:
    return _represented(spark, d, measure, ids=ids)[0]


def _scores(spark: SparkSession, d: str, measure: str) -> DataFrame:
    _, _, dups, comp = _kept_world(spark, d)
    return similarity.score_all(_weights(spark, d, measure, dups.union(comp)), measure, dups, comp)


def tag_filter(spark, d):
    return corpus.with_any_tag(tables.questions(spark, d), STUDY_TAGS).select("id", "tags")


def best_answer(spark, d):
    return corpus.best_answers(tables.answers(spark, d))


def question_with_answer(spark, d):
    q = corpus.with_best_answer(tables.questions(spark, d), tables.answers(spark, d))
    return q.select("id", "n_answers", F.length("title").alias("title_length"), F.md5("answer").alias("answer_md5"))


def answered_without_best(spark, d):
    return corpus.answered_without_best(tables.answers(spark, d))


def bm25_neighbours(spark, d):
    """The documents most alike the mains, themselves included."""
    q, p, *_ = _kept_world(spark, d)
    return similarity.most_similar(_tokenized(spark, d), PART, ids.mains(q, p), 3, include_self=True)


def corpus_index(spark, d):
    c = corpus.build_corpus(tables.questions(spark, d), tables.answers(spark, d), html=False)
    return c.select("id", "corpus_index", F.length(PART).alias("length"))


def corpus_faults(spark, d):
    q = tables.questions(spark, d)
    return corpus.corpus_faults(corpus.build_corpus(q, tables.answers(spark, d), html=False), q)


def dup_pairs(spark, d):
    return tables.dup_pairs(spark, d)


def duplicate_ids(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.duplicates(q, p)


def main_ids(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.mains(q, p)


def answered_ids(spark, d):
    return ids.answered(tables.questions(spark, d))


def comparison_ids(spark, d):
    return _world(spark, d)[3]


def pairs_both_in_set(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.within(p, corpus.with_any_tag(q, ["en", "fr"]))


def questions_in_pairs(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.in_pairs(q, p).select("id", F.lit(True).alias("in_pair")).union(ids.not_in_pairs(q, p).select("id", F.lit(False)))


def noise_sample(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.noise(q, p)


def train_test_split(spark, d):
    return ids.split(_world(spark, d)[2])


def stratified_sample(spark, d):
    q, p, *_ = _world(spark, d)
    return ids.sample_with_pairs(q, p, q.count() // 2)


def html_to_text(spark, d):
    return tables.read(spark, d, "pages").select("page_id", text.process_html(F.col("html")).alias("text"))


def html_to_text_parsed(spark, d):
    return tables.read(spark, d, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


def tokenize_counts(spark, d):
    t = _tokenized(spark, d)
    return t.select("id", F.size(PART).alias("n_tokens"), F.size(F.array_distinct(PART)).alias("n_terms"), F.md5(F.array_join(PART, " ")).alias("tokens_md5"))


def stemmed_terms(spark, d):
    tf = index.term_freq(_words(spark, d), PART)
    return porter.with_stems(tf).groupBy("term").agg(F.sum("tf").alias("n"), F.count_distinct("id").alias("docs"))


def term_freq(spark, d):
    return index.term_freq(_tokenized(spark, d), PART)


def doc_freq(spark, d):
    return index.doc_freq_of(_tokenized(spark, d), PART)


def tfidf_weights(spark, d):
    return index.postings(_weights(spark, d, "tfidf")).select("id", "term", F.round("w", 6).alias("w"))


def bm25_idf(spark, d):
    t = _tokenized(spark, d)
    return index.bm25_idf(index.term_freq(t, PART), t.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_weights(spark, d):
    return index.postings(_weights(spark, d, "bm25")).select("id", "term", "tf", F.round("w", 6).alias("w"))


def _pairs_query(measure):
    def query(spark, d):
        return _scores(spark, d, measure).select("dup_id", "main_id", F.round("score", 5).alias("score"))

    return query


def bm25_query(spark, d):
    return similarity.bm25_query(index.postings(_weights(spark, d, "bm25")), ["onin", "tion", "tion", "ther", "nosuchterm"]).select("id", F.round("score", 5).alias("score"))


def _topk_query(measure):
    def query(spark, d):
        _, _, dups, comp = _kept_world(spark, d)
        return candidates.top_candidates(similarity.score_best(_weights(spark, d, measure, dups.union(comp)), measure, dups, comp, TOP), dups, comp, TOP)

    return query


def _vectors(spark, d):
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_pairs(spark, d):
    """Vectors of one label beside the least id of the label."""
    v = _vectors(spark, d)
    firsts = v.groupBy(F.col("label").alias("l")).agg(F.min("id").alias("main_id"))
    return v.join(firsts, F.col("label") == F.col("l")).where("id != main_id").select(F.col("id").alias("dup_id"), "main_id"), v.select("id", "v")


def dense_cosine_pairs(spark, d):
    pairs, v = _vector_pairs(spark, d)
    return similarity.vector_pairs(pairs, v, similarity.cosine).withColumn("score", F.round("score", 5))


def dense_cosine_topk(spark, d):
    """The vectors most alike those that are not the first of their label, among all."""
    pairs, v = _vector_pairs(spark, d)
    return dense.top_candidates(v, "dense", pairs.select(F.col("dup_id").alias("id")), v, TOP)


def dense_pair_ranks(spark, d):
    """Ranks of the first vector of a label among all."""
    pairs, v = _vector_pairs(spark, d)
    return dense.pair_ranks(v, "dense", pairs, v)


def jsd_pairs(spark, d):
    pairs, v = _vector_pairs(spark, d)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return similarity.vector_pairs(pairs, v.select("id", F.transform("v", lambda x: F.abs(x.cast("double")) / total).alias("v")), similarity.jensen_shannon).withColumn("score", F.round("score", 5))


def _ranks(spark, d, measure):
    _, p, dups, comp = _kept_world(spark, d)
    return sparse.pair_ranks(_weights(spark, d, measure, dups.union(comp)), measure, p, comp)


def pair_ranks(spark, d):
    return _ranks(spark, d, "tfidf")


def recall_rates(spark, d):
    return ranking.recall_rates(_ranks(spark, d, "tfidf"))


def _all_ranks(spark, d, measures=("jaccard", "tfidf", "bm25")):
    _, p, dups, comp = _kept_world(spark, d)
    out = None
    for m, w in zip(measures, _represented(spark, d, *measures, ids=dups.union(comp)), strict=True):
        r = sparse.pair_ranks(w, m, p, comp).withColumn("feature", F.lit(m))
        out = r if out is None else out.unionByName(r)
    return out


def recall_by_feature(spark, d):
    return ranking.recall_rates(_all_ranks(spark, d), "feature")


def _parts(spark, d):
    """What candidates are drawn from, computed once: pairs, comparison questions, noise, duplicates of train and test."""
    q, p, dups, comp = _kept_world(spark, d)
    parts = index.stored(ids.split(dups))
    return p, comp, index.stored(ids.noise(q, p)), *(parts.where(F.col("part") == x).select("id") for x in ("train", "test"))


def _ends(parts, train: bool):
    """Duplicates and noise beside comparison questions less the test duplicates, or test duplicates beside all."""
    _, comp, noise, learners, test = parts
    if not train:
        return test, comp
    return learners.union(noise), index.stored(comp.join(test.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left_anti"))


def _labelled(spark, d, train: bool, parts=None, weights=None):
    """Candidates with labels: of train duplicates and noise among comparison questions less the test ones, or of test duplicates among all."""
    parts = parts or _parts(spark, d)
    dups, comp = _ends(parts, train)
    scores = similarity.score_best(_weights(spark, d, "tfidf", dups.union(comp)) if weights is None else weights, "tfidf", dups, comp, TOP)
    labelled = candidates.with_dup_labels(candidates.top_candidates(scores, dups, comp, TOP), parts[0])
    return candidates.with_noise_labels(labelled, parts[2]) if train else labelled.withColumn("is_noise", F.lit(False))


def train_candidates(spark, d):
    return _labelled(spark, d, True)


def test_candidates(spark, d):
    return _labelled(spark, d, False)


def limited_candidates(spark, d):
    return candidates.limit_candidates(_labelled(spark, d, True), 5)


def undersampled(spark, d):
    return candidates.undersample(index.materialise(_labelled(spark, d, True)), 0.25)


def merged_candidates(spark, d):
    parts = _parts(spark, d)
    weights = _weights(spark, d, "tfidf", parts[1].union(parts[2]).union(parts[3]).union(parts[4]))
    return candidates.merged(*(_labelled(spark, d, x, parts, weights) for x in (True, False)))


def cv_folds(spark, d):
    return ids.folds(index.materialise(_labelled(spark, d, True)), 5)


def _features(spark, d, *trains: bool):
    """Candidates and features of the train or test set for each of the arguments; weights are made once."""
    measures, parts = ("jaccard", "tfidf", "bm25"), _parts(spark, d)
    wanted = parts[1]
    for x in trains:
        wanted = wanted.union(_ends(parts, x)[0])
    postings = dict(zip(measures, _represented(spark, d, *measures, ids=wanted), strict=True))
    out = []
    for x in trains:
        cands = index.stored(_labelled(spark, d, x, parts, postings["tfidf"]))
        out.append((cands, features.merge_features(cands, features.feature_table(cands, {(PART, m): w for m, w in postings.items()}))))
    return out


def feature_matrix(spark, d):
    [(_, wide)] = _features(spark, d, False)
    return wide.select("dup_id", "candidate_id", "is_dup", *[F.round(c, 5).alias(c) for c in ml.feature_columns(wide)])


def feature_faults(spark, d):
    [(cands, wide)] = _features(spark, d, False)
    return features.feature_faults(index.stored(wide), cands)


def ranked_recall_by_score(spark, d):
    return ranking.recall_by_score(_labelled(spark, d, False), "score", ks=(1, 5, 10))


def misclassified(spark, d):
    return _misclassified(spark, d)[1]


def _misclassified(spark, d):
    """Test candidates, computed once, and the misclassified duplicates."""
    parts = _parts(spark, d)
    tested = index.stored(_labelled(spark, d, False, parts))
    return tested, reports.misclassified(tested.withColumn("pred", -F.col("score")), parts[0], 5)


def misclassified_counts(spark, d):
    return reports.misclassified_counts(*_misclassified(spark, d))


def similarity_summary(spark, d):
    rates = ranking.recall_rates(_all_ranks(spark, d), "feature").withColumn("dataset_name", F.lit("documents")).withColumn("col", F.lit(PART))
    return reports.similarity_summary(rates).select("dataset_name", "score", "similarity", PART)


def dataset_sizes(spark, d):
    """Languages stand for data sets."""
    q = tables.read(spark, d, "documents").select("doc_id", "lang")
    p = tables.dup_pairs(spark, d)
    dups = p.select(F.col("dup_id").alias("k")).distinct()
    per = q.join(dups, F.col("doc_id") == F.col("k"), "left").groupBy("lang").agg(F.count("*").alias("questions"), F.count("k").alias("duplicates"))
    pairs = p.join(q, F.col("dup_id") == F.col("doc_id")).groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("pairs"))
    per = per.join(pairs, F.col("lang") == F.col("l"), "left").select(F.when(F.col("lang") == "en", "English").otherwise("Other").alias("source"), F.lit("Prose").alias("topic"), "questions", "duplicates", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return reports.dataset_sizes(per)


def _by_language(spark, d):
    """Recall of test candidates by language of the duplicate and of a rival order of the candidates."""
    langs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("l"), "lang")
    c = _labelled(spark, d, False).join(langs, F.col("dup_id") == F.col("l")).drop("l")
    return ranking.recall_by_score(c, "score", "lang")


def cross_dataset_summary(spark, d):
    r = _by_language(spark, d).select(F.lit("all").alias("dataset_train"), F.when(F.col("lang") == "en", "English").otherwise("Other").alias("dataset_test"), "rr_5", "rr_10", "rr_20")
    return reports.rate_summary(r, "dataset_train", "dataset_test")


def candidate_summary(spark, d):
    c = index.materialise(_labelled(spark, d, False))
    out = None
    for n in (1, 5, TOP):
        r = ranking.recall_by_score(candidates.limit_candidates(c, n), "score").withColumn("n_candidates", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return reports.rate_summary(out, "n_candidates")


def rank_outliers(spark, d):
    r = reports.rank_outliers(_all_ranks(spark, d), "feature")
    return r.select("feature", "dup_id", "main_id", F.round("log10_rank", 6).alias("log10_rank"), "outlier")


def lda_topics(spark, d):
    return ml.topics(_tokenized(spark, d), PART)


def doc2vec_approx(spark, d):
    return ml.document_vectors(_tokenized(spark, d), PART)


def rf_predict(spark, d):
    (_, train), (_, test) = _features(spark, d, True, False)
    model = ml.train_classifier(index.stored(train), {"numTrees": 20, "maxDepth": 5})
    return ml.predict(model, test).select("dup_id", "candidate_id", "is_dup", "pred")


def rf_tuning(spark, d):
    [(_, train)] = _features(spark, d, True)
    return ml.search(index.stored(train), 2, 3, grid={"numTrees": (5, 10), "maxDepth": (3, 5)})


def xml_questions(spark, d):
    """The questions written as a dump and read again."""
    folder = index.scratch(spark, "posts")
    q = tables.questions(spark, d).withColumn("body", F.translate("body", "\n", " "))
    xml.write_posts(q, folder)
    back = xml.read_questions(spark, folder)
    return back.select(F.col("id").cast("long").alias("id"), F.col("n_answers").cast("long").alias("n_answers"), "title", F.md5("body").alias("body_md5"), "tags")


def xml_answers(spark, d):
    """Questions and answers written as dumps and read again; a question accepts the first of its accepted answers."""
    folder = index.scratch(spark, "posts")
    a = tables.answers(spark, d).withColumn("body", F.translate("body", "\n", " "))
    chosen = a.where("accepted").groupBy("question_id").agg(F.min("id").alias("accepted_id"))
    q = tables.questions(spark, d).withColumn("body", F.lit("")).join(chosen, F.col("id") == F.col("question_id"), "left").drop("question_id")
    xml.write_posts(q, f"{folder}/questions")
    xml.write_answers(a, f"{folder}/answers")
    back = xml.read_answers(spark, f"{folder}/*")
    return back.select(F.col("id").cast("long").alias("id"), F.col("question_id").cast("long").alias("question_id"), F.col("score").cast("long").alias("score"), F.md5("body").alias("body_md5"), F.col("post_date").cast("long").alias("post_date"), "accepted")


def xml_dup_pairs(spark, d):
    """The links of known pairs, and as many of another type, written as a dump and read again within the questions of one language."""
    folder = index.scratch(spark, "links")
    xml.write_links(tables.dup_pairs(spark, d), folder)
    some = corpus.with_any_tag(tables.questions(spark, d), ["en", "fr"]).select(F.col("id").cast("string").alias("id"))
    back = xml.read_dup_pairs(spark, folder, some)
    return back.select(F.col("dup_id").cast("long").alias("dup_id"), F.col("main_id").cast("long").alias("main_id"))


def _letter_counts():
    """A stand-in for a transformer: counts of the letters a to z."""
    return lambda texts: [[float(t.count(chr(97 + k))) for k in range(26)] for t in texts]


def encoder_pairs(spark, d):
    """Questions beside the first of their tags, compared by an encoder of whole raw texts."""
    q = tables.questions(spark, d)
    vectors = ml.encoded(q, "body", _letter_counts)
    firsts = q.groupBy("tags").agg(F.min("id").alias("main_id"))
    pairs = q.select(F.col("id").alias("dup_id"), "tags").join(firsts, "tags").where("dup_id != main_id").select("dup_id", "main_id")
    return similarity.vector_pairs(pairs, vectors, similarity.DENSE["mpnet"]).withColumn("score", F.round("score", 5))


def tag_subset(spark, d):
    """Questions, answers and pairs of the data set of some tags, counted."""
    q = corpus.with_any_tag(tables.questions(spark, d), STUDY_TAGS)
    kept = q.select(F.col("id").alias("k"))
    a = tables.answers(spark, d).join(kept, F.col("question_id") == F.col("k"), "left_semi")
    p = ids.within(tables.dup_pairs(spark, d), q)
    counts = [x.agg(F.lit(n).alias("artefact"), F.count("*").alias("n")) for n, x in (("question_texts", q), ("answer_texts", a), ("dup_pairs", p))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


QUERIES = {
    f.__name__: f
    for f in (
        tag_filter, best_answer, answered_without_best, bm25_neighbours, question_with_answer, corpus_index, corpus_faults, dup_pairs, duplicate_ids, main_ids, answered_ids, comparison_ids, pairs_both_in_set, questions_in_pairs, noise_sample, train_test_split, stratified_sample,
        html_to_text, html_to_text_parsed, tokenize_counts, stemmed_terms, term_freq, doc_freq, tfidf_weights, bm25_idf, bm25_weights, bm25_query, dense_cosine_pairs, dense_cosine_topk, dense_pair_ranks, jsd_pairs, pair_ranks, recall_rates, recall_by_feature,
        train_candidates, test_candidates, limited_candidates, undersampled, merged_candidates, cv_folds, feature_matrix, feature_faults, ranked_recall_by_score, misclassified, misclassified_counts, similarity_summary, dataset_sizes, cross_dataset_summary, candidate_summary, rank_outliers,
        lda_topics, doc2vec_approx, rf_predict, rf_tuning, xml_questions, xml_answers, xml_dup_pairs, encoder_pairs, tag_subset,
    )
} | {"jaccard_pairs": _pairs_query("jaccard"), "tfidf_pairs": _pairs_query("tfidf"), "bm25_pairs": _pairs_query("bm25"), "tfidf_topk": _topk_query("tfidf"), "bm25_most_similar": _topk_query("bm25")}
