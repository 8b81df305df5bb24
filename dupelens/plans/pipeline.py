"""The whole study as stages that read and write stored artefacts; a data set is a partition, not a loop over files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, corpus, dense, features, ids, index, ml, ranking, reports, similarity, sparse
from ..sources.catalog import Catalog


@dataclass(frozen=True)
class Settings:
    """Parameters that are part of the results."""

    measures: tuple[str, ...] = ("jaccard", "tfidf", "bm25")
    dense: tuple[str, ...] = ()
    #: Encoders of raw texts by measure (bertoverflow, mpnet): each builds a function of texts in a worker.
    encoders: dict = field(default_factory=dict)
    parts: tuple[str, ...] = corpus.PARTS
    retrieval: tuple[str, str] = ("tfidf", "title_body_tags_answer")
    n_candidates: tuple[int, ...] = (1500,)
    undersampling: float = 0.01
    noise: float = ids.NOISE_SHARE
    test: float = ids.TEST_SHARE
    seed: int = ids.SEED
    search_iterations: int = 1
    folds: int = 5
    forest: dict = field(default_factory=dict)
    html: bool = True


class Study:
    """Stages over one catalog. Each writes its artefact and gives back what was written."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.catalog, self.settings = spark, Catalog(root), settings or Settings()

    def read(self, artefact: str, **parts) -> DataFrame:
        return self.spark.read.parquet(self.catalog.path(artefact, **parts))

    def read_all(self, artefact: str, datasets: list[str]) -> DataFrame:
        """The artefact of several data sets as one table, with its partition columns."""
        return self.spark.read.option("basePath", self.catalog.path(artefact)).parquet(*[self.catalog.path(artefact, dataset=d) for d in datasets])

    def write(self, df: DataFrame, artefact: str, **parts) -> DataFrame:
        path = self.catalog.path(artefact, **parts)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def ingest(self, dataset: str, questions: DataFrame, answers: DataFrame, pairs: DataFrame) -> None:
        self.write(questions, "question_texts", dataset=dataset)
        self.write(answers, "answer_texts", dataset=dataset)
        self.write(pairs, "dup_pairs", dataset=dataset)

    def subset_by_tags(self, source: str, dataset: str, tags: list[str]) -> None:
        """A data set of the questions with one of the tags, with their answers and the pairs among them."""
        q = corpus.with_any_tag(self.read("question_texts", dataset=source), tags)
        self._subset(source, dataset, q)

    def sample(self, source: str, dataset: str, n: int, seed: int) -> None:
        """A data set of n questions: those in pairs, and others by lot."""
        q, p = self.read("question_texts", dataset=source), self.read("dup_pairs", dataset=source)
        chosen = ids.sample_with_pairs(q, p, n, seed).select(F.col("id").alias("k"))
        self._subset(source, dataset, q.join(chosen, F.col("id") == F.col("k"), "left_semi"))

    def _subset(self, source: str, dataset: str, questions: DataFrame) -> None:
        q = self.write(questions, "question_texts", dataset=dataset)
        kept = q.select(F.col("id").alias("k"))
        self.write(self.read("answer_texts", dataset=source).join(kept, F.col("question_id") == F.col("k"), "left_semi"), "answer_texts", dataset=dataset)
        self.write(ids.within(self.read("dup_pairs", dataset=source), q), "dup_pairs", dataset=dataset)

    def preprocess(self, ds: str) -> None:
        q, a = self.read("question_texts", dataset=ds), self.read("answer_texts", dataset=ds)
        built = self.write(corpus.build_corpus(q, a, self.settings.html), "corpus", dataset=ds)
        if any(corpus.corpus_faults(built, q).first()):
            raise ValueError(f"the corpus of {ds} isn't sound")
        self.write(corpus.tokenize(built), "corpus_tokenized", dataset=ds)

    def id_sets(self, ds: str) -> None:
        c, p, s = self.read("corpus", dataset=ds), self.read("dup_pairs", dataset=ds), self.settings
        dups = self.write(ids.duplicates(c, p), "duplicate_question_ids", dataset=ds)
        self.write(c.select("id"), "all_question_ids", dataset=ds)
        self.write(ids.mains(c, p), "main_question_ids", dataset=ds)
        self.write(ids.answered(c), "answered_question_ids", dataset=ds)
        self.write(ids.comparison(c, p), "comparison_question_ids", dataset=ds)
        self.write(ids.noise(c, p, s.noise, s.seed), "noise_question_ids", dataset=ds)
        parts = ids.split(dups, s.test, s.seed)
        self.write(parts.where("part = 'train'").select("id"), "train_dup_ids", dataset=ds)
        self.write(parts.where("part = 'test'").select("id"), "test_dup_ids", dataset=ds)

    def representations(self, ds: str) -> None:
        """What each measure compares, for each part."""
        tokenized = self.read("corpus_tokenized", dataset=ds)
        texts = self.read("corpus", dataset=ds)
        save = lambda m, part: lambda model: model.write().overwrite().save(self.catalog.path("feature_model", dataset=ds, model=m, col=part))
        makers = {"topic": ml.topics, "topic_jsd": ml.topics, "doc2vec": ml.document_vectors}
        for part in self.settings.parts:
            tf, n = index.materialise(index.term_freq(tokenized, part)), tokenized.count()
            for m in self.settings.measures:
                self.write(similarity.SPARSE[m](tf, n), "embedding", dataset=ds, model=m, col=part)
            for m in self.settings.dense:
                self.write(makers[m](tokenized, part, keep=save(m, part)), "embedding", dataset=ds, model=m, col=part)
            for m, encoder in self.settings.encoders.items():
                self.write(ml.encoded(texts, part, encoder), "embedding", dataset=ds, model=m, col=part)

    def _dense(self) -> tuple[str, ...]:
        return (*self.settings.dense, *self.settings.encoders)

    def _weights(self, ds: str, measure: str, part: str) -> DataFrame:
        return self.read("embedding", dataset=ds, model=measure, col=part)

    def ranks(self, ds: str) -> DataFrame:
        p, comp = (self.read(x, dataset=ds) for x in ("dup_pairs", "comparison_question_ids"))
        rates = None
        for m in (*self.settings.measures, *self._dense()):
            for part in self.settings.parts:
                w = self._weights(ds, m, part)
                ranked = sparse.pair_ranks(w, m, p, comp) if m in similarity.SPARSE else dense.pair_ranks(w, m, p, comp)
                ranked = self.write(ranked, "pair_ranks", dataset=ds, feature=m, col=part)
                row = ranking.recall_rates(ranked).select(F.lit(m).alias("feature"), F.lit(part).alias("col"), "*")
                rates = row if rates is None else rates.unionByName(row)
        return self.write(rates, "all_pair_ranks", dataset=ds)

    def candidates(self, ds: str) -> None:
        s, n = self.settings, max(self.settings.n_candidates)
        measure, part = s.retrieval
        p, comp, noise, train, test = (self.read(x, dataset=ds) for x in ("dup_pairs", "comparison_question_ids", "noise_question_ids", "train_dup_ids", "test_dup_ids"))
        w = self._weights(ds, measure, part)
        learners = train.unionByName(noise)
        rest = comp.join(test.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left_anti")
        trained = candidates.top_candidates(similarity.score_best(w, measure, learners, rest, n), learners, rest, n)
        trained = self.write(candidates.with_noise_labels(candidates.with_dup_labels(trained, p), noise), "train_candidate_pairs", dataset=ds, n=n, perc=1)
        trained = self.write(candidates.undersample_if_rare(trained, s.undersampling, s.seed), "train_candidate_pairs", dataset=ds, n=n, perc=s.undersampling)
        tested = candidates.top_candidates(similarity.score_best(w, measure, test, comp, n), test, comp, n)
        tested = self.write(candidates.with_dup_labels(tested, p).withColumn("is_noise", F.lit(False)), "test_candidate_pairs", dataset=ds, n=n)
        self.write(candidates.merged(trained, tested), "candidate_pairs", dataset=ds)

    def features(self, ds: str) -> None:
        """Features of all distinct pairs once, then the sets that they are joined to."""
        s, n = self.settings, max(self.settings.n_candidates)
        pairs = self.read("candidate_pairs", dataset=ds).select("dup_id", F.col("candidate_id").alias("main_id")).distinct()
        made = []
        if s.measures:
            table = similarity.score_features(pairs, {(part, m): self._weights(ds, m, part) for part in s.parts for m in s.measures})
            made.append(self.write(table.withColumnRenamed("main_id", "candidate_id"), "feature", dataset=ds, feature="-".join(s.measures)))
        for m in self._dense():
            table = pairs
            for part in s.parts:
                table = similarity.vector_pairs(table, self._weights(ds, m, part), similarity.DENSE[m]).withColumnRenamed("score", f"{part}_{m}_sim")
            made.append(self.write(table.withColumnRenamed("main_id", "candidate_id"), "feature", dataset=ds, feature=m))
        for name, kind, more in (("train_candidate_pairs", "train_set", {"perc": s.undersampling}), ("test_candidate_pairs", "test_set", {})):
            some = self.read(name, dataset=ds, n=n, **more)
            wide = self.write(features.merge_features(some, *made), kind, dataset=ds, n=n, **more)
            if any(features.feature_faults(wide, some).first()):
                raise ValueError(f"the {kind} of {ds} isn't sound")

    def train(self, ds: str):
        """Search, then the classifier of the best parameters."""
        s, n = self.settings, max(self.settings.n_candidates)
        pairs = self.read("train_set", dataset=ds, n=n, perc=s.undersampling)
        params = s.forest
        if s.search_iterations:
            found = self.write(ml.search(pairs, s.search_iterations, s.folds, s.seed), "cv_results", dataset=ds, n=n, perc=s.undersampling)
            params = ml.best_params(found) | s.forest
        model = ml.train_classifier(pairs, params, s.seed)
        model.write().overwrite().save(self.catalog.path("classifier", dataset=ds, n=n, perc=s.undersampling))
        return model

    def classifier(self, ds: str):
        from pyspark.ml import PipelineModel

        return PipelineModel.load(self.catalog.path("classifier", dataset=ds, n=max(self.settings.n_candidates), perc=self.settings.undersampling))

    def evaluate(self, datasets: list[str]) -> None:
        """Recall by number of candidates, across data sets, and the misclassified duplicates of each."""
        n = max(self.settings.n_candidates)
        tests = {d: self.read("test_set", dataset=d, n=n) for d in datasets}
        models = {d: self.classifier(d) for d in datasets}
        by_size = [ml.evaluate(models[d], tests[d], c).select("*", F.lit(d).alias("dataset_train"), F.lit(c).alias("candidates")) for d in datasets for c in self.settings.n_candidates]
        across = [ml.evaluate(models[a], tests[b], n).select("*", F.lit(a).alias("dataset_train"), F.lit(b).alias("dataset_test")) for a in datasets for b in datasets]
        for name, frames in (("candidates_evaluation", by_size), ("cross_dataset_performance", across)):
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            self.write(out, name)
        for d in datasets:
            site = reports.SITES.get(d, reports.OTHER_SITE)
            self.write(reports.misclassified(ml.predict(models[d], tests[d]), self.read("dup_pairs", dataset=d), site=site), "misclassified_duplicates", dataset=d)

    def run(self, datasets: list[str]) -> None:
        """All stages of ingested data sets."""
        for d in datasets:
            for stage in (self.preprocess, self.id_sets, self.representations, self.ranks, self.candidates, self.features, self.train):
                stage(d)
        self.evaluate(datasets)
