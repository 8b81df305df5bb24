"""From question and answer texts to the corpus of question parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.porter import stemmed
from ..functions.text import process_html, tokens
from .index import among, materialise, stored

#: Question parts that are compared.
PARTS = ("title", "body", "tags", "title_body", "title_body_tags", "title_body_tags_answer")


def with_any_tag(questions: DataFrame, wanted: list[str]) -> DataFrame:
    """Questions that have one of the tags, compared as whole tags in lower case."""
    return questions.where(F.arrays_overlap(F.split(F.lower("tags"), ","), F.array(*[F.lit(t.lower()) for t in wanted])))


def best_answers(answers: DataFrame) -> DataFrame:
    """id, question_id of the best answer: accepted, then of the highest score, then the first one posted."""
    question = Window.partitionBy("question_id")
    marked = answers.select("id", "question_id", "accepted", (F.col("score") == F.max("score").over(question)).alias("top"), (F.col("post_date") == F.min("post_date").over(question)).alias("earliest"))
    ranked = marked.withColumn("r", F.row_number().over(question.orderBy(F.desc("accepted"), F.desc("top"), F.desc("earliest"), "id")))
    return ranked.where("r = 1").select("id", "question_id")


def answered_without_best(answers: DataFrame) -> DataFrame:
    """question_id of answered questions without a best answer; there are none."""
    best = best_answers(answers).select(F.col("question_id").alias("b"))
    return answers.join(best, F.col("question_id") == F.col("b"), "left_anti").select("question_id").distinct()


def with_best_answer(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with `answer`, the body of the best answer or the empty text."""
    best = best_answers(answers).select(F.col("id").alias("aid"))
    bodies = answers.join(best, F.col("id") == F.col("aid"), "left_semi").select(F.col("question_id").alias("qid"), F.col("body").alias("answer"))
    return questions.join(bodies, F.col("id") == F.col("qid"), "left").drop("qid").withColumn("answer", F.coalesce("answer", F.lit("")))


def with_best_answer_apart(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """with_best_answer() where few questions have an answer: the texts of the others aren't shuffled, and those of a null id have none."""
    asked = stored(answers.select(F.col("question_id").alias("id")).distinct())
    some = with_best_answer(among(questions, "id", asked), answers)
    return some.unionByName(among(questions, "id", asked, "left_anti").withColumn("answer", F.lit("")))


def dense_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with their number from 0 in the order of the key, which is unique, without gathering them in one task.

    Keys are dealt by ranges and sorted; a partition's first number is the count of keys before it. The dealt keys are
    written once, for a range is drawn from a sample and would come out otherwise a second time.
    """
    keys = rows.select(F.col(key).alias("_key")).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id())
    keys = materialise(keys).select("_key", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = keys.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    numbers = keys.join(F.broadcast(before), F.col("_part") == F.col("_p")).select("_key", (F.col("_before") + F.col("_row")).alias(name))
    return rows.join(numbers, F.col(key) == F.col("_key")).drop("_key")


def merged_parts(df: DataFrame) -> DataFrame:
    """Title, body, tags and answer with their concatenations."""
    space = lambda *c: F.concat_ws(" ", *c)
    df = df.withColumn("title_body", space("title", "body"))
    df = df.withColumn("title_body_tags", space("title_body", "tags"))
    return df.withColumn("title_body_tags_answer", space("title_body_tags", "answer"))


def build_corpus(questions: DataFrame, answers: DataFrame, html: bool = True) -> DataFrame:
    """id, corpus_index, n_answers, and the parts as texts."""
    joined = with_best_answer(questions.na.drop(), answers)
    for c in ("title", "body", "answer") if html else ():
        joined = joined.withColumn(c, process_html(F.col(c)))
    return dense_index(merged_parts(joined), "id", "corpus_index").select("id", "corpus_index", "n_answers", "title", "body", "tags", "answer", *PARTS[3:])


def tokenize(corpus: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """The corpus with its parts as arrays of stemmed tokens."""
    cut = (lambda c: stemmed(tokens(F.col(c)))) if stop_words is None else (lambda c: stemmed(tokens(F.col(c), stop_words)))
    df = corpus.select("id", "corpus_index", "n_answers", *[cut(c).alias(c) for c in ("title", "body", "tags", "answer")])
    df = df.withColumn("title_body", F.concat("title", "body")).withColumn("title_body_tags", F.concat("title_body", "tags"))
    return df.withColumn("title_body_tags_answer", F.concat("title_body_tags", "answer"))


def corpus_faults(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound corpus: nulls, repeated ids, questions without a row, repeated numbers."""
    nulls = sum(F.col(c).isNull().cast("int") for c in ("title", "body", "tags"))
    one = corpus.agg(F.sum(nulls).alias("nulls"), (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), (F.count("*") - F.count_distinct("corpus_index")).alias("repeated_indexes"), (F.max("corpus_index") + 1 - F.count("*")).alias("gaps"))
    missing = questions.na.drop().join(corpus.select(F.col("id").alias("c")), F.col("id") == F.col("c"), "left_anti").agg(F.count("*").alias("missing"))
    return one.withColumn("missing", missing.scalar())
