"""Question-and-answer dumps in XML: rows with attributes, read with a declared schema so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = "_Id string, _PostTypeId string, _ParentId string, _AcceptedAnswerId string, _AnswerCount int, _Score int, _CreationDate string, _Title string, _Body string, _Tags string"
LINKS = "_Id string, _PostId string, _RelatedPostId string, _LinkTypeId string"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "row").option("ignoreSurroundingSpaces", False).schema(schema).load(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, n_answers, title, body, tags (comma-separated); one row an id, rows with nulls dropped."""
    tags = F.replace(F.replace(F.replace("_Tags", F.lit("><"), F.lit(",")), F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))
    posts = _rows(spark, path, POSTS).where("_PostTypeId = '1'")
    return posts.select(F.col("_Id").alias("id"), F.col("_AnswerCount").alias("n_answers"), F.col("_Title").alias("title"), F.col("_Body").alias("body"), tags.alias("tags")).na.drop().dropDuplicates(["id"])


def read_accepted_ids(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, POSTS).where("_PostTypeId = '1' and _AcceptedAnswerId is not null").select(F.col("_AcceptedAnswerId").alias("id")).distinct()


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """id, question_id, score, body, post_date, accepted (by a question of the same dump)."""
    accepted = read_accepted_ids(spark, path).withColumnRenamed("id", "a")
    posts = _rows(spark, path, POSTS).where("_PostTypeId = '2'").select(F.col("_Id").alias("id"), F.col("_ParentId").alias("question_id"), F.col("_Score").alias("score"), F.col("_Body").alias("body"), F.col("_CreationDate").alias("post_date"))
    return posts.join(accepted, F.col("id") == F.col("a"), "left").withColumn("accepted", F.col("a").isNotNull()).drop("a")


def read_dup_pairs(spark: SparkSession, path: str, questions: DataFrame | None = None) -> DataFrame:
    """dup_id, main_id of the links of type 3, within the questions if these are given."""
    pairs = _rows(spark, path, LINKS).where("_LinkTypeId = '3'").select(F.col("_PostId").alias("dup_id"), F.col("_RelatedPostId").alias("main_id")).distinct()
    for end in ("dup_id", "main_id") if questions is not None else ():
        pairs = pairs.join(questions.select(F.col("id").alias("q")), F.col(end) == F.col("q"), "left_semi")
    return pairs


def _write(rows: DataFrame, path: str, root: str) -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", "row").save(path)


def write_posts(questions: DataFrame, path: str) -> None:
    """Questions as a dump of posts; accepted_id, where there is one, is the answer that a question accepts."""
    tags = F.concat(F.lit("<"), F.replace("tags", F.lit(","), F.lit("><")), F.lit(">"))
    accepted = [F.col("accepted_id").cast("string").alias("_AcceptedAnswerId")] if "accepted_id" in questions.columns else []
    _write(questions.select(F.col("id").cast("string").alias("_Id"), F.lit("1").alias("_PostTypeId"), *accepted, F.col("n_answers").cast("int").alias("_AnswerCount"), F.col("title").alias("_Title"), F.col("body").alias("_Body"), tags.alias("_Tags")), path, "posts")


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as a dump of posts."""
    _write(answers.select(F.col("id").cast("string").alias("_Id"), F.lit("2").alias("_PostTypeId"), F.col("question_id").cast("string").alias("_ParentId"), F.col("score").cast("int").alias("_Score"), F.col("post_date").cast("string").alias("_CreationDate"), F.col("body").alias("_Body")), path, "posts")


def write_links(pairs: DataFrame, path: str) -> None:
    """Pairs as a dump of links: of type 3 as they are, and of type 1 the other way round."""
    both = pairs.select("dup_id", "main_id", F.lit("3").alias("kind")).union(pairs.select("main_id", "dup_id", F.lit("1")))
    _write(both.select(F.concat_ws("-", "dup_id", "main_id").alias("_Id"), F.col("dup_id").cast("string").alias("_PostId"), F.col("main_id").cast("string").alias("_RelatedPostId"), F.col("kind").alias("_LinkTypeId")), path, "postlinks")
