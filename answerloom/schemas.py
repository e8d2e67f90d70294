"""Declared schemas. Readers use these instead of inferring types."""

from pyspark.sql import types as T

QUESTION_POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("creation_date", T.TimestampType()),
    ]
)

ANSWER_POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)

QA_CORPUS = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("question_title", T.StringType()),
        T.StructField("question_body", T.StringType()),
        T.StructField("question_tags", T.StringType()),
        T.StructField("answer_id", T.LongType()),
        T.StructField("answer_body", T.StringType()),
        T.StructField("answer_score", T.IntegerType()),
    ]
)

REACTIONS = T.StructType(
    [
        T.StructField("+1", T.IntegerType()),
        T.StructField("heart", T.IntegerType()),
        T.StructField("hooray", T.IntegerType()),
    ]
)

COMMENT = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("reactions", REACTIONS),
    ]
)

ISSUE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("comments_details", T.ArrayType(COMMENT)),
    ]
)

EVAL_SET = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

STAGE_TEXT = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("variant", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

#: What a stage store holds: a text and the digest of its prompt.
STORED_TEXT = T.StructType([*STAGE_TEXT.fields, T.StructField("digest", T.StringType())])
