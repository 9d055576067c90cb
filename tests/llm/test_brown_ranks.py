import pyarrow as pa
from pyspark.sql import functions as F

from gridtempo.llm import brown
from gridtempo.llm._words import Words


def test_words_are_ranked_over_all_rows(spark):
    """Word w of 150 is in 200 + w of 41,175 rows, so that no sample ranks them rightly."""
    rows = spark.range(150).select(F.col("id").alias("w"), F.explode(F.sequence(F.lit(1), (F.col("id") + 200).cast("int"))).alias("i"))
    training = rows.select(F.xxhash64("w", "i").alias("row_key"), F.concat(F.lit("word"), F.col("w")).alias("text"))

    want = Words(pa.array([f"word{w}" for w in reversed(range(150))])).hashes(fold=True)
    assert brown.frequent(training)[0].tolist() == want.tolist()
