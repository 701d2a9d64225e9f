"""Plain versions and awkward inputs shared by the tests."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name clashes with inner ones."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    prose = " ".join(f"{word[(i * 7 + i // 5) % 12]}{i % 50}" for i in range(120))
    long = " ".join(f"{word[i % 12]}{i * 37 % 9973}" for i in range(30_000))
    rows = [(1, prose, "en", "s", 5), (1, prose, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t", "en", None, 3), (None, prose, "en", "s", 5), (5, long, "en", "t", 9), (6, "one two", "en", "t", 7), (7, "one two", "en", "t", 7), (8, "Ünï çödé " * 30, "en", "t", 7)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("text2", F.lit(1)).withColumn("s", F.lit("x")).withColumn("size", F.lit(2)).withColumn("b", F.lit(3))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
