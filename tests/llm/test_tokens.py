import time

from pyspark.sql import functions as F

from quillgate.llm.tokens import count_tokens, with_token_counts


def test_counts_of_whole_texts():
    assert count_tokens([None, "", "hello world", "<|endoftext|>"])[:3] == [0, 0, 2]
    assert count_tokens(["<|endoftext|>"])[0] > 1
    one = count_tokens(["Some words, 12 numbers.\n\n"])[0]
    assert abs(count_tokens(["Some words, 12 numbers.\n\n" * 2000])[0] - 2000 * one) <= 2000


def test_very_long_runs_take_no_quadratic_time():
    began = time.time()
    sizes = count_tokens(["a" * 300_000, " " * 300_000, "é" * 100_000, "1" * 300_000])
    assert min(sizes) > 100 and time.time() - began < 20


def test_columns_stay_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", None), (2, None, "y", 3)], "_n bigint, text string, _text string, _c0 int")
    got = with_token_counts(df, F.col("text"), into="size").orderBy("_n").collect()
    assert [r.asDict() for r in got] == [{"_n": 1, "text": "a b", "_text": "x", "_c0": None, "size": 2}, {"_n": 2, "text": None, "_text": "y", "_c0": 3, "size": 0}]
    assert with_token_counts(df.limit(0), F.col("text")).count() == 0
