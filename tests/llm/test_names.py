"""Columns of any name stay as they are: dots, back quotes aside, and the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, langid, line_dedup, media, near_dedup, packing, queries, suffix_dedup, token_files, toxicity

NAMES = ["a.b", "__row", "__order", "row", "hash", "node", "key", "keys", "component", "place", "n", "id", "u", "v", "line", "least"]


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    return docs.withColumns({c: (F.col("doc_id") + i).cast("long") for i, c in enumerate(NAMES)})


def kept(df):
    """What stands in the odd columns, by document."""
    return {r[0]: list(r[1:]) for r in df.select("doc_id", *(F.col(f"`{c}`") for c in NAMES)).collect()}


def test_operators_that_keep_columns_keep_odd_ones(spark, sf_dir, odd):
    want = kept(odd)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("x.y", F.lit(1))
    machine = queries.fit_toxicity(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for out in (
        near_dedup.without_near_copies(odd),
        line_dedup.dedup_lines(odd),
        decontaminate.decontaminate(odd, benchmark, prefix="__"),
        langid.predict(odd, langid.fit(odd)),
        toxicity.score(odd, machine, score_col="__score", predicted_col="__predicted"),
    ):
        got = kept(out)
        assert got == {i: v for i, v in want.items() if i in got} and len(got) > 30


def test_other_operators_ignore_odd_columns(spark, sf_dir, odd):
    plain = odd.drop(*NAMES)
    tokenizer = queries._tokenizer("byte_bpe_50k.json")
    for run in (
        near_dedup.near_duplicates,
        suffix_dedup.remove_repeats,
        lambda df: packing.pack(df, tokenizer),
        lambda df: token_files.read_token_files(token_files.write_token_files(df, tokenizer)),
        lambda df: media.features(media.text_images(df)),
    ):
        one, two = run(odd), run(plain)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_near_copies_of_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 7, "x"), (2, text, 8, "y"), (3, "other words here", None, "z")], "doc_id long, text string, __row int, `a.b` string")
    assert sorted(map(tuple, near_dedup.without_near_copies(df).collect())) == [(1, text, 7, "x"), (3, "other words here", None, "z")]
