import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tests.conftest import SF_MID
from weighbridge.functions.tokens import bpe_token_count, bytes4
from weighbridge.functions.urls import owner_repo
from weighbridge.plans.ranking import exact_median_half_up, rank_within
from weighbridge.sources.readers import lines_to_urls


def test_owner_repo(spark):
    cases = {
        "https://github.com/o/r.git": ("o", "r"),
        "https://github.com/o/r/": ("o", "r"),
        "git@github.com:o/r.GIT": ("o", "r"),
        "https://host/a b/c$d": ("a-b", "c-d"),
        "r": ("owner", "r"),
        "": ("owner", "repo"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    o, r = owner_repo(F.col("url"))
    got = {row["url"]: (row["o"], row["r"]) for row in df.select("url", o.alias("o"), r.alias("r")).collect()}
    assert got == cases


def test_repo_list_lines(spark):
    lines = ["# header", "", "  https://a/x/y  \r", "\thttps://b/z/w", "   ", "#c", "https://c/q/r"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no int, line string")
    assert [r["url"] for r in lines_to_urls(df).orderBy("line_no").collect()] == ["https://a/x/y", "https://b/z/w", "https://c/q/r"]


def test_rank_within_matches_row_number_with_hot_key(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 50}", rnd.randint(0, 20), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    ours = rank_within(df, ["k"], [F.desc("v"), F.col("id")], out="rk", n_slices=16)
    ref = df.withColumn("rk", F.row_number().over(W.partitionBy("k").orderBy(F.desc("v"), F.col("id"))))
    assert sorted(map(tuple, ours.select("k", "id", "rk").collect())) == sorted(map(tuple, ref.select("k", "id", "rk").collect()))
    glob = rank_within(df, [], [F.col("id")], out="rk", n_slices=7)
    assert sorted(r["rk"] for r in glob.collect()) == list(range(1, 3001))


def test_exact_median(spark):
    for values, want in [([5], 5), ([1, 2], 2), ([3, 1, 2], 2), ([10, 15, 4, 100], 13), ([], 0)]:
        df = spark.createDataFrame([(v,) for v in values], "x long")
        assert exact_median_half_up(df, "x").collect()[0][0] == want


def test_bpe_counts_agree_with_second_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = pq.read_table(f"{SF_MID}/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]
    texts += ["", "<|endoftext|> is plain text here", "naïve café 😀"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(bpe_token_count()(F.col("t"))).collect()]
    assert got == want
    assert [r[0] for r in df.orderBy("i").select(bytes4(F.col("t"))).collect()][-3:] == [0, 8, 5]


def test_bpe_count_holds_one_texts_tokens_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    count = bpe_token_count().func
    batch = pa.array([f"{i} " + "word and text. " * 500 for i in range(400)] + ["", None])
    want = next(count(iter([batch])))  # the encoder is built now
    tracemalloc.start()
    got = next(count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and got.to_pylist()[-2:] == [0, None]
    assert sum(got.to_pylist()[:-1]) > 800_000
    assert peak < 2_000_000  # all tokens of the batch take over 6 MB as pointers alone


def test_bpe_counts_keep_rows_of_null_and_repeated_texts(spark):
    from weighbridge.functions.tokens import with_tokens

    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, ""), (4, None)], "i int, content string")
    for dedupe in (True, False):
        got = {r["i"]: r["tokens"] for r in with_tokens(df, dedupe=dedupe).collect()}
        assert got == {1: 2, 2: 2, 3: 0, 4: None}
