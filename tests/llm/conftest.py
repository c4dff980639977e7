import random

import pytest
from pyspark.sql import functions as F

CLASHES = "id digest host fingerprint component_id label h w s x n hits lead part row kept removed terms score item k at m template_ seen".split()
WORDS = "thorre ndthe ouing anble erst tion heat inea wath lonre estin ofan sorn merit polte gavin durno celip".split()


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(count))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, repeated rows and columns with clashing names."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "src0", len(base)), (1, base, "en", "src0", len(base)), (2, base, None, None, None), (3, None, "en", "src0", None), (4, "", "en", "src0", 0),
        (5, " \t\n ", "de", "src1", 4), (None, prose(2, 50), "en", "src1", 1), (None, None, None, None, None), (6, prose(3, 60_000), "en", "src1", 5), (7, prose(4, 12) + "\n" + prose(5, 30), "en", "src1", 9),
        (7, prose(6, 40), "en", "src1", 9), (8, "x", "en", "src1", 1), (9, "日本語 テキスト é \U0001f600 <|endoftext|> end", "ja", "src2", 30),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def bench_items(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
