import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
_RNG_WORDS = "alpha beta gamma delta the of and license rights reserved all cc by general public".split()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def crc(id_, mod):
    return zlib.crc32(str(id_).encode()) % mod


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t", "One", "One two", "ONE  TWO\n", "All rights reserved. CC-BY, cc by! General Public License",
    "Émile Ünïcode — “quoted” text 日本語 テキスト <|endoftext|> end", LONG, LONG + " tail", BASE, BASE + " x", BASE.replace("w3 ", "q "),
    "x\x1cy\x0bz  nbsp\u00a0 two", "Released under the MIT License. All rights reserved", "a" * 5000, "Kelvin K word", "the\rend", "ab.cd", "One two",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty and long texts, equal rows, and columns whose names may clash."""
    rows = [(i, t, None if i % 4 == 0 else f"src{i % 3}", f"d{i}") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "text of nobody", None, None), (None, None, None, None)]
    names = "doc_id bigint, text string, source string, digest string"
    clash = ["id", "size", "bucket", "chunk", "match", "score", "t", "n", "shard", "length", "hits", "keep_id", "rank"]
    df = spark.createDataFrame(rows, names)
    for c in clash:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
