import pytest
from pyspark.sql import types as T

EXTRA = ["kept", "found", "key", "label", "text_key", "set_id", "left", "dropped", "score", "n_words",
         "component_id", "rest_0", "found_0", "keys", "spans", "ids"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in EXTRA])


def sentence(seed: int, n: int) -> str:
    """n words that no other seed gives, ended as a sentence."""
    return " ".join(f"w{chr(97 + seed % 26)}{chr(97 + seed // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"
                    for i in range(n)) + "."


def texts():
    base = "\n".join(sentence(i, 30) for i in range(4))
    return [
        (1, base), (2, None), (3, ""), (None, base), (None, None),
        (4, "\n".join(sentence(100 + i, 60) for i in range(800)) + " tail" * 40_000),
        (5, base), (1, base), (6, " \t\n "), (7, base.replace("waacaa", "changed")), (8, "one two"),
        (9, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" mail a.b@c.example.com from 10.0.0.1, "
            "card 4111 1111 1111 1111 or +1 (743) 555-3824. é😀 Released under the MIT License."),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """doc_id -> text of the smallest driver table."""
    from tests.conftest import SF001
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
