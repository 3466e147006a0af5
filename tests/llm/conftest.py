import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named like the operators' own."""
    long_text = " ".join(f"word{i % 9000} the of" for i in range(40_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "src0", 35), (1, "Alpha beta gamma delta epsilon zeta", "en", "src0", 35),
        (2, None, "en", None, None), (3, "", None, "src1", 0), (None, "no id here at all", "fr", "src1", 17), (None, None, None, None, None),
        (4, long_text, "en", "src0", len(long_text)), (5, " \t\n ", "de", "src2", 4), (6, "x" * 50_000, "es", "src2", 50_000),
        (7, "l'été à l’école — ÀÉÎ 漢字 🙂 <|endoftext|> don't\u00a0stop", "fr", "src2", 40), (8, "Alpha beta gamma delta epsilon zeta", "en", "src3", 35),
    ]
    extra = ["fp", "root", "id", "score", "host", "path", "ids", "part", "__key2", "length", "node", "label", "kept"]
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(*r, *["e"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
