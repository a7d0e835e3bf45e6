import pytest

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, block long, doc long, slot string, "
    "component_id long, kept string, copies string, hs array<long>, _block string"
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = " ".join(f"word{i}" for i in range(120))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 0.5, 1, 1, "x", 1, "x", "x", [1], "x")


@pytest.fixture(scope="package")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [
        _row(1, BASE), _row(2, BASE), _row(3, BASE.replace("word60", "other")), _row(3, BASE.replace("word60", "other")),
        _row(4, None), _row(5, ""), _row(6, "   \n\t "), _row(7, LONG, None, None), _row(8, LONG, "de", "b"),
        _row(None, BASE, "en", None), _row(None, None, None, None), _row(9, "a"), _row(10, "\x00\x01\x02 token = abc123def", "fr", "b"),
        _row(11, "ÄÖÜ straße ürgend einen größeren", "de", "c"), _row(12, "!!! 123 ???", "en", "c"), _row(12, "same id, other text"),
        _row(-5, "x" * 300_000, "en", "c"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="package")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
