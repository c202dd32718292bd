"""Documents with awkward values: nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, fp long"


def rows():
    long = " ".join(f"word{i % 997} of {i}" for i in range(20_000))
    base = [f"the {i} quick brown fox jumps over the lazy dog number {i * i}, and then it sleeps." for i in range(30)]
    texts = [None, "", "   \n ", "one", "one", long, "\n".join(base), "\n".join(base), "\n".join(base[:29]), "Åäö ñ 漢字 😀 <|endoftext|> É", "A\x00b\tc", "x" * 5000]
    out = [(i, t, "en", "s", len(t or ""), 0.5, 7, 7) for i, t in enumerate(texts)]
    out += [(3, "one", "en", "s", 3, 0.5, 7, 7), (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, "another text of seven", "en", None, 1, 0.1, 1, 1)]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
