import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards hum old songs beneath tall silver towers".split()


def text(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i + i // 3) % len(WORDS)] for i in range(n)) + "."


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, `key` string, fp string, score string, `count` int, label int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    extra = (1, "k", "f", "s", 2, 3)
    rows = [(i, text(i, 30 + i), "en", f"src{i % 3}", 100, *extra) for i in range(12)]
    rows += [(20, None, "en", "src0", None, *extra), (21, "", None, "src1", 0, *extra), (22, " \n\t ", "en", None, 4, *extra), (None, text(3, 40), "en", "src1", 5, *extra)]
    rows += [rows[4], rows[4], (30, text(5, 20_000), "de", "src2", 9, *extra), (31, "x" * 50_000, "de", "src2", 9, *extra), (32, "one", "en", None, 3, *extra)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(40, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
