import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators use inside, or with documents' own but for case.
CLASHES = ("TEXT", "row", "kept", "lines", "size", "fp", "key", "salt", "target", "score", "of", "pos")

LONG = " ".join(f"wort{i % 977} und{i % 13}" for i in range(30_000)) + "\nletzte zeile hier."
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "The quick brown fox jumps over the lazy dog.", "en", "b", 44),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "Some text without an id.", "en", "a", 24),
    (None, None, None, None, None),
    (5, LONG, "de", "b", len(LONG)),
    (6, " \n \t\n", "en", None, 5),
    (7, "Erste Zeile.\nZweite Zeile.\nErste Zeile.", "de", "a", 38),
    (7, "Erste Zeile.\nZweite Zeile.\nErste Zeile.", "de", "a", 38),
    (8, "日本語のテキスト <|endoftext|> \x01 naïve café!!", "ja", "c", 30),
]


def widened(df):
    from pyspark.sql import functions as F

    return df.select(*(F.lit(f"clash {c}").alias(c) for c in CLASHES[1:]), "*", F.lit("clash").alias("TEXT"))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    return widened(spark.createDataFrame(ROWS, SCHEMA).coalesce(2))


@pytest.fixture(scope="session")
def empty(spark):
    return widened(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def classes(edges, nodes):
    """The smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="session")
def union_find():
    return classes
