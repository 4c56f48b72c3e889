import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or return.
CLASHING = "score double, kept boolean, component_id long, fp long, block long, shard int, size long, _row string, _id long, label int"

LONG = "word and more words here. " * 60_000  # over the size that is taken apart


def words(n, start=0):
    return " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(start, start + n))


EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "two words"),
    (6, words(40)),
    (7, words(40)),  # equal texts
    (8, words(40, 100)),
    (8, words(40, 100)),  # a repeated row
    (9, words(40, 200)),
    (9, words(40, 300)),  # one id, two texts
    (None, words(40, 400)),  # no id
    (None, None),
    (10, LONG),
    (11, "x" * 50_000),  # one very long word
    (12, "don't  stop\n\nnow   中文字 ½ 12ab́ \U0001f600!"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "src0", "src1", "src0"][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    rows = [(i, words(30, 7 * i), "en", f"src{i % 3}", 9, 0.5, True, 1, 2, 3, 4, 5, "r", 6, 1) for i in range(12)]
    return spark.createDataFrame(rows, COLUMNS + ", " + CLASHING).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
