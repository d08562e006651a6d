import pytest

from tallyframe.llm import reachable


@pytest.fixture(scope="session")
def cases(spark):
    """(frame of documents, plain rows): nulls, empty and blank texts, a very
    long text, ties, repeated rows, near copies, clashing extra columns."""
    reachable(spark)
    base = [f"w{i} Word{i * 7 % 40}é" for i in range(60)]
    prose = " ".join(base)
    rows = [
        (1, prose), (2, prose), (2, prose), (None, prose), (None, None), (3, None), (4, ""), (5, " \t\n "), (6, "one"),
        (7, "one two three four"), (8, "ONE two three FOUR"), (9, prose.replace("w30", "x30")), (10, " ".join(base[20:] + base[:20])),
        (11, "the line\nthe line\nother\n the line\n" * 3), (12, "a b c " * 40), (13, "#$%|<> & * x y 　z"),
        (14, "mail me at bo.b@ex-1.example.org, or +1 (555) 010-9999; 10.0.0.256 10.0.0.255 4111 1111 1111 1111 0"),
        (15, "x" * 30_000), (16, " ".join(f"long{i % 977} {i}" for i in range(30_000))), (17, "é" * 900 + prose), (18, prose + prose[:410]),
    ]
    wide = [(i, t, "k", [i or 0], j, 5, 7, "s", 1.5) for j, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(
        wide, "doc_id bigint, text string, words string, bands array<bigint>, row bigint, part int, n bigint, set_key string, kept double"
    ).repartition(3)
    return frame, rows


@pytest.fixture(scope="session")
def nothing(cases):
    return cases[0].where("false")


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
