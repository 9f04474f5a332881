import random

import pytest

WORDS = "the of and to in is on by it or on at as alpha bravo carbon delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu étage größe niño".split()


def prose(rng, n, per_line=9):
    words = [rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", str(rng.randrange(90))]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with nulls, empty and very long texts, ties, repeated rows, exact and near copies."""
    rng = random.Random(3)
    out = [(i, prose(rng, rng.choice([3, 4, 5, 6, 40, 90, 200]))) for i in range(120)]
    out += [(200 + i, out[5][1]) for i in range(40)]  # one text holds a large share of the rows
    base = prose(rng, 160).split(" ")
    for i in range(50):  # near copies of one text
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"
        out.append((300 + i, " ".join(words)))
    out += [(400, None), (401, None), (402, ""), (403, " \n\t "), (404, "12 34 !!"), (405, prose(rng, 60_000)), (406, "x" * 300_000), (None, "no id at all"), (None, "no id at all"), (None, None), (7, out[7][1]), (7, out[7][1]), (-3, "a b"), (407, "a  b"), (408, "A\tB")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def work(spark):
    from catchment.llm import shared

    return shared.work_dir(spark, "test")


@pytest.fixture(scope="session")
def tables():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return path
