"""A small corpus with everything that may go wrong in it."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, node bigint, size int"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus_rows() -> list[tuple]:
    base, other = words(1, 120), words(2, 200)
    cut = base.split(" ")
    near = " ".join([*cut[:40], "changed", *cut[41:]])
    family = [" ".join(w if (i * 7 + k) % 40 else f"x{k}" for i, w in enumerate(cut)) for k in range(25)]
    texts = [
        base, base, base.upper(), near, other, None, "", "   \n\t ", "one", "One", "two words", "two words", "a b c d", "A b  c\td",
        words(3, 20000), "wall " * 3000, "é" * 5000, "x" * 30000, "smörgås 你好 😀 " * 60, words(4, 90) + " " + other, words(5, 90) + " " + other, *family,
    ]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), -i, 7, i % 2) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(4, other, "en", "src1", 1, 0, 0, 0), (None, base, "en", "src0", 1, 0, 0, 0), (None, "lonely text with no id at all", None, None, 1, 0, 0, 0), (2**60 + 1, words(6, 30), "en", "src2", 1, 0, 0, 0), (n, words(6, 30), "en", "src2", 1, 0, 0, 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def corpus(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('corpus')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('corpus')}/empty.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
