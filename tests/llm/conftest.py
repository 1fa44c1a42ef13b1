import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 40, 80, 200])) + ".\n" + prose(rng, 30) for _ in range(60)]
    out = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    long = prose(rng, 20_000)
    out += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", None, 4), (103, long, "de", "src1", len(long)), (None, texts[0], "en", "src1", None), (None, None, None, None, None)]
    out += [(104, texts[3], "en", "src2", 1), (104, texts[3], "en", "src2", 1), (7, texts[7], "en", "src3", len(texts[7])), (105, "one", "en", "src0", 3), (106, "One", "en", "src0", 3), (107, "a b c", "en", "src0", 5)]
    for k in range(12):  # near copies of one text
        words = texts[10].split(" ")
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 99))
        t = " ".join(words)
        out.append((200 + k, t, "en", "src1", len(t)))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns of the names that operators make."""
    from pyspark.sql import functions as F

    names = "size key shard slot fingerprint spans copies taken target n_words kept rejected_by n_lines n_dropped row pos cid sig label piece rank law length offset sequence_id score drop first".split()
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def random_prose():
    return prose
