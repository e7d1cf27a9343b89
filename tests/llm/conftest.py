import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, block long, size long, carried string, score string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every odd case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" if i % 11 == 0 else f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(50)
    rows = [(i, prose(rng.randrange(1, 200)), "en", f"s{i % 5}") for i in range(60)]
    rows += [(100 + i, prose(20) + "\n" + passage + "\t" + prose(20), "en", "s1") for i in range(4)]
    rows += [(200 + i, rows[3][1], "en", "s2") for i in range(30)]  # a large group of copies
    base = prose(120).split()
    for i in range(25):  # near copies, some of them only near one another
        words = list(base)
        for _ in range(i // 2):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((300 + i, " ".join(words), "en", None))
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, " \t\n", "en", "s1"), (403, "one two", "en", "s1"), (404, "ONE two", "en", "s9"),
             (405, prose(6000), "en", "s1"), (None, prose(30), None, None), (406, "x" * 5000, "en", "s1"), (407, "a b c d", "en", "s1"),
             (408, "naïve — 漢字 \U0001F600 don't 12345   end ", "xx", "s1")]
    rows += [rows[5], rows[5]]  # repeated rows
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 7, 8, "c", "s") for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
