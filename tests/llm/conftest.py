import random

import pytest

WORDS = "the of and alpha beta gamma delta river stone cloud paper green seven lamp house under over licence maker tokens".split()


@pytest.fixture(scope="session")
def small_docs():
    """(doc_id, text) with copies, shared passages, empty, null and long texts, ties and repeated rows."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage = say(30) + "."
    rows = [(i, f"{say(r.randint(3, 60))}\n{passage if i % 4 == 0 else ''} {say(12)} é{i}") for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[3][1] + " x"), (103, ""), (104, None), (105, "a" * 400), (106, "b" + "a" * 200), (107, say(4000)), (108, "one"), (109, "two words"), (110, "   \n\t"), (3, rows[3][1]), (5, "another text with the same id " + passage)]
    return rows


@pytest.fixture
def docs(spark, small_docs):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", 1) for i, t in small_docs], "doc_id long, text string, lang string, source string, n_chars long, shard string, fp int")


@pytest.fixture
def empty(docs):
    return docs.limit(0)
