import random

import pytest

#: Columns whose names clash with those that the operators use inside.
CLASHING = "key long, rid string, fp long, runs string, words string, component string, n long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def _row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 1, "r", 2, "x", "w", "c", 3)


def texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "Eren", "tion", "ou", "wh", "and", "Ñandú", "über", "x", "zz", "thon", "ble", "ing", "était", "漢字"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) + str(rng.randrange(9)) * (rng.random() < 0.3) for _ in range(n))
    shared, base = say(60), say(120)
    near = base.split()
    rows = [_row(1, base), _row(2, base), _row(3, " ".join(["new", *near[1:]])), _row(4, "\n".join([say(20), shared, say(20)])), _row(5, say(9) + "  " + shared + "\t" + say(5))]
    rows += [_row(6, None, None), _row(7, ""), _row(8, " \n\t "), _row(9, "one"), _row(10, "two words"), _row(10, "two words"), _row(10, "other text of the same id"), _row(None, shared + " tail"), _row(None, None)]
    rows += [_row(11, "spam spam " * 200), _row(12, "é" * 500 + "漢" * 300), _row(13, "no-letters 123 !!!".replace("no-letters", "---")), _row(14, say(4000)), _row(15, "퟿\U0001f642 \x1c\x85 x²  ³")]
    rows += [_row(20 + i, say(rng.randrange(1, 80)), rng.choice(["en", "fr", None])) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
