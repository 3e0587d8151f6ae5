import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, k1 long, _text string, "
          "_key1 long, _row string, severity double, component_id long, places binary, label int")


def _row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "a", len(text or ""), 1, 2, "x", 3, "r", 0.5, 4, b"p", 1)


@pytest.fixture(scope="session")
def texts():
    """Random texts with copies, near copies, shared passages, odd characters, nulls and long ones."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        words = []
        for _ in range(n):
            word = rng.choice(vocabulary)
            words.append(word.capitalize() if rng.random() < 0.1 else word + rng.choice(["", "", "", ",", ".", ".\n"]))
        return " ".join(words)

    passage = prose(60)
    out = [prose(rng.randint(1, 160)) for _ in range(60)]
    out += [out[3]] * 5 + [out[4] + " tail"] * 2
    out += [prose(20) + "\n" + passage + "\n" + prose(30) for _ in range(4)]
    out += [None, "", " \t\n", "one", "one two", "x y z " * 300, "\x01\x1c\x85 é 日本 𝄞\x0b\x0cz", prose(9000),
            "a@b.co +1 (017) 555-7713 4111 1111 1111 1111 1.2.3.4", "THE!! END!! " * 40, "##% $$ " * 60]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """One row per text, a null id, a repeated row, and extra columns with awkward names."""
    rows = [_row(i, t, None if i % 7 == 0 else "en" if i % 2 else "de") for i, t in enumerate(texts)]
    rows += [_row(None, texts[0]), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
