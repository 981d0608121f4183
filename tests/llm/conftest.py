import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, n_words string, h string"


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    stems = {"en": ["the", "of", "thing", "whether", "north", "earth", "and", "with"], "de": ["der", "und", "schön", "nicht", "zeitung", "ein", "gegen", "über"]}[lang]
    words = [rng.choice(stems) + rng.choice(["", "", rng.choice(stems), str(rng.randrange(40))]) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


def rows():
    """Copies, near copies, shared lines and passages, and the odd cases: nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    texts = [(prose(rng, rng.randrange(3, 120), lang), lang) for lang in ("en", "de") * 20]
    line = "This line of more than forty characters stands in many documents."
    passage = prose(rng, 60)
    for i in range(0, 16, 2):
        texts[i] = (texts[i][0] + "\n  " + line.upper() + "\t\n" + texts[i][0][:30], "en")
    for i in range(1, 9, 2):
        texts[i] = (texts[i][0] + "\n" + passage + "\n" + texts[i][0][:20], "de")
    base = texts[20][0].split(" ")
    for _ in range(6):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts.append((" ".join(near), "en"))
    texts += [texts[3], texts[3], texts[4], ("one two", "en"), ("ONE  two ", "en"), ("a b c d e", "en"), (None, None), ("", "en"), (" \n\t ", None), ("123 456", "de"), ("é" * 3, None), ("\n".join([line] * 3), "en"), (prose(rng, 6000), "en"), ("x" * 70_000, "en"), ("ab" * 400, None)]
    out = [(i, t, lang, ["s1", "s2", None][i % 3] if i % 2 else "big", len(t or ""), i, "clash", "clash") for i, (t, lang) in enumerate(texts)]
    return out + [out[5], out[5]]  # repeated rows


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
