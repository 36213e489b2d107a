import random

import pytest

from skein.llm.common import ship_package

LANGS = {"en": "the of and ing tion er ly th ou", "de": "der und ung keit sch ein ver ich ach", "es": "que ción los ado mente ar el ña ez"}
INSULTS = ["moron", "trash", "scum", "loser"]


def sentence(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """doc_id, text, lang, source, and columns that clash with names the operators use inside."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = rng.choice(list(LANGS))
        words = sentence(rng, LANGS[lang].split(), rng.randint(30, 200)).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), lang))
    texts = {i: t for i, t, _ in rows}
    rows += [(200 + k, texts[k], "en") for k in (1, 2, 3)]                       # copies
    rows += [(210 + k, texts[k] + " one more", "en") for k in (1, 2, 4)]          # near copies
    rows += [(220, None, "en"), (221, "", None), (222, " \n ", "de"), (223, "word", "en"), (224, "word", "en"), (225, "two words", None)]
    rows += [(None, texts[5], "en"), (7, texts[7], rows[7][2]), (7, texts[7], rows[7][2])]  # no id; repeated rows
    rows.append((230, sentence(rng, LANGS["en"].split(), 30_000), "en"))         # very long
    rows.append((231, "x" * 50_000, "en"))                                       # one very long word
    rows.append((232, "é" * 300 + " 中文 " + "😀" * 3 + " It's we're DON'T ''s 1234 　 <|endoftext|> end", None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    ship_package(spark)
    data = [(i, t, lang, None if i is None else f"src{i % 3}", None, 0.5, "x", 1) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, n int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
