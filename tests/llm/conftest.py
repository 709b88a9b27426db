"""Texts that every operator has to take: null, empty, blank, long, repeated, and letters of other scripts."""

import random

import pytest

SYLLABLES = "ra ti lo me sun ba ko ni fe du".split()


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    long = prose(1, 30_000)
    base = prose(2, 300)
    return [None, "", " \n\t ", "Word", "two words", base, base, base.upper(), base + " end", long, long + "!", "x" * 50_000,
            "Ünïcode ñandú — 東京 😀 é ﬁ", "a b c\x1cd", "tab\tline\r\nbreak\n\n\nend ", "<|endoftext|> <|startoftext|>it's we'RE", None, "",
            "BU KARAR İPTAL EDİLDİ. TÜRKİYE'Yİ, GEZDİ!"]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Odd texts with ids that are null or repeated, and columns named like results and working columns."""
    ids = [None if i in (4, 11) else (7 if i in (2, 3) else i) for i in range(len(odd_texts))]
    rows = [(i, t, "en", "a", 1, "x", True, f"k{n}", n % 3) for n, (i, t) in enumerate(zip(ids, odd_texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, rid long, key string, kept boolean, `row` string, `score` int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
