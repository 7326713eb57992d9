import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, key string"


def sentence(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def twins() -> tuple[str, str]:
    """Two words of 1,024 letters that polynomial hashes modulo 2**64 take for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and clashing column names."""
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None, "en", "a", None, 1, True, "x"),
        (1, "", None, None, 0, None, None, None),
        (2, "  \n\t ", "en", "", 5, 1, True, "x"),
        (3, base, "en", "a", 5, 1, False, "x"),
        (4, base.upper(), "en", "b", 5, 1, True, "x"),
        (5, " ".join(near), None, "b", 5, 1, True, "x"),
        (6, "one two three", "de", "c", 5, 1, True, "x"),
        (7, "One  two\nthree", "de", "c", 5, 1, True, "x"),
        (8, sentence(2, 40_000), "de", "a", 5, 1, True, "x"),
        (9, "naïve — “quotes” 漢字 \U0001f600 don't <|endoftext|> x", "fr", "a", 5, 1, True, "x"),
        (9, "naïve — “quotes” 漢字 \U0001f600 don't <|endoftext|> x", "fr", "a", 5, 1, True, "x"),
        (None, sentence(3, 30), "fr", "a", 5, 1, True, "x"),
        (10, "### ### ### %%% &&& " * 40, "en", "a", 5, 1, True, "x"),
        (11, "same line here\nsame line here\nother\nsame line here\n" + sentence(4, 60), "en", "a", 5, 1, True, "x"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
