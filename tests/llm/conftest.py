import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, set_id string, h string, size string, held_out string, score string, piece string, home string, component_id string, gram string, spans string, copies string"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
STORY = " ".join(f"tale{i}" for i in range(120))


def row(doc_id, text, lang="en", source="s1", *, n_chars=0):
    return (doc_id, text, lang, source, n_chars, 1, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x")


ROWS = [
    row(1, STORY),
    row(2, STORY, source="s2"),
    row(3, STORY.replace("tale50 ", "other50 "), source=None),
    row(3, STORY.replace("tale50 ", "other50 "), source=None),
    row(4, None, None, None),
    row(5, "", None, ""),
    row(6, "  \n\t "),
    row(7, "one two"),
    row(8, "ONE two", source="s2"),
    row(9, " ".join(f"intro{i}" for i in range(40)) + "\n" + PASSAGE),
    row(10, PASSAGE + " " + " ".join(f"outro{i}" for i in range(40))),
    row(None, STORY),
    row(None, None, None, None),
    row(11, "same line here\n" * 12 + "end"),
    row(12, "word " * 40),
    row(13, "12345 !!! ###"),
    row(14, " ".join(f"w{i % 997}x{i}" for i in range(30000))),
    row(15, "<|endoftext|> é ünï     漢字 🙂 'll 12"),
    row(-5, "negative id " + " ".join(f"n{i}" for i in range(30))),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
