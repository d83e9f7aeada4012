import pytest

from wattframe.llm.scratch import reachable

SF = "/root/testdata/sf0.001"

#: Texts every operator must survive: null, empty, blank, ties, repeats, long words and long texts.
ODD_TEXTS = [None, "", " \n\t ", "a", "a", "a b", "é ü ñ 你好 🙂", "x" * 5000, "word " * 3000,
             "one two three four five six seven eight nine ten eleven", "Line one\nLine one\n\nLine two\nLine one"]


@pytest.fixture(scope="session")
def llm(spark):
    reachable(spark)
    return spark


@pytest.fixture
def odd_docs(llm):
    """Odd texts, repeated rows, a null id and columns that clash with result names."""
    rows = [(i, t, None if i % 2 else "en", "s", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[9], (None, "no id here", "en", None, None)]
    names = ("doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, "
             "fingerprint int, component_id string, spans long, start string, offset int, fp int")
    return llm.createDataFrame([(*r, "k", "w", 1, "c", 2, "s", 3, 4) for r in rows], names)


@pytest.fixture
def no_docs(llm):
    return llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
