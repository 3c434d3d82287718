import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts of every awkward kind.
HARD = [
    None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\tand\nlines\n\nmore", "naïve é ß ñ", "emoji 😀 end", " nbsp 　 wide", "x" * 20000, "word " * 20000, "<|endoftext|> as text", "same text here now ok", "same text here now ok",
    "don't you'll we've", "end.\nStart, next.\nLast", "\x00\x1c control \x1c", "Kİ kelvin K",
]


@pytest.fixture(scope="session")
def hard(spark):
    """The awkward texts with repeated ids, null ids, null sources and extra columns that clash with names used inside."""
    rows = [(i // 2 if i > 3 else i, t, "en", None if i % 5 == 0 else f"src{i % 3}", i, "x", "y") for i, t in enumerate(HARD)] + [(None, "no id at all here", "en", "src1", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, path string")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
