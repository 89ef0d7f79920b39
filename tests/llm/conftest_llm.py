from __future__ import annotations

import pytest

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents with columns whose names clash with the operators' own."""
    def made(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, key long, piece int, rep long, score double"
        return spark.createDataFrame([(i, t, None, "s", None, 9, 9, 9, 0.5) for i, t in rows], schema)
    return made


@pytest.fixture(scope="session")
def corpus(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


#: Null ids, null, empty and odd texts, ties and repeated rows.
EDGES = [(None, "a null key"), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "Same text here, twice."),
         (8, "Same text here, twice."), (8, "Same text here, twice."), (9, "naïve café 中文 𝔘nicode ퟿"),
         (10, "word " * 30_000), (11, "x" * 40_000), (12, "a<|endoftext|>b <|startoftext|>")]
