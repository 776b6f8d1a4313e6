import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import SF

from topicflow.llm import queries

ODD_TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "word"),
    (6, "Word"),
    (7, "word word"),
    (8, "línea ñandú 東京 \U0001f600   end\x00\x1c"),
    (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 300),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 300),
    (11, "same " * 5000),
    (12, "idiot moron, clown!\nidiot moron, clown!\n\nidiot"),
    (13, "x" * 250),
    (14, "y" + "x" * 250),
]


@pytest.fixture(scope="session")
def texts():
    return ODD_TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, and columns with names that the
    operators use themselves."""
    rows = [(k, t, None if k % 4 == 0 else ("en", "fr", "de")[k % 3], None if k % 5 == 0 else f"s{k % 2}", 0) for k, t in ODD_TEXTS]
    rows += [rows[0], rows[8], (None, ODD_TEXTS[0][1], "en", "s1", 0), (None, None, None, None, None)]
    names = ["id", "hash", "text_", "mix", "quality", "language", "toxicity", "kept_id", "suffix", "size", "places", "Component"]
    rows = [(*r, *range(len(names))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return queries.table(spark, SF, "documents")
