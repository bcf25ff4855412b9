from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use themselves.
EXTRA = ("size", "kept", "n_words", "label", "node", "rate", "key", "a", "b", "spans", "value", "h", "n", "copies", "__doc")

LOREM = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
ODD = [
    (1, LOREM, "en", "s1", 0),
    (1, LOREM, "en", "s1", 0),
    (2, LOREM, None, None, 0),
    (None, LOREM + " end", "de", "s2", None),
    (None, None, None, None, None),
    (3, None, "en", "s1", 0),
    (4, "", "en", "s1", 0),
    (5, " \n\t ", "de", "s2", 0),
    (6, "one", "de", "", 0),
    (7, "mail a.b@c.example.org, ip 10.0.0.1 tel +1 (310) 555-4510 card 4539578763621486", "en", "s1", 0),
    (8, "Released under the MIT license. \x00 é 中文 🙂 ", "en", "s3", 0),
    (9, "x" * 300_000, "en", "s3", 0),
    (10, "ab cd " * 60_000, "en", "s3", 0),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, *("clash",) * len(EXTRA)) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
