from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997} tail{i}" for i in range(20_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns that clash in name."""
    rows = [(1, "one two three four five six seven", "en", "a", 7), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, LONG, "en", None, 1), (5, " \n\t ", "de", "b", 2), (1, "one two three four five six seven", "en", "a", 7),
            (None, "no id here at all, seven words", "fr", "c", 3), (6, "é😀 ñ▁x  y z", "es", "a", 4)]
    names = ["kept", "SHARD", "slot", "class_id", "spans", "row", "body", "n_words", "perplexity", "sequence_id", "label", "__g", "v"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([r + ("x",) * len(names) for r in rows], schema)
