import random

import pytest

#: Columns named like the operators' own; extra columns must not disturb them.
EXTRA = ("node", "component", "class_id", "size", "shard", "slot", "h1", "score", "llr", "domain", "part", "epochs", "budget", "key", "block", "n_tokens", "label", "low", "text_crc32", "held_out", "base", "weak", "host")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, lang, s in rows], SCHEMA)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank, long and repeated texts, one id for several rows."""
    long = prose(1, 30_000)
    rows = [
        (1, None, None, None), (2, "", "en", "src1"), (3, " \t\n\x0b ", "en", "src1"), (None, "a text without an id at all", "en", None),
        (None, None, None, None), (4, long, "en", "src2"), (5, long, "de", "src2"), (5, long, "de", "src2"), (6, "one", "", ""), (6, "two words", "fr", "src0"),
        (7, "é" * 5000, "fr", "src0"), (8, prose(2, 80), "en", "src3"), (9, prose(2, 80), "en", "src3"), (10, "🙂 emoji space stays one word", "es", "srcX"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
