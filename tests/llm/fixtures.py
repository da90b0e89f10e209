"""Small documents with every oddity the operators must bear."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, document string, copies int"


def odd_documents(spark, n=60, seed=3):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names the operators use too."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "über", "ñandú", "$$$", "12", "été"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(n)]
    texts += [None, "", "   ", "\n\n", "\x00\x1c!", "😀 \ud83d".encode("utf-8", "replace").decode(), "x" * 5000, " ".join(rng.choices(words, k=60_000)), texts[0], texts[0], "The\tQuick", "the quick"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t or ""), 7, "f", "d", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s1", 5, 7, "f", "d", 3), rows[0], rows[0], (5, "another text", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
