from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain import prose, words  # noqa: E402

@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, junk, nulls, empty and very long texts, odd characters."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    out = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    out += [out[3], out[3], out[5], out[7].upper(), out[8].replace(" ", "\n", 3)]
    out += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 20) for _ in range(6)]
    out += [passage, " ".join([passage, passage]), "a " * 400, "a", "", None, " \n\t ", "é è ñ ß ﬁ Ａ é \U0001F600  x y", "日本語 テキスト 한국어", "x" * 5000, None, ""]
    out += [" ".join(words(out[10])[:-1] + ["zz"]), prose(rng, 3000), "line one here\nline one here\nother line\n\n"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}", len(t or ""), i, "x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, fp string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
