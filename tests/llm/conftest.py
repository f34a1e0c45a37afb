import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, lang_pred int, copies string, part string, block int, size double, n_words string, shard string, row int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts():
    """Copies, near copies, shared passages, odd spaces, empty, null and long texts, repeated and null ids."""
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    shared = words(rng, 50)
    out = [" ".join(b) for b in base]
    out += [" ".join(base[0]), " ".join(base[1]).upper(), " ".join(base[2][:60] + ["x"] + base[2][61:])]
    out += [" ".join(words(rng, 30) + shared + words(rng, 30)) for _ in range(4)]
    out += ["a " * 90, "b\tc\n" * 60, "one", "two words", "four words are here", "", " \n\t ", None, None]
    out += ["été 　naïve 'tis don't  they'LL\n\n  x'll 12½3 中文 \U0001f642!!", "#*$ %&| <> 1 2 3 a b c"]
    out += [" ".join(words(rng, 9000)), "y" * 3000, "line one here\nline one here\n\nline two\nline one here"]
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    sources = ["b", "a", None, "c", "é", "b", "b"]
    langs = ["en", "de", None]
    out = [(i, x, langs[i % 3], sources[i % 7], len(x or ""), "i", 1, "c", "p", 2, 1.5, "n", "s", 7) for i, x in enumerate(t)]
    out += [out[0], out[0], out[13], (3, t[5], "en", "a", 1, *out[0][5:]), (None, t[4], "en", "b", 1, *out[0][5:]), (None, None, None, None, None, *[None] * 9)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
