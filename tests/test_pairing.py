import random

from palimpsest.operators import pairing
from palimpsest.operators.alignments import _changed, dissimilarity, lcs

SCHEMA = "path string, dir string, name string, digest string"


def test_dissimilarity():
    assert dissimilarity("abc", "abc") == 0 and dissimilarity("abc", "axc") == 1 / 3 and dissimilarity("abc", "abxyc") == 2 / 3
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc/") for _ in range(rng.randrange(1, 14))) for _ in "12")
        c1, c2 = _changed(a, b)
        kept = ["".join(x for x, c in zip(s, cs) if not c) for s, cs in ((a, c1), (b, c2))]
        assert kept[0] == kept[1] and len(kept[0]) == len(lcs(a, b))


def files(spark, rows):
    return spark.createDataFrame([(p, p.rpartition("/")[0], p.rpartition("/")[2], d) for p, d in rows], SCHEMA)


def test_names_with_several_files(spark):
    left = files(spark, [("src/alpha/index.html", "1"), ("src/beta/Index.html", "2"), ("zz/qqqqqqqq/index.html", "3"), ("a/one.c", "4"), ("p/same.c", "7"), ("q/x.c", "8"), ("r/x.c", "9")])
    right = files(spark, [("new/src/alpha/index.html", "a"), ("new/src/beta/index.html", "b"), ("other/index.html", "c"), ("b/one.c", "d"), ("m/same.c", "7"), ("q2/x.c", "8")])
    got = sorted((r["path1"], r["path2"]) for r in pairing.by_name(left, right).collect())
    assert got == [("a/one.c", "b/one.c"), ("src/alpha/index.html", "new/src/alpha/index.html"), ("src/beta/Index.html", "new/src/beta/index.html"), ("zz/qqqqqqqq/index.html", "other/index.html")]
