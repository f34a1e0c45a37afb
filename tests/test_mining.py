import random

import pytest

from palimpsest.operators import mining

SCHEMA = "v0 string, v1 string, e1 int, key array<int>"


def reference(keys, one_to_one):
    """The loop of the reference, for one version pair: places of the instances that aren't skipped."""
    elemsl, kept = [], []
    for place, ikey in enumerate(keys):
        if not elemsl:
            elemsl = [{x} for x in ikey]
            kept.append(place)
            continue
        all_match = any_match = False
        if one_to_one:
            all_match, any_match = not any(one_to_one), all(one_to_one)
        if any_match:
            skip = any([x in elemsl[i] for i, x in enumerate(ikey)])
        elif all_match:
            skip = all([x in elemsl[i] for i, x in enumerate(ikey)])
        else:
            skip = all([x in elemsl[i] for i, x in enumerate(ikey) if not (one_to_one and i < len(one_to_one) and one_to_one[i])])
        if not skip:
            kept.append(place)
            for i, x in enumerate(ikey):
                elemsl[i].add(x)
    return kept


def kept(spark, keys, parts, one_to_one):
    rows = [("a", "b", i, list(k)) for i, k in enumerate(keys)]
    random.Random(0).shuffle(rows)
    return sorted(r["e1"] for r in mining.first_seen(spark.createDataFrame(rows, SCHEMA), ["e1"], parts, one_to_one).collect())


def test_positions_have_sets_of_their_own(spark):
    assert kept(spark, [(1, 2), (3, 1)], 2, [True, True]) == [0, 1]


@pytest.mark.parametrize("one_to_one", [None, [False] * 3, [True] * 3, [True, False, False], [False, True], [False, False, True]])
def test_modes_against_the_loop(spark, one_to_one):
    rng = random.Random(5)
    keys = [tuple(rng.randrange(12) for _ in range(3)) for _ in range(120)]
    assert kept(spark, keys, 3, one_to_one) == reference(keys, one_to_one)
