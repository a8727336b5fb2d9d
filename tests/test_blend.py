"""Published one-pixel results of each blend mode."""

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import blend

S, D = (100, 200, 250, 128), (100, 50, 200, 255)
# Mode, source, destination, result.
ANCHORS = [
    (1, S, D, (100, 50, 200, 255)), (2, S, D, (69, 45, 198, 255)), (4, S, D, (50, 25, 197, 255)), (2, (147, 97, 187, 104), (226, 226, 226, 255), (187, 169, 201, 255)),
    (6, S, D, (100, 50, 200, 255)), (13, S, D, (100, 125, 225, 255)), (6, (84, 51, 250, 255), (84, 56, 222, 255), (84, 51, 250, 255)),
    (7, S, D, (100, 125, 225, 255)), (8, S, D, (131, 131, 227, 255)), (14, S, D, (89, 64, 227, 255)), (16, S, D, (89, 109, 227, 255)), (15, S, D, (93, 68, 213, 255)), (17, S, D, (78, 83, 228, 255)),
    (18, S, D, (72, 123, 228, 255)), (19, S, D, (100, 98, 223, 255)), (20, S, D, (50, 25, 228, 255)), (5, S, D, (50, 25, 100, 255)), (21, S, D, (50, 100, 125, 255)), (22, S, D, (111, 111, 129, 255)),
    (5, (252, 50, 252, 253), (252, 80, 252, 255), (3, 30, 3, 255)), (26, S, D, (144, 102, 228, 255)), (36, S, D, (178, 57, 202, 255)), (11, (100, 50, 100, 128), (0, 0, 200, 255), (50, 25, 228, 255)),
    (12, (100, 50, 0, 128), (0, 0, 200, 255), (50, 25, 200, 255)), (12, (66, 251, 182, 2), (169, 32, 253, 53), (167, 49, 252, 55)), (12, (90, 252, 207, 95), (169, 32, 253, 219), (199, 142, 252, 232)),
    (9, S, D, (132, 141, 228, 255)), (3, S, D, (50, 25, 199, 255)), (10, S, D, (124, 82, 255, 255)), (10, (165, 116, 255, 140), (0, 0, 0, 101), (75, 53, 116, 241)),
    (23, S, D, (52, 77, 177, 255)), (23, (84, 51, 250, 77), (103, 64, 15, 255), (93, 62, 54, 255)), (23, (84, 51, 250, 255), (112, 83, 16, 255), (85, 69, 165, 255)),
    (24, S, D, (100, 50, 200, 255)), (24, (84, 51, 250, 255), (225, 224, 226, 255), (221, 221, 255, 255)), (24, (84, 51, 250, 255), (202, 196, 230, 255), (203, 192, 255, 255)),
    (25, S, D, (52, 78, 177, 255)), (25, (84, 51, 250, 255), (0, 0, 241, 255), (28, 0, 168, 255)),
]
KEPT = [(12, (114, 50, 50, 128)), (9, (75, 50, 50, 128)), (3, (25, 25, 25, 128)), (10, (66, 50, 50, 128))]
COLUMNS = ["sr", "sg", "sb", "sa", "dr", "dg", "db", "da", "mask", "opacity"]


def run(spark, mode, cases, preserve=False):
    df = spark.createDataFrame([(*s, *d, 255, 256) for s, d in cases], COLUMNS).coalesce(1)
    return [tuple(r) for r in blend.blend(mode, preserve).apply(df).select(*(F.col(c).cast("int") for c in "rgba")).collect()]


@pytest.mark.parametrize("mode", sorted({m for m, *_ in ANCHORS}))
def test_anchor(spark, mode):
    cases = [(s, d, want) for m, s, d, want in ANCHORS if m == mode]
    assert run(spark, mode, [c[:2] for c in cases]) == [c[2] for c in cases]


@pytest.mark.parametrize(("mode", "want"), KEPT)
def test_preserved_alpha(spark, mode, want):
    assert run(spark, mode, [((128, 0, 0, 128), (50, 50, 50, 128))], True) == [want]


def test_normal_twice(spark):
    first = run(spark, 0, [((0, 0, 0, 26), (255, 255, 255, 0))])
    assert run(spark, 0, [((197, 182, 252, 91), first[0])]) == [(168, 155, 214, 107)]
