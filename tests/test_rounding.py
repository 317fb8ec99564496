"""Six decimal places are those of the twins."""

import duckdb

from pluvio.plans.pixel_queries import _r

#: The first is the squared distance of the centroid of 160 pixels, (25.2875, 11.0125), and the pixel (28, 14).
VALUES = [16.2828125, 1.5609375, 0.0078125, -0.0078125, -16.2828125, 3.1415926535, 0.0, 1 / 3, 255.9999995, 118.1796875, 2.0000005, 7.8046874999999]


def test_halves_are_rounded_as_in_the_twins(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, d2 double").orderBy("i").select(*_r("d2")).collect()
    assert [r.d2 for r in got] == [r[0] for r in duckdb.connect().execute("select round(v, 6) from (select unnest(?::double[]) as v)", [VALUES]).fetchall()]


def test_unknown_stays_unknown(spark):
    assert spark.createDataFrame([(None,)], "d2 double").select(*_r("d2")).first().d2 is None
