"""Lines of a report on numbers halfway between two that can be printed."""

import duckdb

from pluvio.plans import pixel_queries, registry

#: speed, bearing and confidence; half of them lie halfway, the others a little beside.
CELLS = [(18.5, 22.5, 0.125), (92.5, 0.5, 0.575), (19.5, 23.5, 0.375), (18.500001, 22.499999, 0.125001), (0.0, 0.0, 1.0)]


def test_halves_are_printed_as_in_the_twin(spark, sf_dir, monkeypatch):
    found = spark.createDataFrame([(1, 0, 0, i, 10.0, 20.0, *c) for i, c in enumerate(CELLS, 1)], "session_id long, location_id long, root_frame long, root_label int, row_c double, col_c double, speed_kmh double, bearing double, mean_conf double")
    monkeypatch.setattr(pixel_queries.detect, "evaluate", lambda *a, **k: found)
    lines = [r.line for r in registry.QUERIES["report_cells"](spark, sf_dir).orderBy("number").collect()]
    told = [line.partition(") ")[2] for line in lines]
    twin = duckdb.connect()
    assert told == [twin.execute("select printf('speed=%.0fkm/h bearing=%.0f conf=%.2f', ?::double, ?::double, ?::double)", c).fetchone()[0] for c in CELLS]
    assert told == [f"speed={s:.0f}km/h bearing={b:.0f} conf={m:.2f}" for s, b, m in CELLS]
    assert lines[0].startswith("  #1: (-32.67, 150.65) ")
