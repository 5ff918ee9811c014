"""Every query of the library's own operators against its SQL; those without one have to return rows of a stable schema."""

from __future__ import annotations

import pytest

from kindred.plans import registry

from .conftest import SMALL

registry.load()
#: Streams and models: no SQL.
FREE = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", FREE)
def test_runs(name, spark):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_stream_agrees_with_batch(spark):
    batch = {(r["day"], r["event_type"]): r["n"] for r in registry.QUERIES["events_window"](spark, SMALL).collect()}
    stream = registry.QUERIES["stream_dedup_window"](spark, SMALL).collect()
    assert stream and all(batch[r["day"], r["event_type"]] == r["n"] for r in stream)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
