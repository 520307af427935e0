"""The more intricate queries against their SQL on the smallest tables (ORACLES=all: all of the newer modules)."""

import math
import os

import pytest

from spanveil.plans import derived, exchange, places, sessions

DATA = "/root/testdata/sf0.001"
QUERIES = sessions.QUERIES | places.QUERIES | derived.QUERIES | exchange.QUERIES
ORACLES = sessions.ORACLES | places.ORACLES | derived.ORACLES | exchange.ORACLES
INTRICATE = (
    "approval_decisions", "resolved_references", "markers_once", "buffered_feed", "token_paths", "report_problems", "import_manifest", "sheet_annotations", "contextual_identities",
    "record_violations", "window_spans", "recogniser_noise", "event_streams", "recall_by_source", "detector_slices", "injected_instructions",
)
NAMES = sorted(ORACLES) if os.environ.get("ORACLES") == "all" else INTRICATE


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return tuple(map(value, v)) if isinstance(v, list | tuple) else v

    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), columns)
