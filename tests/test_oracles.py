"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

from oracle import compare, connect
from tracelake.plans import registry

registry.load_all()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    verdict, _, detail = compare(spark, con, SF_DIR, name, registry.QUERIES[name], registry.ORACLES.get(name))
    assert verdict in ("ok", "rows-only"), detail


def test_registry_is_covered():
    assert len(registry.QUERIES) > 140
    without = sorted(set(registry.QUERIES) - set(registry.ORACLES))
    assert without == ["document_hash_sha512"]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["event_id", "host", "rule_id", "level", "mitre"] and df.count() > 0
