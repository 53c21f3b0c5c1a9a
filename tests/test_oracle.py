"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.conftest import DATA
from treelake.plans import contents, mutations, registry, scans, stores  # noqa: F401


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    if name not in registry.SQL:
        return
    result = duck.execute(registry.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(result.fetchall(), columns)
