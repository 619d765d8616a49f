import duckdb
import pytest

from tidemark.llm.queries import ORACLE


@pytest.fixture
def by_sql():
    """The SQL of a query over tables given as pandas frames: its rows, columns sorted by name."""

    def run(name: str, **tables):
        con = duckdb.connect()
        for k, v in tables.items():
            con.register(k, v)
        cursor = con.execute(ORACLE[name])
        names = [c[0] for c in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)

    return run


@pytest.fixture
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
