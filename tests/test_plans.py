import html
import importlib
import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if hasattr(v, "__iter__") and not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(str, ([plain(x) for x in r] for r in want.fetchall())))
    assert rows == sorted(map(str, ([plain(r[c]) for c in columns] for r in got.collect())))


def test_all_but_one_query_has_sql(spark, sf):
    assert set(QUERIES) - set(ORACLES) == {"fit_markdown"}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["markdown"] for r in QUERIES["fit_markdown"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        title = html.unescape(re.search(r"<h1>(.*?)</h1>", page, re.S)[1])
        assert f"# {' '.join(title.split())}" in got[i] and "<p>" not in got[i] and "track(" not in got[i] and len(got[i]) <= 12_000 + len("\n...[truncated]")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_alone(monkeypatch):
    """Nothing but the entry point knows of the corpus operators, and it does without them."""
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("pagewright.llm")]:
        monkeypatch.delitem(sys.modules, m)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("pagewright.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert not any(q.startswith("op") and q[2].isdigit() for q in importlib.reload(entry).queries())
    assert entry.oracle_sql().keys() == ORACLES.keys()
