"""Every registered query against its SQL, and the shape of the plans."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexfit.plans import workload, workload_sql

SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations part"
QUERIES, SQL = workload.QUERIES, workload_sql.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    result = duck.execute(SQL[name])
    order = [[c[0] for c in result.description].index(c) for c in columns]
    assert len(result.description) == len(columns)
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = (
    "extract_links links_per_page top_n_per_page header_fields address_parse address_clean heading_split strip_tags "
    "drop_intro parts_to_columns job_id replace_multi concat_text extract_emails section_tasks section_profile "
    "section_benefits section_contact clean_text tokenize stem_snowball stem_cistem remove_stopwords tokens_to_text "
    "term_counts tidy_text title_clean title_blocklist safe_file_name render_text search_plan"
).split()


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(spark, name):
    exchanges = re.findall(r"Exchange (\w+).*?(\w+_\w+)", plan(QUERIES[name](spark, SMALL)))
    # Only the spreading of a small input over the cores is allowed.
    assert all(kind == "hashpartitioning" for kind, _ in exchanges) and len(exchanges) <= 1


@pytest.mark.parametrize("name", ["fit_report", "rank_average", "language_detect", "lemmatize", "page_archive", "dedupe_first"])
def test_no_python_workers_and_no_global_window(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert not window.endswith(", []]"), window


def test_columns_are_pruned(spark):
    text = plan(QUERIES["job_id"](spark, SMALL))
    assert "html" not in text


def test_entry(spark):
    assert entry_point.entry(spark).count() == 200


def test_scratch_folder_falls_back_for_a_local_session_only():
    """Without spark.checkpoint.dir a local session takes a folder of its own."""
    from types import SimpleNamespace

    from lexfit.session import scratch_dir

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    local = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=Context("local[2]"))
    assert scratch_dir(local) == scratch_dir(local)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "/shared"), sparkContext=Context("yarn"))
    assert scratch_dir(named) == "/shared"
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=Context("yarn"))
    with pytest.raises(RuntimeError):
        scratch_dir(cluster)
