"""Queries that take the whole of their input, at the size that the operator is meant for."""

from pyspark.sql import functions as F

from kgforge.functions import keys, text
from kgforge.operators import evaluation
from kgforge.plans import evaluating, knowledge, values
from kgforge.plans.catalog import SQL


class Given:
    def __init__(self, **tables):
        self.__dict__.update(tables)


def test_keys_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "First line\nsecond line"), (2, "One"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["normalized"] for r in values.f02(Given(documents=docs)).collect()}
    assert got == {r["doc_id"]: r["n"] for r in docs.select("doc_id", keys.normalize_pk(docs.text).alias("n")).collect()}
    assert "second" in got[1]


def test_bootstrap_has_all_replicates(spark):
    rows = [(k, "s", "x" * (1001 if k % 3 else 9), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    t = Given(documents=docs, labels=spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality long"))
    assert evaluating.a20(t).collect() == evaluation.bootstrap(evaluating.outcomes(t), 2000).collect() != evaluation.bootstrap(evaluating.outcomes(t), 200).collect()


def test_display_of_large_and_missing_numbers(spark):
    import duckdb

    # with event_id % 97 = 96: from bytes to beyond a GB and a billion
    ids = [None, 0, 1, 2, 96, 193, 9699, 1_485_942, 2_000_042, 5_999_934, 60_000_000]
    events = ", ".join(f"({'NULL' if k is None else k}::BIGINT)" for k in ids)
    expected = duckdb.sql(f"WITH events(event_id) AS (VALUES {events}) {SQL['f12_display']}").fetchall()
    got = [tuple(r) for r in values.f12(Given(events=spark.createDataFrame([(k,) for k in ids], "event_id long"))).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and (None, None, None, None) in got
    assert any(float(r[2].split()[0]) > 1024 for r in got if r[2] and r[2].endswith(" MB")) and any(r[3] and r[3].endswith("M") and len(r[3]) > 7 for r in got)


def test_display_in_all_units(spark):
    row = spark.range(1).select(*[f(F.lit(n)).alias(f"{k}{i}") for i, n in enumerate((2_000_000, 3 * 2**30)) for k, f in (("s", text.format_size), ("c", text.format_count))]).first()
    assert tuple(row) == ("1.9 MB", "2.0M", "3.0 GB", "3.2B")


def test_contents_in_several_languages(spark):
    import duckdb

    rows = [(1, "a", "en"), (2, "a", "en"), (3, "a", "de"), (4, "b", "fr"), (5, "b", "de"), (6, "b", "de"), (7, "c", None), (8, None, "en"), (9, None, "de"), (10, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    given = duckdb.connect()
    given.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    given.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    expected = given.execute(SQL["u01_insert_or_ignore"]).fetchall()
    got = [tuple(r) for r in knowledge.u01(Given(documents=docs)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and len(got) == 6
