"""What the strict guard lets run, and what it refuses."""

from __future__ import annotations

import pytest

from riskloom.plans import copilot

T = "analytics_marts.mart_customer_exposure"


@pytest.fixture(scope="module")
def marts(spark):
    mart = spark.createDataFrame([("a", 2, "2024-01-05"), ("a", 3, "2024-02-05"), ("b", 9, None)],
                                 "segment string, total int, day string")
    spark.createDataFrame([("hidden",)], "x string").createOrReplaceTempView("secret")
    yield {"mart_customer_exposure": mart, "mart_account_health": mart}
    spark.catalog.dropTempView("secret")


def run(spark, marts, sql: str) -> list[tuple]:
    return sorted((tuple(r) for r in copilot.run_guarded(spark, sql, marts=marts).collect()), key=str)


ALLOWED = {
    f"select segment, sum(total) as t from {T} group by segment having sum(total) > 4": [("a", 5), ("b", 9)],
    f"with m as (select segment from {T}) select distinct segment from m": [("a",), ("b",)],
    f"with secret as (select segment as x from {T}) select x from secret where x = 'b'": [("b",)],
    f"select mart_customer_exposure.total from {T} where mart_customer_exposure.segment = 'b'": [(9,)],
    f"select m.total from {T} as m join analytics_marts.mart_account_health h on m.total = h.total "
    "where m.total in (select max(total) from analytics_marts.mart_account_health)": [(9,)],
    f"select total from {T} union all select 1 limit 10": [(1,), (2,), (3,), (9,)],
    f"select row_number() over (partition by segment order by total desc) as n, total from {T} "
    "where date_trunc('month', cast(day as timestamp)) = timestamp '2024-02-01'": [(1, 3)],
    f"select case when total > 2 then upper(trim(segment)) else 'low' end as s from {T} m where exists "
    f"(select 1 from {T} n where n.total = m.total + 1)": [("low",)],
    f"select * from (with inner_one as (select total from {T}) select total from inner_one) x where total = 2": [(2,)],
    f"select mart_customer_exposure.total from {T} tablesample (100 percent) as mart_customer_exposure "
    "where total = 2": [(2,)],
    f"select TOTAL from {T.upper()} where total = 3": [(3,)],
}

REFUSED = {
    "a common table's name outside its scope":
        f"select b.x from (with secret as (select segment as x from {T}) select x from secret) a, secret b",
    "a common table's name before it is defined":
        f"with a as (select x from secret), secret as (select segment as x from {T}) select x from a",
    "a temporary view": f"select x from {T}, secret",
    "a temporary view in a subquery": f"select total, (select max(x) from secret) as x from {T}",
    "a static method": f"select reflect('java.lang.System', 'getProperty', 'user.dir') as x from {T}",
    "a static method by its other name": f"select java_method('java.lang.System', 'getProperty', 'user.dir') as x from {T}",
    "a static method that may fail": f"select try_reflect('java.lang.System', 'getProperty', 'user.dir') as x from {T}",
    "a method in a condition": f"select total from {T} where reflect('java.lang.System', 'nanoTime') is null",
    "a method in an order": f"select total from {T} order by reflect('java.lang.System', 'nanoTime')",
    "a method in a common table": f"with m as (select reflect('java.lang.System', 'nanoTime') as x from {T}) select x from m",
    "a method in a window": f"select sum(total) over (order by reflect('java.lang.System', 'nanoTime')) as x from {T}",
    "a method in a lambda": f"select transform(array(1), k -> reflect('java.lang.System', 'nanoTime')) as x from {T}",
    "a function by a computed name": f"select identifier('ref' || 'lect')('java.lang.System', 'nanoTime') as x from {T}",
    "a qualified function": f"select system.builtin.reflect('java.lang.System', 'nanoTime') as x from {T}",
    "a table by a computed name": f"select 1 from {T}, identifier('sec' || 'ret')",
    "a script": f"select transform(segment) using 'cat' as (x) from {T}",
    "a generator": f"select x from {T} lateral view explode(array(1, 2)) e as x",
    "a table function": f"select id from {T}, range(3)",
    "a file": f"select * from {T}, parquet.`/etc/passwd`",
    "an option of a table": f"select * from {T} with (path = '/etc')",
    "another schema": f"select * from {T} a join raw.customers b on true",
    "a global view": f"select * from {T}, global_temp.v",
    "a schema of a catalog": f"select * from spark_catalog.analytics_marts.mart_customer_exposure, {T}",
    "the session": f"select current_user(), total from {T}",
    "a file's name": f"select input_file_name() as x from {T}",
    "waiting": f"select sleep(10) as x from {T}",
}


@pytest.mark.parametrize("sql", list(ALLOWED))
def test_a_statement_over_the_marts_runs(spark, marts, sql):
    assert run(spark, marts, sql) == ALLOWED[sql]


@pytest.mark.parametrize("what", list(REFUSED))
def test_a_statement_is_refused(spark, marts, what):
    with pytest.raises(ValueError, match="not allowed: |not allowlisted: "):
        copilot.run_guarded(spark, REFUSED[what], marts=marts)


def test_a_registered_python_function_is_refused(spark, marts):
    spark.udf.register("iff", lambda text: "mine")  # an allowed name that is not built in
    try:
        with pytest.raises(ValueError, match="Function is not allowed"):
            copilot.run_guarded(spark, f"select iff(segment) as x from {T}", marts=marts)
    finally:
        spark.sql("drop temporary function iff")


def test_catalog_tables_are_read_by_schema(spark):
    spark.sql("create database if not exists analytics_marts")
    spark.sql("create table analytics_marts.guard_test using parquet as select 1 as a")
    spark.sql("create view analytics_marts.guard_view as select a + 1 as a from analytics_marts.guard_test")
    try:
        sql = "select t.a, v.a as b from analytics_marts.guard_test t join analytics_marts.guard_view v on v.a > t.a"
        assert run(spark, None, sql) == [(1, 2)]
        with pytest.raises(ValueError, match="not allowlisted"):
            copilot.run_guarded(spark, "select * from analytics_marts.guard_test, guard_test")
        assert copilot.run_guarded(spark, "select * from analytics_marts.guard_test", ("Analytics_Marts",)).count() == 1
    finally:
        spark.sql("drop view analytics_marts.guard_view")
        spark.sql("drop table analytics_marts.guard_test")
