import os

from lexiloom import session


def test_tables_are_written_to_the_shared_folder_and_forgotten(spark):
    df = session.materialise(spark.range(5).selectExpr("id", "array(id) AS a"), "five")
    assert df.count() == 5 and dict(df.dtypes) == {"id": "bigint", "a": "array<bigint>"}
    own = session.own_dir(spark)
    assert own.startswith(session.shared_dir(spark)) and os.path.isdir(own.removeprefix("file://"))
    session.forget(spark)
    assert not os.path.exists(own.removeprefix("file://"))


def test_temporary_tables_go_with_their_block(spark):
    with session.temporary(spark):
        df = session.materialise(spark.range(3), "three")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_queries_and_equivalents_have_the_same_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80
