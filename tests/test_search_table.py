from quarry.sources import search_table as S


def _rows(spark, data, dims=3):
    df = spark.createDataFrame(data, "id string, content string, content_vector array<float>, version int")
    return S.conform(df, dims)


def test_upsert_counts_and_replace(spark):
    base = _rows(spark, [("1", "old", [0.1, 0.2, 0.3], 1), ("2", "keep", None, 1)])
    upd = _rows(spark, [("1", "new", [1.0, 0.0, 0.0], 2), ("3", "add", [0.0, 1.0, 0.0], 1),
                        ("4", "bad", [1.0, 0.0], 1), (None, "noid", None, 1)])
    new, counts = S.upsert(base, upd)
    c = counts.collect()[0]
    assert (c.succeeded, c.failed) == (2, 2)
    got = {r.id: r.content for r in new.collect()}
    assert got == {"1": "new", "2": "keep", "3": "add"}


def test_upsert_duplicate_ids_highest_version_wins(spark):
    base = _rows(spark, [])
    upd = _rows(spark, [("1", "v1", None, 1), ("1", "v3", None, 3), ("1", "v2", None, 2)])
    new, counts = S.upsert(base, upd)
    assert [r.content for r in new.collect()] == ["v3"] and counts.collect()[0].succeeded == 1


def test_upsert_all_succeed_3072(spark):
    data = [(str(i), "c", [0.0] * 3072, 1) for i in range(3)]
    df = spark.createDataFrame(data, "id string, content string, content_vector array<float>, version int")
    new, counts = S.upsert(S.conform(spark.createDataFrame([], df.schema)), S.conform(df))
    assert counts.collect()[0].succeeded == 3


def test_delete_and_stats(spark):
    t = _rows(spark, [("1", "ab", [0.1, 0.2, 0.3], 1), ("2", "c", None, 1)])
    ids = spark.createDataFrame([("1",), ("9",)], "id string")
    rem, deleted = S.delete(t, ids)
    assert deleted.collect()[0].deleted == 1 and [r.id for r in rem.collect()] == ["2"]
    st = S.stats(t).collect()[0]
    assert st.document_count == 2 and st.storage_size_bytes == (1 + 2 + 12) + (1 + 1)


def test_schema_roles():
    sch = S.index_schema(64)
    assert sch["id"].metadata["key"] and sch["content_vector"].metadata["dimensions"] == 64
    assert sch["source"].metadata["facetable"]


def test_older_version_that_arrives_later_changes_nothing(spark):
    base = _rows(spark, [("1", "v5", None, 5), ("2", "v1", None, 1), ("3", "v2", None, 2)])
    upd = _rows(spark, [("1", "v3", None, 3), ("2", "v2", None, 2), ("3", "unversioned", None, None)])
    new, counts = S.upsert(base, upd)
    assert {r.id: r.content for r in new.collect()} == {"1": "v5", "2": "v2", "3": "unversioned"}
    assert counts.first().succeeded == 3
