"""Upserts of a stream of node facts, over restarts."""

from loomgraph.streaming import upserts


def test_first_row_of_each_key_stays(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = "id string, seq bigint, type string"
    for rows in ([("//a", 5, "x"), ("//b", 1, "y"), (None, 1, "z")], [("\\\\a ", 2, "w"), ("//a", 9, "v"), ("//c", 3, "u")], [("//b", 1, "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upserts.upsert_stream(spark.readStream.schema(schema).parquet(src), out, check, buckets=3).awaitTermination()
    got = {tuple(r) for r in upserts.read_upserts(spark, out, spark.createDataFrame([], schema).schema).collect()}
    assert got == {("//a", 2, "w"), ("//b", 1, "y"), ("//c", 3, "u")}
