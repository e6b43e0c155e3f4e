from spindle.llm import tokens
from spindle.session import scratch_path
from tests.llm.test_tokens import whole


def test_ids_behind_null_ids_in_one_block(spark, documents):
    path = scratch_path(spark, "test-fetch")
    docs = documents([(None, "no id"), (None, "none again"), (7, "one two"), (9, "three")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokens.write_ids(docs, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tokens.fetch(spark, path, [7, 9]) == {7: [*whole("one two"), 2], 9: [*whole("three"), 2]}
