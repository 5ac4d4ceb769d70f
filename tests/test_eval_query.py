"""The evaluation query goes through the texts once."""

from checks import spark_queries


def _tables(spark, root):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")

    words = ["ai of the day", "senior hast", "que tion", "nothing here"]
    put("documents", [(i, f"{words[i % 4]} {i}\nbody {words[(i + 1) % 4]}", "en", f"src{i % 3}", i) for i in range(40)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    put("supplier", [(i, f"s{i}", i % 2, 0.0) for i in range(3)],
        "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    put("nation", [(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("pages", [(i, f"https://x.org/{i}?a=1", "") for i in range(5)], "page_id bigint, url string, html string")
    put("customer", [(i, f"c{i}", i % 5, 0.0, "BUILDING") for i in range(20)],
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("labels", [(i, 1, 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int")


def test_wanted_postings_come_from_the_features(spark, tmp_path):
    _tables(spark, tmp_path)
    found = spark_queries.q_eval_rel3(spark, str(tmp_path))
    read = {f.split("/")[-2] for f in found.inputFiles()}
    assert "documents.parquet" not in read and "labels.parquet" not in read
    row = found.first()
    # 20 customers, those with key % 9 = 4 do not consent
    assert row["profile_count"] == 18
    assert 0.0 <= row["ranking_relevance"] <= 1.0
