import __spark_entry__

from ..conftest import rows


def test_sources_that_run_short_leave_their_share_to_siblings(spark, tmp_path):
    docs = [(i, "one two three", source, "en", "ir" if source == "code-forge" else "python3") for i, source in enumerate(["lab-share"] * 2 + ["paper-extras"] * 10 + ["code-forge"] * 20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, kernel string").write.parquet(f"{tmp_path}/documents.parquet")
    goal = [("lab-share", 0.4, 2), ("paper-extras", 0.1, 3), ("code-forge", 0.5, 1)]
    spark.createDataFrame(goal, "source string, target_share double, max_repeat int").write.parquet(f"{tmp_path}/mix_target.parquet")
    queries = __spark_entry__.queries()
    uses = {s: n for s, n in rows(queries["p7_mixture_available"](spark, str(tmp_path)).groupBy("source").count())}
    # of 32 documents' tokens lab-share should have 12.8, holds 4, and its sibling of the same kernel and language takes the other 8.8
    assert uses == {"lab-share": 4, "paper-extras": 12, "code-forge": 16}
    report = {r.source: r for r in queries["p7_shares_available"](spark, str(tmp_path)).collect()}
    assert report["lab-share"].most_uses == 2 and report["lab-share"].reached_share == 0.125 < report["lab-share"].target_share
    assert sum(r.reached_share for r in report.values()) == 1
