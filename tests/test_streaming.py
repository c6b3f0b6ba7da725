from spandrel.plans.report import FIELDS
from spandrel.streaming.results import running_means, stream_results


def test_results_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, (time, iters) in enumerate([(1.0, 3), (2.0, 4)]):
        (tmp_path / "in" / f"{k}.csv").write_text(",".join(FIELDS) + f"\np,CG,double,0,0,0,0,B,1.0,{time},{iters},-nan,inf\n")
    q = running_means(stream_results(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("means").collect()] == [("p", "CG", "double", 1.5, 3, 2)]
