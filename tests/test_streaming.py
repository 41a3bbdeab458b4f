"""The bin map maintained by the file-source stream (A15) over several micro-batches."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from loanpanel.plans import driver_tables as T
from loanpanel.sources import delimited as D
from loanpanel.streaming.bin_stream import latest_map, start_bin_stream


def test_bin_stream_small_capacity(spark):
    cap = 40
    base = D.staging_dir(spark, "bin-stream-test")
    rows = T.table(spark, SF_SMALL, "orders").select(
        F.col("o_custkey").alias("loanSeqNumber"), F.col("o_orderkey").alias("obs"),
        F.year("o_orderdate").alias("yr"))
    rows.write.partitionBy("yr").parquet(f"{base}/incoming")
    src = (spark.readStream.schema("loanSeqNumber long, obs long, yr int")
           .option("maxFilesPerTrigger", 1).parquet(f"{base}/incoming"))
    q = start_bin_stream(spark, src, f"{base}/map", f"{base}/data", f"{base}/ckpt", capacity=cap)
    q.awaitTermination()
    m = latest_map(spark, f"{base}/map")
    loans = rows.select("loanSeqNumber").distinct().count()
    assert m.count() == m.select("loanSeqNumber").distinct().count() == loans
    occ = {r.binNumber: r.binOccupancy for r in m.select("binNumber", "binOccupancy").distinct().collect()}
    assert sorted(occ) == list(range(len(occ)))                   # bins numbered 0..k-1
    assert all(v <= cap for v in occ.values())
    assert sum(1 for v in occ.values() if v < cap) <= 1           # at most one open bin
    assert sum(occ.values()) == loans
    data = spark.read.parquet(f"{base}/data")
    assert data.count() == rows.count()                           # every row routed to its loan's bin
    assert data.join(m, ["loanSeqNumber", "binNumber"], "left_anti").count() == 0


def _bins(df):
    return {r["loanSeqNumber"]: r["binNumber"] for r in df.collect()}


def test_segments_merge_and_a_replayed_batch_changes_nothing(spark, monkeypatch):
    from loanpanel.streaming import bin_stream as S
    monkeypatch.setattr(S, "FAN_IN", 3)
    base = D.staging_dir(spark, "bin-segments")
    batches = [[i, i + 1, i + 7 * b] for b, i in enumerate(range(0, 70, 7))]
    wanted, order = {}, []
    for b, loans in enumerate(batches):
        frame = spark.createDataFrame([(x, b) for x in [*loans, None]], "loanSeqNumber long, obs int")
        S.add_batch(spark, frame, b, f"{base}/map", f"{base}/data", capacity=4)
        order += sorted(set(loans) - set(order))
        wanted = {x: k // 4 for k, x in enumerate(order)}
        assert _bins(latest_map(spark, f"{base}/map")) == wanted
    levels = {s[0] for s in S._segments(spark, f"{base}/map")}
    assert levels == {0, 1, 2}                            # ten batches, three to a merge
    assert len(S.live_segments(S._segments(spark, f"{base}/map"))) < 5
    last = spark.createDataFrame([(x, 9) for x in batches[9]], "loanSeqNumber long, obs int")
    S.add_batch(spark, last, 9, f"{base}/map", f"{base}/data", capacity=4)          # run again after a failure
    assert _bins(latest_map(spark, f"{base}/map")) == wanted
    rows = spark.read.parquet(f"{base}/data")
    assert rows.count() == sum(map(len, batches)) and {r["loanSeqNumber"]: r["binNumber"] for r in rows.collect()} == wanted
    import pytest
    with pytest.raises(ValueError):
        S.add_batch(spark, last, 10, f"{base}/map", f"{base}/data", capacity=5)


def test_a_batch_writes_its_new_loans_only(spark):
    from loanpanel.streaming import bin_stream as S
    base = D.staging_dir(spark, "bin-bytes")
    S.add_batch(spark, spark.range(5_000).toDF("loanSeqNumber"), 0, f"{base}/map", f"{base}/data", capacity=100)
    S.add_batch(spark, spark.range(4_990, 5_010).toDF("loanSeqNumber"), 1, f"{base}/map", f"{base}/data", capacity=100)
    assert spark.read.parquet(S._path(f"{base}/map", (0, 1, 1))).count() == 10
    assert latest_map(spark, f"{base}/map").count() == 5_010


def test_live_segments():
    from loanpanel.streaming.bin_stream import live_segments
    all_ = [(0, i, i) for i in range(5)] + [(1, 0, 2)]
    assert live_segments(all_) == [(1, 0, 2), (0, 3, 3), (0, 4, 4)]
    assert live_segments(all_, before=2) == [(0, 0, 0), (0, 1, 1)]


def test_files_follow_the_loans_not_bins_times_tasks(spark):
    """10,000 loans in bins of 100: one folder of 100 bins, sorted by bin, not a folder and files a bin."""
    import glob

    from loanpanel.sources import bins as B
    from loanpanel.streaming import bin_stream as S
    base = D.staging_dir(spark, "bin-files")
    frame = spark.range(20_000).toDF("loanSeqNumber").repartition(8)
    S.add_batch(spark, frame, 0, f"{base}/map", f"{base}/data", capacity=100)
    where = f"{base}/data".removeprefix("file:")
    folders, files = glob.glob(f"{where}/batchId=0/*=*"), glob.glob(f"{where}/batchId=0/*/*.parquet")
    assert len(folders) == 2 and len(files) <= 16
    rows = spark.read.parquet(f"{base}/data")
    assert rows.count() == 20_000 and rows.where((F.col("firstBin") == 100) & (F.col("binNumber") == 150)).count() == 100
    assert rows.where(F.col("binNumber") != F.floor(F.col("loanSeqNumber") / 100)).count() == 0
    # bins of the usual size have a folder each
    assert B.bin_folder(10_000)[0] == "binNumber"


def test_the_stream_plans_batches_in_the_callers_session(spark, monkeypatch):
    """A stream's own session plans without AQE; the batches are handed on in the caller's."""
    from loanpanel.streaming import bin_stream as S
    base, seen, add = D.staging_dir(spark, "bin-session"), [], S.add_batch

    def spy(spark, batch, *rest):
        seen.append((batch.sparkSession.conf.get("spark.sql.adaptive.enabled"), batch.count()))
        add(spark, batch, *rest)

    monkeypatch.setattr(S, "add_batch", spy)
    spark.range(30).toDF("loanSeqNumber").write.parquet(f"{base}/incoming")
    src = spark.readStream.schema("loanSeqNumber long").parquet(f"{base}/incoming")
    S.start_bin_stream(spark, src, f"{base}/map", f"{base}/data", f"{base}/ckpt", capacity=4).awaitTermination()
    assert seen == [("true", 30)] and S.latest_map(spark, f"{base}/map").count() == 30
