"""The stream gives the batch's tracks, whatever the order of rows within the delay."""

from shotloom.operators import tracking
from shotloom.streaming import tracks as S

#: A watermark begins at the epoch; rows at it would be late from the outset.
START = 1_700_000_000
OBS = "shot_id long, frame_idx int, obs_ord long, x1 int, y1 int, x2 int, y2 int"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f, f * 10 + lane, 200 * lane + (f * s) % 40, 0, 200 * lane + (f * s) % 40 + 60, 60) for s in range(1, 6) for f in range(20) for lane in range(2) if (f * 7 + s + lane) % 5]
    want = {tuple(r) for r in tracking.tracks(tracking.link_tracks(spark.createDataFrame(rows, OBS))).collect()}
    rows += [(99, 1000, 0, 0, 0, 1, 1)]  # moves the watermark beyond all
    rows.sort(key=lambda r: (r[1] // 4, -r[1], r[0]))
    for i in range(0, len(rows), 25):
        part = spark.createDataFrame(rows[i : i + 25], OBS).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.stream_tracks(S.with_event_time(stream, start=START), delay="8 seconds", start=START)
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert want == {r for r in got if r[0] != 99}
