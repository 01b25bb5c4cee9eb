"""Pages from a local server, as a table and as a stream; and progress that is told while a stream runs."""

import http.server
import json
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofline.sources import pagesource
from proofline.streaming.progress import progress_of
from proofline.streaming.resume import latest, resume


@pytest.fixture
def server():
    """Serves every page but 012-003; 012-005 comes at the third try."""
    tried = Counter()

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            tried[self.path] += 1
            page = self.path.rpartition("/")[2].removesuffix(".jpg")
            if page == "012-003" or page == "012-005" and tried[self.path] < 3:
                self.send_error(404)
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(page.encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", tried
    s.shutdown()


def write(path, *runs):
    with path.open("a") as f:
        f.writelines(json.dumps(dict(zip(("run", "folder", "first", "last"), r))) + "\n" for r in runs)


def test_pages_as_a_table(spark, tmp_path, server):
    base, tried = server
    write(tmp_path / "population", ("R-1", "012", 1, 7), ("R-2", "013", 5, 4), ("R-3", "013", 998, 1001))
    pagesource.register(spark)
    df = spark.read.format("pages").options(population=f"file://{tmp_path}/population", base_url=base, pages=3, tries=3, pause_s=0).load()
    assert df.rdd.getNumPartitions() == 5
    rows = {r["page"]: r for r in df.collect()}
    assert set(rows) == {f"012-{n:03d}" for n in range(1, 8)} | {"013-998", "013-999", "013-1000", "013-1001"}
    assert rows["012-003"]["content"] is None and "404" in rows["012-003"]["detail"] and tried["/folder.012/012-003.jpg"] == 3
    assert all(bytes(r["content"]).decode() == p and r["detail"] is None for p, r in rows.items() if p != "012-003") and rows["013-1000"]["run"] == "R-3"


def test_pages_as_a_stream(spark, tmp_path, server):
    base, tried = server
    population = tmp_path / "population"
    write(population, ("R-1", "012", 1, 4))
    pagesource.register(spark)

    def run():
        stream = spark.readStream.format("pages").options(population=str(population), base_url=base, pages=2, tries=1, pause_s=0).load()
        stream.select("page", "detail").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
        return {r["page"]: r["detail"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    assert set(run()) == {f"012-{n:03d}" for n in range(1, 5)}
    write(population, ("R-2", "013", 7, 8))
    got = run()
    assert set(got) == {f"012-{n:03d}" for n in range(1, 5)} | {"013-007", "013-008"} and "404" in got["012-003"]
    assert max(tried.values()) == 1  # what was taken isn't fetched again


def test_what_the_options_lack(spark):
    with pytest.raises(ValueError, match="base_url"):
        pagesource.Population({"population": "x"})


def test_progress_is_told_while_a_stream_runs(spark, tmp_path):
    source, out, told = tmp_path / "in", f"file://{tmp_path}/rows", f"file://{tmp_path}/progress"
    for k in range(6):
        spark.range(10 * k, 10 * k + 10).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("page"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(f"file://{source}")
    told_by_then = []

    def work(batch):
        time.sleep(1.5)
        return batch

    query = resume(spark, f"file://{source}", "folder string, page string, v long", work, out, f"file://{tmp_path}/checkpoint", progress=told, total=60, files_at_once=1)
    deadline = time.time() + 120
    while query.isActive and time.time() < deadline:
        if (tmp_path / "progress").exists():
            told_by_then.append(progress_of(spark, told).count())
        time.sleep(0.3)
    query.awaitTermination()
    while time.time() < deadline and progress_of(spark, told).count() < 6:
        time.sleep(0.3)
    rows = progress_of(spark, told).orderBy("batch").collect()
    assert latest(spark, out).count() == 60 and 0 < max(told_by_then) <= 6
    assert [r["done"] for r in rows] == [10, 20, 30, 40, 50, 60] and [r["rows"] for r in rows] == [10] * 6
    assert rows[-1]["remaining_s"] == 0 and rows[0]["remaining_s"] > 0 and all(r["per_hour"] > 0 and r["total"] == 60 for r in rows)
