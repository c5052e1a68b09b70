import shutil
import tempfile

from bitext.streaming.clean_stream import cleaned_stream

from conftest import SF_SMALL


def test_stream_matches_batch_count(spark):
    src = tempfile.mkdtemp(prefix="bitext-stream-", dir="/tmp")
    shutil.copy(f"{SF_SMALL}/documents.parquet", f"{src}/part-0.parquet")
    q = cleaned_stream(spark, src).writeStream.format("memory").queryName("cleaned_lines").start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT count(*) AS n FROM cleaned_lines").first().n
    from bitext.plans import QUERIES

    batch = QUERIES["ratio_filter"](spark, SF_SMALL).count()
    assert streamed == batch > 0
