import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
from logquarry.sources import scratch


def test_tables_of_chunks_are_written_and_handed_on_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """What is read or given to Python at once is bounded by bytes, however many chunks a task has."""
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    before = spark.conf.get(scratch.BATCH)

    def chunks(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([os.urandom(65536)])], ["k", "data"])

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    data = scratch.table(spark.range(0, 700, 1, 1).mapInArrow(chunks, "k long, data binary"), "chunks")
    files = glob.glob(f"{tmp_path}/chunks-*/*.parquet")
    groups = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 2 and max(groups) < 3 * scratch.GROUP
    counts = [r.n for r in scratch.table(data.coalesce(1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(counts) == 700 and max(counts) <= 2 * scratch.GROUP // 65536
    assert spark.conf.get(scratch.BATCH) == before
