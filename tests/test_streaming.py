"""Streaming front end: several micro-batches equal one batch load; a
replayed batch key is skipped."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plantpulse.operators.clean import convert
from plantpulse.plans.config import checkpoint_root
from plantpulse.sources.files import land_raw
from plantpulse.sources.fixture import dirty_raw, sensor_readings
from plantpulse.sources.warehouse import Warehouse
from plantpulse.streaming import start_incremental_load


def test_stream_in_many_batches_equals_batch_load(spark):
    base = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"
    raw = dirty_raw(sensor_readings(spark, SF_SMALL))
    # land in three files arriving as separate micro-batches
    for k in range(3):
        land_raw(raw.where(F.col("reading_id") % 3 == k).coalesce(1), f"{base}/staging")
    wh = Warehouse(spark, f"{base}/stream")
    q = start_incremental_load(spark, f"{base}/staging", wh, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    wh.refresh()
    assert len(wh.committed_ids()) == len(wh.log().collect()) == 3
    streamed = wh.star()
    batch = Warehouse(spark, f"{base}/batch")
    batch.load(convert(raw))
    one = batch.star()
    for a, b in zip(streamed, one):
        assert a.count() == b.count()
    nat = lambda s: sorted(s.production.join(s.machine_dim, "machine_key")
                           .select("machine_id", "time_key", "temperature_c").collect())
    assert nat(streamed) == nat(one)
    # replaying an epoch that already committed is a no-op
    assert wh.load(convert(raw), batch_key=f"stream:{q.id}:0") is None
    assert wh.rejects().count() == batch.rejects().count()


def test_uncommitted_load_is_invisible_and_loaded_again(spark, monkeypatch):
    base = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"
    conv = convert(dirty_raw(sensor_readings(spark, SF_SMALL)))
    wh = Warehouse(spark, base)
    wh.load(conv.where(F.col("reading_id") % 3 == 0))
    before = [t.count() for t in wh.star()]
    with monkeypatch.context() as m:
        m.setattr(Warehouse, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            wh.load(conv)
    again = Warehouse(spark, base)
    assert [t.count() for t in again.star()] == before
    again.load(conv)
    whole = Warehouse(spark, f"{base}-whole")
    whole.load(conv)
    assert [t.count() for t in again.star()] == [t.count() for t in whole.star()]


def test_run_etl_from_csv_twice_adds_nothing(spark):
    from plantpulse.etl import run_etl
    from plantpulse.sources.files import write_source_csv

    base = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"
    write_source_csv(sensor_readings(spark, SF_SMALL), f"{base}/csv")
    first = run_etl(spark, f"{base}/csv", f"{base}/wh", staging=f"{base}/staging",
                    date_grain="month", batch_key="csv-1")
    again = run_etl(spark, f"{base}/csv", f"{base}/wh", date_grain="month", batch_key="csv-1")
    assert first is not None and again is None
    wh = Warehouse(spark, f"{base}/wh", date_grain="month")
    assert wh.star().production.count() == 1000 and wh.rejects().count() == 0
    run_etl(spark, f"{base}/csv", f"{base}/wh", date_grain="month")
    wh.refresh()
    assert len(wh.committed_ids()) == 2 and wh.star().production.count() == 1000


def test_two_streams_into_one_warehouse_lose_nothing(spark):
    base = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"
    raw = dirty_raw(sensor_readings(spark, SF_SMALL)).where("reading_id % 89 <> 0")
    wh = Warehouse(spark, f"{base}/wh", date_grain="month")
    for k in range(2):
        land_raw(raw.where(F.col("reading_id") % 2 == k).coalesce(1), f"{base}/staging-{k}")
        start_incremental_load(spark, f"{base}/staging-{k}", wh, checkpoint=f"{base}/ckpt-{k}", available_now=True).awaitTermination()
    wh.refresh()
    good = convert(raw).where("production_reason is null").count()
    assert wh.star().production.count() == good
