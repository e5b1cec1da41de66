"""Memory of the driver between written steps."""

import gc

from py4j.protocol import Py4JError

from tallyframe import storage


def used(spark) -> int:
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return runtime.totalMemory() - runtime.freeMemory()


def test_a_written_step_gives_back_garbage_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(storage, "HEAP_SHARE", 0)
    held = spark._jvm.java.nio.ByteBuffer.allocate(200_000_000)
    assert used(spark) > 200_000_000
    del held
    gc.collect()
    assert storage.stage(spark.range(10), "ten").count() == 10
    storage.release(spark)  # py4j may let go of the buffer after the write
    assert used(spark) < 200_000_000


def test_native_memory_is_trimmed_only_after_a_collection(spark, monkeypatch):
    storage._trim(spark)
    asked = []

    def cannot(spark):
        asked.append(1)
        raise Py4JError("no such command")

    monkeypatch.setattr(storage, "_trim", cannot)
    monkeypatch.setattr(storage, "HEAP_SHARE", 1)
    assert not storage.release(spark) and not asked
    monkeypatch.setattr(storage, "HEAP_SHARE", 0)
    assert storage.release(spark) and asked
