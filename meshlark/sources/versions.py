"""A table of written parts and a pointer to them: readers find the whole old state or the whole new one.

Every write goes to a folder of its own, and only then a pointer file names the parts that now count. Pointers are numbered
and never change; a pointer counts once its last line is there. What fails before that leaves the state as it was. One writer
at a time: a second one that wants the same number is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS, DONE = "_pointers", "\nwhole\n"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/{POINTERS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def whole(spark: SparkSession, path: str, number: int) -> dict | None:
    """What a pointer says, or null if its write was cut off."""
    fs, p = _fs(spark, f"{path}/{POINTERS}/{number:012d}")
    file = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()
    return json.loads(text.removesuffix(DONE)) if text.endswith(DONE) else None


def newest(spark: SparkSession, path: str) -> dict | None:
    """The newest whole pointer: {"parts": [{"name", "format"}, ...], ...}."""
    return next((state for n in reversed(numbers(spark, path)) if (state := whole(spark, path, n)) is not None), None)


def point(spark: SparkSession, path: str, state: dict) -> None:
    """Make `state` the newest one."""
    fs, p = _fs(spark, f"{path}/{POINTERS}/{max(numbers(spark, path), default=0) + 1:012d}")
    file = fs.create(p, False)
    try:
        file.write(bytearray((json.dumps(state) + DONE).encode()))
    finally:
        file.close()


def add_part(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """df written as a part that nothing names yet."""
    name = f"part-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).save(f"{path}/{name}")
    return {"name": name, "format": fmt}


def parts_of(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    return spark.read.format(parts[0]["format"]).load([f"{path}/{p['name']}" for p in parts])


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The parts that the newest pointer names, or null where nothing was published."""
    state = newest(spark, path)
    return parts_of(spark, path, state["parts"]) if state else None


def clear_old(spark: SparkSession, path: str) -> int:
    """Remove what the newest pointer does not need; for a time when no reader or writer is at work. Returns how much went."""
    n = next((n for n in reversed(numbers(spark, path)) if whole(spark, path, n) is not None), None)
    if n is None:
        return 0
    kept = {p["name"] for p in whole(spark, path, n)["parts"]} | {f"{n:012d}"}
    fs, folder = _fs(spark, path)
    files = [f.getPath() for at in (folder, _fs(spark, f"{path}/{POINTERS}")[1]) for f in fs.listStatus(at)]
    gone = [p for p in files if p.getName() not in kept and (p.getName().startswith("part-") or p.getParent().getName() == POINTERS)]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
