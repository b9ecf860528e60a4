"""Digests of files against hashlib over their bytes."""

from __future__ import annotations

import hashlib
import os

import pytest
from paths import SMALL_DIR
from pyspark.sql import functions as F

from clickward.operators.clean import cast_events
from clickward.plans.trust import stored_baseline
from clickward.session import scratch_path
from clickward.sources import events
from clickward.sources.adapters import clicks_dirty
from clickward.sources.digests import file_digests


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tree(data: bytes, block: int, fan: int) -> str:
    nodes = [sha(data[i : i + block]) for i in range(0, len(data), block)]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fan]).encode()) for i in range(0, len(nodes), fan)]
    return nodes[0]


@pytest.fixture()
def folder(tmp_path):
    data = {"empty.bin": b"", "one.bin": b"x", "odd name é.bin": bytes(range(256)) * 3, "long.bin": os.urandom(20_011), "full.bin": b"ab" * 500}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path, data


@pytest.mark.parametrize(("block", "fan"), [(1 << 20, 1024), (1000, 3), (1000, 4), (77, 16)])
def test_digests_against_a_tree_in_memory(spark, folder, block, fan):
    path, data = folder
    got = {r["path"].rsplit("/", 1)[-1]: (r["bytes"], r["sha256"]) for r in file_digests(spark, str(path), block, fan).collect()}
    assert got == {name: (len(content), tree(content, block, fan)) for name, content in data.items() if content}


def test_one_flipped_bit_and_swapped_blocks_show(spark, tmp_path):
    data = os.urandom(5000)
    flipped = data[:3210] + bytes([data[3210] ^ 1]) + data[3211:]
    for name, content in (("a", data), ("b", flipped), ("c", data[1000:2000] + data[:1000] + data[2000:]), ("d", data)):
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-1]: r["sha256"] for r in file_digests(spark, str(tmp_path), 1000, 2).collect()}
    assert got["a"] == got["d"] and len(set(got.values())) == 3


def test_manifest_has_the_digest_of_the_bytes(spark):
    path = f"{SMALL_DIR}/events.parquet"
    with open(path, "rb") as f:
        data = f.read()
    row = events.file_manifest(spark, path).first()
    assert (row["file"], row["bytes"], row["source"], row["mode"]) == ("events.parquet", len(data), "user_provided", "full")
    assert row["sha256"] == sha(data)


def test_restored_file_finds_its_profile(spark, tmp_path):
    """Bytes alone decide: not the time, and not the values that other bytes may hold as well."""
    store, path = scratch_path(spark, "store"), tmp_path / "clicks.csv"
    typed = cast_events(clicks_dirty(spark, SMALL_DIR))

    def profile_of(content: str, app: int, time: int) -> set:
        path.write_text(content)
        os.utime(path, (time, time))
        found = stored_baseline(typed.withColumn("app", F.lit(app)), store, str(path))
        return {r["value"] for r in found.where("feature = 'app'").collect()}

    assert profile_of("ip,app\n1,1\n", 1, 1_700_000_000) == {"1"}
    assert profile_of("ip,app\n1,2\n", 2, 1_700_000_000) == {"2"}
    assert profile_of('ip,app\n1,"1"\n', 3, 1_700_000_000) == {"3"}
    assert profile_of("ip,app\n1,1\n", 4, 1_800_000_000) == {"1"}
