import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("start, stop", [(0, 400), (0, 150), (150, 400), (399, 400), (200, 200)])
def test_words_of_slices(start, stop):
    """Words of a part of a batch are those of its texts, wherever the part begins."""
    rng = np.random.default_rng(0)
    parts = ["Ab", "É", " ", "\t", "\n\x0b", "x\x85y", " ", "Zz,", "日本"]
    texts = [None if i % 17 == 0 else "".join(rng.choice(parts, rng.integers(0, 30))) for i in range(400)]
    some = pa.array(texts, pa.string()).slice(start, stop - start)
    offsets, flat = common.split_words(some)
    for i, text in enumerate(texts[start:stop]):
        got = flat.slice(offsets[i], offsets[i + 1] - offsets[i]).to_pylist()
        assert [w.encode() for w in got] == (text or "").translate(LOWER).encode().split()


def test_slices_cover_all_rows():
    sizes = np.array([5, 1, 1, 9, 0, 0, 3])
    assert list(common.slices(sizes, 6)) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(common.slices(np.array([], int), 6)) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(100, i) for i in range(101, 400)] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = spark.createDataFrame([(i,) for i in {x for p in links for x in p} | {77}], "id long")
    got = {r.id: r.component for r in common.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[9] == got[3] == got[2] == got[1] == 1 and got[21] == 20 and got[77] == 77 and got[5] == 5
    assert got[399] == 100 and got[1060] == 1000
    none = common.components(nodes, spark.createDataFrame([], "a long, b long"))
    assert none.where("id <> component").count() == 0


def test_all_members_of_a_key_meet(spark):
    rows = spark.range(130).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id") % 3 + 2).alias("k"), "id")
    dealt = common.deal_blocks(rows, ["k"], "id", 16).collect()
    met = set()
    tiles = {}
    for r in dealt:
        tiles.setdefault((r.k, r.low, r.high), []).append(r)
    for (_, low, high), members in tiles.items():
        assert all(m.own in (low, high) for m in members)
        met |= {(a.id, b.id) for a in members for b in members if a.id < b.id and (a.own != b.own or low == high)}
    want = {r.k: [] for r in dealt}
    for r in {(x.k, x.id) for x in dealt}:
        want[r[0]].append(r[1])
    assert met == {(a, b) for ids in want.values() for a in ids for b in ids if a < b}
    assert max(map(len, tiles.values())) <= 60
