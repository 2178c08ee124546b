"""Packs for annotation: whole ones, replaced ones, and nothing of a job that fails."""

import json
import os

import numpy as np
import pytest

from matchgrid.operators import media
from matchgrid.sources import packs

HITS = "video string, key string, t double, side string, height string, stroke string"
CROPS = "video string, key string, w int, h int, pixels binary"


def items_of(spark, rows):
    return media.annotation_items(spark.createDataFrame(rows, HITS))


def files(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if not n.endswith(".crc"))


def test_packs(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", "1:2:3", 1.5, "near", "low", "lob"), ("a", "1:9:0", 9.0, "far", "high", "revers"), ("b<c>", "4:4:1", 2.0, "far", "head", "smash")]
    picture = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    crops = spark.createDataFrame([("a", "1:2:3", 7, 5, bytearray(picture.tobytes()))], CROPS)
    packs.save_packs(items_of(spark, rows), crops, path, ["lob", "smash"])
    assert files(path) == ["a/annotate.html", "a/img/1_2_3.bmp", "a/items.json", "b<c>/annotate.html", "b<c>/items.json"]
    pack = json.loads((tmp_path / "out/a/items.json").read_text())
    assert pack["labels"] == ["lob", "smash"] and [(i["key"], i["img"], i["guess"]) for i in pack["items"]] == [("1:2:3", "img/1_2_3.bmp", "lob"), ("1:9:0", "img/1_9_0.jpg", "revers")]
    page = (tmp_path / "out/b<c>/annotate.html").read_text()
    inner = page.split('id="pack">')[1].split("</script>")[0]
    assert json.loads(inner)["items"][0]["key"] == "4:4:1" and "b&lt;c>" in page and "<c>" not in inner
    raw = (tmp_path / "out/a/img/1_2_3.bmp").read_bytes()
    assert raw[:2] == b"BM" and len(raw) == int.from_bytes(raw[2:6], "little") == 54 + 5 * 24
    rows_ = np.frombuffer(raw[54:], np.uint8).reshape(5, 24)[::-1, :21].reshape(5, 7, 3)[..., ::-1]
    assert (rows_ == picture).all()
    # A second pack of one video takes the first one's place; the other video stays.
    packs.save_packs(items_of(spark, rows[1:2]), crops, path, ["lob"])
    assert files(path) == ["a/annotate.html", "a/items.json", "b<c>/annotate.html", "b<c>/items.json"]
    packs.save_packs(items_of(spark, rows).where("false"), crops, path, ["lob"])
    assert len(files(path)) == 4


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(v, f"{k}:0:0", 1.0, "near", "low", "lob") for v in ("a", "b", "c") for k in range(4)] + [("bad/name", "7:7:7", 1.0, "near", "low", "lob")]
    crops = spark.createDataFrame([], CROPS)
    with pytest.raises(Exception, match="not the name of a folder"):
        packs.save_packs(items_of(spark, rows), crops, path, ["lob"])
    assert files(path) == []
