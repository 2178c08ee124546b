"""Packs for annotation as a sink: one folder a video with a page, its items and their pictures."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PAGE = """<!doctype html>
<meta charset="utf-8">
<title>Strokes of {title}</title>
<style>
 body {{ font: 15px sans-serif; margin: 1em auto; max-width: 70em }}
 figure {{ margin: 0 0 1em; padding: .6em; border: 1px solid #bbb }}
 label {{ margin-right: .8em }}
</style>
<h1>Strokes of {title}</h1>
<button id="save">Save the labels</button>
<main></main>
<script type="application/json" id="pack">{pack}</script>
<script>
const pack = JSON.parse(document.getElementById("pack").textContent), chosen = {{}};
for (const item of pack.items) {{
  const box = document.createElement("figure"), picture = new Image();
  picture.src = item.img;
  box.append(picture, document.createElement("br"), `${{item.t}} s, ${{item.side}}, ${{item.height}} `);
  for (const name of pack.labels) {{
    const choice = Object.assign(document.createElement("input"), {{ type: "radio", name: item.key, checked: name === item.guess }});
    choice.onchange = () => {{ chosen[item.key] = name; }};
    const label = document.createElement("label");
    label.append(choice, name);
    box.append(label);
  }}
  document.querySelector("main").append(box);
}}
document.getElementById("save").onclick = () => {{
  const text = JSON.stringify({{ video: pack.video, key: pack.key, labels: chosen }});
  const link = Object.assign(document.createElement("a"), {{ href: URL.createObjectURL(new Blob([text])), download: `${{pack.key}}.json` }});
  link.click();
}};
</script>
"""


def bitmap(pixels: bytes, width: int, height: int) -> bytes:
    """RGB pixels as a picture file without compression: rows from below, each filled up to four bytes, blue first."""
    pad = b"\0" * (-3 * width % 4)
    lines = []
    for y in range(height - 1, -1, -1):
        line = bytearray(pixels[3 * width * y : 3 * width * (y + 1)])
        line[0::3], line[2::3] = line[2::3], line[0::3]
        lines.append(bytes(line) + pad)
    body = b"".join(lines)
    size = lambda n: n.to_bytes(4, "little")
    head = b"BM" + size(54 + len(body)) + size(0) + size(54) + size(40) + size(width) + size(height) + b"\1\0\x18\0"
    return head + size(0) + size(len(body)) + size(2835) * 2 + size(0) * 2 + body


@dataclass
class Packed(WriterCommitMessage):
    """The videos that a task has made, and where."""

    folders: list[tuple[str, str]]


class AnnotationPacks(DataSource):
    """Sink of rows ``video, key, item, w, h, pixels``; options ``path`` and ``labels`` (a JSON list).

    The rows of a video have to be in one partition, side by side (``save_packs`` sees to it).
    """

    @classmethod
    def name(cls) -> str:
        return "annotation_packs"

    def schema(self) -> str:
        return "video string, key string, item string, w int, h int, pixels binary"

    def writer(self, schema: StructType, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], json.loads(self.options.get("labels", "[]")))


class PackWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; its commit moves whole videos to their place, its abort deletes it."""

    def __init__(self, path: str, labels: list[str]):
        self.path, self.labels = path.rstrip("/"), labels
        self.staging = f"{self.path}/_job-{uuid.uuid4().hex}"

    def put(self, store: fs.FileSystem, path: str, content: bytes) -> None:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(content)

    def write(self, iterator: Iterator[Row]) -> Packed:
        context = TaskContext.get()
        store, top = fs.FileSystem.from_uri(self.staging)
        # Another attempt of the same task has a folder of its own.
        own = f"{top}/{context.partitionId()}-{context.taskAttemptId()}" if context else f"{top}/0"
        folders: list[tuple[str, str]] = []
        video, items = None, []

        def close() -> None:
            if video is None:
                return
            folder = f"{own}/{video}"
            pack = json.dumps({"video": video, "key": video, "items": items, "labels": self.labels}, ensure_ascii=False)
            self.put(store, f"{folder}/items.json", pack.encode())
            page = PAGE.format(title=video.replace("&", "&amp;").replace("<", "&lt;"), pack=pack.replace("<", "\\u003c"))
            self.put(store, f"{folder}/annotate.html", page.encode())
            folders.append((video, folder))

        for r in iterator:
            if r.video is None or "/" in r.video or r.video.startswith((".", "_")):
                raise ValueError(f"not the name of a folder: {r.video!r}")
            if r.video != video:
                close()
                video, items = r.video, []
            item = json.loads(r.item)
            name = f"img/{r.key.replace(':', '_')}.bmp"
            if r.pixels is not None:
                self.put(store, f"{own}/{video}/{name}", bitmap(bytes(r.pixels), r.w, r.h))
                item["img"] = name
            items.append(item)
        close()
        return Packed(folders)

    def commit(self, messages: list[Packed | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        for video, folder in (f for m in messages if m is not None for f in m.folders):
            place = f"{top}/{video}"
            if store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_dir(place)
            store.move(folder, place)
        self.abort(messages)

    def abort(self, messages: list[Packed | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(top).type != fs.FileType.NotFound:
            store.delete_dir(top)


def save_packs(items: DataFrame, crops: DataFrame, path: str, labels: list[str]) -> None:
    """A pack for each video of items ``video, key, item`` (as ``media.annotation_items`` gives them, with ``t`` in the item).

    crops: ``video, key, w, h, pixels``, at most one of each item; an item without one keeps the name of its picture. Items are
    in order of their time. A pack takes the place of an earlier one of its video; what is
    not given stays. Items are a selection for people, some hundreds a video, so a video is one
    task's. A job that fails leaves nothing behind.
    """
    spark = items.sparkSession
    spark.dataSource.register(AnnotationPacks)
    kept = crops.selectExpr("video", "key", "w", "h", "pixels")
    rows = items.select("video", "key", "item").join(kept, ["video", "key"], "left")
    rows = rows.repartition("video").sortWithinPartitions("video", "key")
    rows.select("video", "key", "item", "w", "h", "pixels").write.format("annotation_packs").option("path", path).option("labels", json.dumps(labels)).mode("append").save()
