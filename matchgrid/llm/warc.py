"""WARC archives: writing, and reading back by boundary-chain verification.

Writing: one record per page, in plain WARC 1.1. Of the records with equal
payloads the one with the largest page id is the response, the others revisit
it and carry no payload. Files are made by Spark's text sink, with the record
trailer as line separator, so any Hadoop file system will do.

Reading: the archives are split like any text, with the record magic as line
separator. A magic inside a payload therefore begins a false record. Tasks emit
for every candidate the offset of its successor (from its header); inside a
task the successors are followed up to the first one that lies beyond the
split, and pointer jumping over the splits, from the start of each file, keeps
the candidates that a chain of true records reaches. Text at a rejected
candidate stays part of the payload it lies in, also across splits.

Edge cases: a payload of any length is one record, also over several splits; a
null html is an empty payload; a null page id stays null (the
largest of equal payloads is then null only if all are); a null url is an empty
header, and a url in brackets cannot end a line with the magic. Rows repeated with their page id are all responses. An empty table
gives an empty result. Extra columns are ignored. A file that does not begin
with a record yields nothing; a chain that breaks ends there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, picked, work_folder

MAGIC = "WARC/1.1\r\n"
TRAILER = "\r\n\r\n"
#: Payloads of fewer bytes are always responses.
MIN_REVISIT_BYTES = 0

#: Digests (about 50 bytes each) and splits (32 bytes each; at 128 MB a split
#: some 128 TB of archives) that are broadcast at most.
BROADCAST_DIGESTS = 300_000
BROADCAST_SPLITS = 1_000_000

MAGIC_LEN = len(MAGIC)
LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: (\d+)")
NO_REACH = -1


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """Adds the payload digest; html becomes the payload text, url one line."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [h or "" for h in b.column("html").to_pylist()]
            raw = [h.encode() for h in html]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    b.column("url"),
                    pa.array(html, pa.string()),
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([payload_digest(r) for r in raw], pa.string()),
                ],
                ["page_id", "url", "payload", "payload_bytes", "digest"],
            )

    return map_arrow(
        picked(pages, page_id="long", url="string", html="string"),
        add,
        "page_id long, url string, payload string, payload_bytes long, digest string",
    )


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes the pages as WARC files into the folder ``path``."""
    rows = with_digests(pages)
    originals = materialize(
        rows.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-originals",
    )
    # Only digests that occur again are looked up; while they are few, the
    # payloads need not move for it.
    if originals.count() <= BROADCAST_DIGESTS:
        originals = F.broadcast(originals)
    rows = rows.join(originals, "digest", "left")
    revisit = F.col("original").isNotNull() & (
        F.col("page_id").isNull() | (F.col("page_id") != F.col("original"))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: <"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x1f]", ""),
        F.lit(">\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(
                    "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    "\r\nWARC-Refers-To: <urn:page:"
                ),
                F.col("original").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", TRAILER).text(path)


def _located(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[list[tuple]]:
    """Pieces as (file, block, start, piece, first, *more); start counts from the split.

    The rows of a split come in order; a split's first piece in a file is what
    stands before the first magic.
    """
    now, start = None, 0
    for b in batches:
        out = []
        cols = [b.column(c).to_pylist() for c in ("file", "block", "piece", *more)]
        for path, block, piece, *rest in zip(*cols, strict=True):
            first = (path, block) != now and block == 0
            if (path, block) != now:
                now, start = (path, block), 0
            out.append((path, block, start, piece, first, *rest))
            start += len(piece) + MAGIC_LEN
        yield out


def record_length(piece: bytes) -> int | None:
    """Length by its header of the record that begins with this piece."""
    head = piece.find(b"\r\n\r\n")
    found = LENGTH.search(piece, 0, head) if head >= 0 else None
    return MAGIC_LEN + head + 4 + int(found[1]) + len(TRAILER) if found else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate's place in its split and its length by its header, if any."""
    for rows in _located(batches):
        out = [
            (path, block, start, None if first else record_length(piece), len(piece))
            for path, block, start, piece, first in rows
        ]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "start", "delta", "size"]
        )


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate, the first successor on its chain outside its split.

    Rows come sorted by file, block and descending offset, one split after the
    other, so each successor inside the split is known before it is asked for.
    """
    now: tuple | None = None
    exits: dict[int, int] = {}
    for b in batches:
        out = []
        for path, block, off, nxt in zip(*(b.column(c).to_pylist() for c in ("file", "block", "off", "nxt")), strict=True):
            if (path, block) != now:
                now, exits = (path, block), {}
            exits[off] = exits.get(nxt, nxt)
            out.append((path, block, off, exits[off]))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            ["file", "block", "off", "nxt"],
        )


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def parse_record(record: bytes) -> tuple:
    """Fields of a whole record; payload size and digest from the payload itself."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
    http, _, payload = block[: -len(TRAILER)].partition(b"\r\n\r\n")
    kind, page = fields.get("WARC-Type", ""), fields.get("WARC-Record-ID", "")[10:-1]
    if kind == "revisit":
        found = LENGTH.search(http)
        size = int(found[1]) if found else None
        digest, refers = fields.get("WARC-Payload-Digest", "")[5:], fields.get("WARC-Refers-To", "")[10:-1]
    else:
        size, digest, refers = len(payload), payload_digest(payload), ""
    return int(page) if page else None, size, digest, kind, int(refers) if refers else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the true chain through each split; parses records, passes on parts.

    ``ends`` is where the record of a piece ends; a piece before the first true
    record of its split belongs to the record that ends at that one. Only
    pieces of records that hold a magic, or cross splits, are passed on.
    """
    now: tuple | None = None
    ends = NO_REACH
    for rows in _located(batches, "base", "entry"):
        out = []
        for path, block, start, piece, _, base, entry in rows:
            if (path, block) != now:
                now, ends = (path, block), NO_REACH if entry is None else entry
            off = base + start - MAGIC_LEN
            if off < 0:
                continue
            here = off == ends
            if here:
                delta = record_length(piece)
                ends = NO_REACH if delta is None else off + delta
            if ends == NO_REACH or off > ends:
                continue
            if here and off + MAGIC_LEN + len(piece) == ends:
                out.append((None, None, None, None, *parse_record(piece)))
            else:
                out.append((path, ends, off, piece, None, None, None, None, None))
        cols = list(zip(*out, strict=True)) or [()] * 9
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), *KINDS)
        names = ["file", "ends", "off", "piece", *(f.split()[0] for f in FIELDS.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = list(zip(*map(parse_record, b.column("piece").to_pylist()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], [f.split()[0] for f in FIELDS.split(", ")]
        )


def reachable(candidates: DataFrame) -> DataFrame:
    """Entry offset of each split that the chain of true records enters.

    candidates: ``file, block, off, nxt``. Pointer jumping: each round doubles
    the number of splits that a pointer spans, so the rounds are the logarithm
    of the splits of the largest file.
    """
    jump = materialize(
        map_arrow(
            candidates.where("nxt is not null")
            .select("file", "block", "off", "nxt")
            .repartition("file", "block")
            .sortWithinPartitions("file", "block", F.desc("off")),
            _exits,
            "file string, block long, off long, nxt long",
        ),
        "warc-jump",
    )
    most = (
        candidates.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    )
    reach = candidates.where("off = 0").select("file", "block", "off")
    span = 1
    while span < most:
        hop = reach.join(jump.select("file", "off", "nxt"), ["file", "off"]).select("file", F.col("nxt").alias("off"))
        hop = hop.join(candidates.select("file", "off", "block"), ["file", "off"]).select("file", "block", "off")
        reach = materialize(reach.unionByName(hop).distinct(), "warc-reach", instead_of=(reach,) if span > 1 else ())
        onward = jump.select("file", F.col("off").alias("nxt"), F.col("nxt").alias("far"))
        jump = materialize(
            jump.join(onward, ["file", "nxt"]).select("file", "block", "off", F.col("far").alias("nxt")),
            "warc-jump",
            instead_of=(jump,),
        )
        span *= 2
    return reach


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all records."""
    raw = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("piece"),
        )
    )
    light = materialize(
        map_arrow(raw, _candidates, "file string, block long, start long, delta long, size long"), "warc-light"
    )
    splits = light.groupBy("file", "block").agg(F.max(F.col("start") + F.col("size") + MAGIC_LEN).alias("bytes"))
    # A file has few splits: one row per split is all that a window gathers.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    splits = materialize(splits, "warc-splits")
    off = F.col("base") + F.col("start") - MAGIC_LEN
    candidates = materialize(
        light.join(splits, ["file", "block"])
        .select("file", "block", off.alias("off"), (off + F.col("delta")).alias("nxt"))
        .where("off >= 0"),
        "warc-candidates",
        instead_of=(light,),
    )
    entries = reachable(candidates).groupBy("file", "block").agg(F.min("off").alias("entry"))
    # Where a record covers whole splits, its end is the next entry.
    backwards = Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = splits.join(entries, ["file", "block"], "left").select(
        F.xxhash64("file").alias("f"), "block", "base", F.last("entry", ignorenulls=True).over(backwards).alias("entry")
    )
    plan = materialize(plan, "warc-plan")
    # The plan of the splits is broadcast, so that their rows stay in order; an
    # archive of very many splits is read in several turns of whole files.
    turns = max(1, -(-plan.count() // BROADCAST_SPLITS))
    turn = F.pmod(F.col("f"), F.lit(turns))
    named = raw.withColumn("f", F.xxhash64("file"))
    found = None
    for k in range(turns):
        part = named.where(turn == k).join(F.broadcast(plan.where(turn == k)), ["f", "block"])
        part = map_arrow(
            part.select("file", "block", "piece", "base", "entry"),
            _records,
            f"file string, ends long, off long, piece binary, {FIELDS}",
        )
        found = part if found is None else found.unionByName(part)
    found = materialize(found, "warc-records", instead_of=(candidates,))
    parts = (
        found.where("file is not null")
        .groupBy("file", "ends")
        .agg(F.array_sort(F.collect_list(F.struct("off", "piece"))).alias("parts"))
    )
    magic = F.lit(MAGIC).cast("binary")
    joined = F.aggregate(
        F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
        F.element_at("parts", 1)["piece"],
        lambda acc, x: F.concat(acc, magic, x["piece"]),
    )
    # A record whose end the file does not hold is incomplete and left out.
    first = F.element_at("parts", 1)["off"]
    whole = parts.where(F.octet_length(joined) + MAGIC_LEN + first == F.col("ends")).select(joined.alias("piece"))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return found.where("file is null").select(*names).unionByName(map_arrow(whole, _parse, FIELDS))


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives into the shared folder and returns what they hold."""
    spark = pages.sparkSession
    path = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_revisit_bytes)
    return read_warc(spark, path)
