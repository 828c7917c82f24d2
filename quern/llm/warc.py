"""WARC archives with a two-level capture index.

Pages become gzip members of WARC/1.1 files: one response for each payload, revisit records (the
identical-payload-digest profile) for the others that carry it. The index has a line per capture,
sorted by reversed-host URL key and id; a part file holds compressed blocks of lines and ends with
its sparse directory, the first key of each block. Above that is one list with the first key of
each part. A lookup searches the list, the part's directory and the block by bisection, then reads
just the record's range.

Tasks write files of their own name in the shared folder by pyarrow's file systems, so a retried or
doubled task leaves an unused file and never a wrong one: only what a finished task reported is read.

Edge cases: null html is an empty payload; a null url has the empty key and no target header; a
null page_id is never a response's name unless its whole group is null; rows that repeat a page_id
get a record each, and with equal payloads both are responses when that id is the largest; an empty
table gives an empty result. Other columns are not read, whatever their names. The pages of a payload
that very many carry are dealt to many places (common.spread_join).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import Workspace, digest, spread_join, table

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 2_000
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed host, then the rest of the URL: com,example,www)/path?query. Blanks and controls become +."""
    text = F.coalesce(url, F.lit(""))
    split = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*))?([\s\S]*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(text, split, 1)), r"\.")), ",")
    return F.regexp_replace(F.concat(host, F.lit(")"), F.regexp_extract(text, split, 2)), r"[\x00-\x20]", "+")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    fields.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    fields.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    fields.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(member: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit)."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = _fields(head)
    http_head, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    size = int(_fields(http_head)["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    page = _page(warc["warc-record-id"])
    if warc["warc-type"] == "revisit":
        return page, size, digest, "revisit", _page(warc["warc-refers-to"]), None
    if len(payload) != size or sha1_base32(payload) != digest:
        raise ValueError(f"record of page {page} is damaged")
    return page, size, digest, "response", None, payload


def with_originals(pages: DataFrame, workspace: Workspace) -> DataFrame:
    """page_id, url, html, refers_to: the page whose payload a page repeats, null for responses."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), html.alias("html"), digest(html).alias("sha"))
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = workspace.materialise(groups.where("n > 1"), "payloads")
    joined = spread_join(rows, groups, ["sha"], ["page_id", "url"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"), url_key(F.col("url")).alias("url_key"))


CAPTURE = "url_key string, page_id long, file string, offset long, length long"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, html, refers_to, url_key) under folder; the captures, to be materialised once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for chunk in text_chunks(batches, "html"):
                keys, ids, urls, refers = (chunk.column(c).to_pylist() for c in ("url_key", "page_id", "url", "refers_to"))
                files, offsets, lengths = [], [], []
                for page_id, url, payload, refers_to in zip(ids, urls, texts_of(chunk, "html"), refers, strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = record_bytes(page_id, url, payload, refers_to)
                    out.write(member)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                columns = [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["url_key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("refers_to").cast("long").alias("refers_to"), "url_key").mapInArrow(run, CAPTURE)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the part files of the index; file, first_key, first_id of each part, to be materialised once."""
    by = captures.withColumn("id", F.coalesce("page_id", F.lit(NO_ID)))
    by = by.repartitionByRange("url_key", "id").sortWithinPartitions("url_key", "id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, out, at, directory, lines = f"index-{uuid.uuid4().hex}", None, 0, [], []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            key, number = lines[0].split("\t", 2)[:2]
            directory.append((key, int(number), at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for key, number, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("url_key", "id", "file", "offset", "length")), strict=True):
                lines.append(f"{key}\t{number}\t{file}\t{offset}\t{length}")
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            first = [pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64())]
            yield pa.RecordBatch.from_arrays(first, ["file", "first_key", "first_id"])

    return by.select("url_key", "id", "file", "offset", "length").mapInArrow(run, "file string, first_key string, first_id long")


class _Bounded(OrderedDict):
    """The last used of what get() made, size at most."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def get(self, key, make):
        if key not in self:
            if len(self) >= self.size:
                self.popitem(last=False)
            self[key] = make()
        self.move_to_end(key)
        return self[key]


class CaptureReader:
    """Looks up (URL key, id) by bisection and reads records by range."""

    def __init__(self, archives: str, index: str, parts: list[tuple[str, int, str]]):
        """parts: first key, first id and file of each part, sorted."""
        self.store, self.archives = fs.FileSystem.from_uri(archives)
        self.index = fs.FileSystem.from_uri(index)[1]
        self.parts, self.firsts = parts, [p[:2] for p in parts]
        self.files, self.directories, self.blocks = _Bounded(32), _Bounded(4), _Bounded(4)

    def _directory(self, part: str):
        def read():
            opened = self.store.open_input_file(f"{self.index}/{part}")
            size = opened.size()
            length = int.from_bytes(opened.read_at(8, size - 8), "big")
            entries = json.loads(zlib.decompress(opened.read_at(length, size - 8 - length)))
            return opened, [(k, n) for k, n, _, _ in entries], entries

        return self.directories.get(part, read)

    def _block(self, part: str, number: int):
        def read():
            opened, _, entries = self._directory(part)
            _, _, offset, length = entries[number]
            lines = [x.split("\t") for x in zlib.decompress(opened.read_at(length, offset)).decode().split("\n")]
            return [(k, int(n)) for k, n, *_ in lines], [(f, int(o), int(s)) for _, _, f, o, s in lines]

        return self.blocks.get((part, number), read)

    def places(self, key: str, number: int) -> list[tuple[str, int, int]]:
        """File, offset and length of every capture of (key, number). All are in one part, maybe over several blocks."""
        at = bisect_right(self.firsts, (key, number)) - 1
        if at < 0:
            return []
        part = self.parts[at][2]
        firsts, found = self._directory(part)[1], []
        block = max(bisect_left(firsts, (key, number)) - 1, 0)
        while block < len(firsts) and firsts[block] <= (key, number):
            keys, places = self._block(part, block)
            found += places[bisect_left(keys, (key, number)) : bisect_right(keys, (key, number))]
            block += 1
        return found

    def read(self, file: str, offset: int, length: int) -> bytes:
        opened = self.files.get(file, lambda: self.store.open_input_file(f"{self.archives}/{file}"))
        return opened.read_at(length, offset)


class WarcStore:
    """Archives and their index under one folder of the shared root."""

    def __init__(self, workspace: Workspace):
        self.workspace = workspace
        self.archives, self.index = f"{workspace.path}/archives", f"{workspace.path}/index"

    def write(self, pages: DataFrame) -> None:
        captures = self.workspace.materialise(write_archives(with_originals(pages, self.workspace), self.archives), "captures")
        self.parts = self.workspace.materialise(write_index(captures, self.index), "parts")

    def fetch(self, wanted: DataFrame, with_payload: bool = False) -> DataFrame:
        """Every capture of the wanted (url_key, page_id): the fields of its record, and the payload if asked."""
        # One short row for each part file, so as many as the index has partitions.
        parts = sorted((r["first_key"], r["first_id"], r["file"]) for r in self.parts.collect())
        archives, index = self.archives, self.index
        asked = wanted.select("url_key", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id")).distinct()
        # A stated number of tasks: their rows are short, but each stands for a read.
        n_tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = asked.repartitionByRange(n_tasks, "url_key", "id").sortWithinPartitions("url_key", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = CaptureReader(archives, index, parts)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if with_payload else 5]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = [
                        parse_record(reader.read(*place))[: len(kinds)]
                        for key, number in zip(part.column("url_key").to_pylist(), part.column("id").to_pylist(), strict=True)
                        for place in reader.places(key, number)
                    ]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return asked.mapInArrow(run, schema + ", payload binary" * with_payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    store = WarcStore(Workspace(spark, "warc"))
    store.write(pages)
    return store.fetch(pages.select(url_key(F.col("url")).alias("url_key"), "page_id"))


#: Base32 by hand: five hex digits are four characters.
ORACLE_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), grouped AS (
  SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last, sha1(body) AS hex FROM bodies
), digits AS (
  SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT) AS parts FROM grouped
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM digits
"""
