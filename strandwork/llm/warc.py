"""WARC archives: writing, normalising monolithic gzip files, and reading back through a sidecar index.

A *monolithic* archive is one gzip stream over a whole file, which only reads from its start. The normaliser inflates
such a stream once, finds each record by its headers, and writes every record as a gzip member of its own, together with
a Parquet sidecar index (folder ``index`` beside the archives) of record id, file, offset, length and header fields. A
record is then one ranged read. Any archive will do, whatever its records are and whichever optional headers they have;
a record is copied in blocks and never held whole.

Archives are ordinary files under a folder that driver and executors share (any scheme that ``pyarrow.fs`` knows).
A task writes to a name of its own attempt and renames it when complete, so a repeated task replaces a whole file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import saved, spread_join

BLOCK = 1 << 20
#: Fixed value: the profile that the WARC standard names for a revisit with the same payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header that carries a row's own key; other archives have none.
KEY = "x-record-key"
INDEX = (
    "file string, offset long, length long, record_id string, warc_type string, target_uri string, record_key string, "
    "payload_digest string, payload_length long, refers_to string, refers_to_key string, block_length long"
)
FIELDS = tuple(f.split()[0] for f in INDEX.split(", "))
_LONGS = {f.split()[0] for f in INDEX.split(", ") if f.endswith(" long")}
_SCHEMA = pa.schema([(n, pa.int64() if n in _LONGS else pa.string()) for n in FIELDS])
MAX_HEAD = 1 << 20


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _line(value: str) -> str:
    """A header value in one line: control characters would end the header and are written as percent codes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_id(name: str, ordinal: int) -> str:
    """An id for the nth record of a file of this name, whatever the record holds."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{ordinal}')}"


def _head(fields: dict[str, str | None], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    """The head of the response that a page came in."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response_fields(rec_id: str, date: str, uri: str | None, key: str | None, digest: str) -> dict[str, str | None]:
    return {
        "WARC-Type": "response",
        "WARC-Record-ID": f"<{rec_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else _line(uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Record-Key": None if key is None else _line(key),
        "Content-Type": "application/http;msgtype=response",
    }


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def revisits(manifest: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """Of the records of a manifest with equal payloads of at least ``min_bytes`` those that are not of the largest key:
    ``file``, ``ordinal`` and the record that they repeat, ``to_file``, ``to_ordinal`` and ``to_key``. Only payloads with
    two keys or more are joined."""
    long = manifest.where(F.col("payload_length") >= min_bytes)
    same = long.groupBy("payload_digest").agg(F.max(F.struct("key", "file", "ordinal")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a payload's records are dealt by a salt too, which the few payloads are repeated for
    found = spread_join(long, same.drop("n"), ["payload_digest"], ["file", "ordinal"]).where(~F.col("key").eqNullSafe(F.col("to.key")))
    return found.select("file", "ordinal", F.col("to.file").alias("to_file"), F.col("to.ordinal").alias("to_ordinal"), F.col("to.key").cast("string").alias("to_key"))


def write_monolithic(pages: DataFrame, root: str, *, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    """Writes a response record for each row of ``pages`` to archives under ``root``, one gzip stream for each task.

    Returns the manifest: ``file``, ``ordinal`` (of the record in it), ``key``, ``payload_digest`` and ``payload_length``.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        mine, ordinal = f"{base}/.{name}.{uuid.uuid4().hex}", 0
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        with store.open_output_stream(mine, compression=None) as out:
            for batch in batches:
                sums, sizes = [], []
                for key, uri, html in zip(*(batch.column(i) for i in range(3))):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    sums.append(hashlib.sha1(payload).hexdigest())
                    sizes.append(len(payload))
                    http = http_head(len(payload))
                    own = None if key.as_py() is None else str(key.as_py())
                    fields = response_fields(record_id(f"{root}/{name}", ordinal + len(sums) - 1), date, uri.as_py(), own, sums[-1])
                    for part in (_head(fields, len(http) + len(payload)), http, payload, b"\r\n\r\n"):
                        out.write(press.compress(part))
                n = len(sums)
                cols = [pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)]
                ordinal += n
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], names=["file", "ordinal", "key", "payload_digest", "payload_length"])
            out.write(press.flush())
        store.move(mine, f"{base}/{name}")

    rows = pages.select(*(F.col(f"`{c}`").cast("string") if c != id_col else F.col(f"`{c}`") for c in (id_col, url_col, html_col)))
    return rows.mapInArrow(run, f"file string, ordinal long, key {kind}, payload_digest string, payload_length long")


def inflated(stream, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in blocks of ``size`` at most, however well it is compressed."""
    press = zlib.decompressobj(31)
    while raw := stream.read(size):
        while raw:
            if press.eof:  # another member follows
                press = zlib.decompressobj(31)
            if data := press.decompress(raw, size):
                yield data
            raw = press.unused_data if press.eof else press.unconsumed_tail
    if rest := press.flush():
        yield rest


class Records:
    """The records of an inflated archive, one after another: ``head()`` and then ``body()``, which is in blocks."""

    def __init__(self, blocks: Iterable[bytes]):
        self.more, self.held, self.left = iter(blocks), bytearray(), 0

    def _fill(self) -> bool:
        data = next(self.more, None)
        if data is not None:
            self.held.extend(data)
        return data is not None

    def head(self) -> tuple[bytes, dict[str, str]] | None:
        """The bytes of the next record's head and its fields; None at the end of the archive."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            at = self.held.find(b"\r\n\r\n")
            plain = self.held.find(b"\n\n", 0, at if at >= 0 else len(self.held))
            cut = plain + 2 if plain >= 0 else at + 4 if at >= 0 else 0
            if cut:
                raw = bytes(self.held[:cut])
                del self.held[:cut]
                fields = _parse(raw.strip())
                if not raw.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                    raise ValueError("not a WARC record")
                self.left = int(fields["content-length"])
                return raw, fields
            if len(self.held) > MAX_HEAD:
                raise ValueError("not a WARC record")
            if not self._fill():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return None

    def body(self) -> Iterator[bytes]:
        while self.left:
            if not self.held and not self._fill():
                raise ValueError("an archive ends within a record")
            part = bytes(memoryview(self.held)[: self.left])
            del self.held[: len(part)]
            self.left -= len(part)
            yield part


class Payload:
    """Length and, where asked for, digest of the payload of a record's block, given in parts: an HTTP message's is what
    follows its head, whose own length field a revisit keeps."""

    def __init__(self, fields: dict[str, str], digest: bool):
        self.http, self.length, self.start, self.said = fields.get("content-type", "").startswith("application/http"), 0, b"", None
        self.sum = hashlib.sha1() if digest else None

    def update(self, part: bytes) -> None:
        if self.http:
            self.start += part
            head, end, part = self.start.partition(b"\r\n\r\n")
            if not end:
                return
            length = _parse(head).get("content-length", "")
            self.http, self.start, self.said = False, b"", int(length) if length.isdigit() else None
        if self.sum:
            self.sum.update(part)
        self.length += len(part)


def _bare(x: str | None) -> str | None:
    return x.strip("<>") if x is not None else None


def normalise(files: DataFrame, source: str, target: str, tasks: int) -> DataFrame:
    """Rewrites each archive named in ``files`` from ``source`` to ``target`` with a gzip member for every record, and
    returns the sidecar index. ``files`` has ``file`` and ``revisits``, an array of (ordinal, to_file, to_ordinal,
    to_key) for the records to write without their payload, as revisits (null: none). A file is streamed: a block, and the
    index rows of ten thousand records, are in memory. A digest that a record's head lacks is computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (src, src_base), (dst, dst_base) = _open(source), _open(target)
        dst.create_dir(dst_base, recursive=True)
        for name, known in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            mine, rows, offset, ordinal = f"{dst_base}/.{name}.{uuid.uuid4().hex}", [], 0, 0
            again = {x["ordinal"]: x for x in known or ()}
            with src.open_input_stream(f"{src_base}/{name}", compression=None) as stream, dst.open_output_stream(mine, compression=None) as out:
                records = Records(inflated(stream))
                while (found := records.head()) is not None:
                    raw, head = found
                    press, written = zlib.compressobj(1, zlib.DEFLATED, 31), 0

                    def put(data: bytes) -> int:
                        packed = press.compress(data)
                        out.write(packed)
                        return len(packed)

                    kind, refers, to_key, block = head.get("warc-type"), _bare(head.get("warc-refers-to")), None, int(head["content-length"])
                    digest = head.get("warc-payload-digest", "").partition(":")[2]
                    payload, to = Payload(head, not digest), again.get(ordinal)
                    if to is None:
                        written += put(raw)
                    for part in records.body():
                        payload.update(part)
                        if to is None:
                            written += put(part)
                    digest = digest or payload.sum.hexdigest()
                    length = payload.said if kind == "revisit" and payload.said is not None else payload.length
                    if to is not None:
                        kind, refers, to_key = "revisit", record_id(f"{source}/{to['to_file']}", to["to_ordinal"]), to["to_key"]
                        block_bytes = http_head(length)
                        block = len(block_bytes)
                        fields = response_fields(_bare(head["warc-record-id"]), head["warc-date"], head.get("warc-target-uri"), head.get(KEY), digest)
                        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers}>"}
                        written += put(_head(fields, block)) + put(block_bytes)
                    written += put(b"\r\n\r\n")
                    last = press.flush()
                    out.write(last)
                    written += len(last)
                    rows.append((name, offset, written, _bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"), head.get(KEY), digest, length, refers, to_key, block))
                    offset += written
                    ordinal += 1
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r)) for r in rows], _SCHEMA)
                        rows = []
            dst.move(mine, f"{dst_base}/{name}")
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r)) for r in rows], _SCHEMA)

    return files.select("file", "revisits").repartitionByRange(tasks, "file").mapInArrow(run, INDEX)


def read_members(index: DataFrame, root: str, tasks: int) -> DataFrame:
    """The rows of an index with ``payload_sha1`` and ``payload_bytes`` of the record that each points at, read from the
    normalised archives by offset. Neighbouring members of a file are read in one go, a block at a time; a longer member
    is read and inflated in blocks."""

    def blocks(source, offset: int, length: int) -> Iterator[bytes]:
        for at in range(offset, offset + length, BLOCK):
            yield source.read_at(min(BLOCK, offset + length - at), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        name, source, start, held = None, None, 0, b""
        for batch in batches:
            sums, sizes = [], []
            for file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length"))):
                if file != name:
                    if source:
                        source.close()
                    name, source, held = file, store.open_input_file(f"{base}/{file}"), b""
                if length > BLOCK:
                    parts = blocks(source, offset, length)
                else:
                    if not start <= offset <= offset + length <= start + len(held):
                        start, held = offset, source.read_at(BLOCK, offset)
                    parts = iter([held[offset - start : offset - start + length]])
                records = Records(inflated(_Parts(parts)))
                payload = Payload(records.head()[1], True)
                for part in records.body():
                    payload.update(part)
                sums.append(payload.sum.hexdigest())
                sizes.append(payload.length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, "payload_sha1", "payload_bytes"])
        if source:
            source.close()

    near = index.select(*FIELDS).repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, f"{INDEX}, payload_sha1 string, payload_bytes long")


class _Parts:
    """Parts of bytes as a stream that is read part by part."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts = parts

    def read(self, size: int) -> bytes:
        return next(self.parts, b"")


def round_trip(
    pages: DataFrame,
    root: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 1000,
    task_bytes: int = 16 << 20,
    date: str | None = None,
) -> DataFrame:
    """Writes ``pages`` to monolithic archives under ``root``, normalises them (archives in ``root/members``, their sidecar in
    ``root/index``), and reads every record back.

    Rows: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``file``, ``offset`` and
    ``length`` (of the member). Length and digest of a response are those of the bytes read back; a revisit has no
    payload of its own and carries those of its heads. ``date`` is the records' (now, if none is given). A null html is
    an empty payload, a null url is left out of the head, a null id is kept (and is referred to by none). Repeated rows
    are one record each; with equal ids they are responses alike. A page of any length is one record; a task holds one
    Arrow batch of pages when it writes and a block when it reads. Other columns are not read. An empty table gives no
    rows. Payloads do not move between tasks other than in archives.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark, stem = pages.sparkSession, f"{root}/monolithic"
    manifest = saved(write_monolithic(pages, stem, id_col=id_col, url_col=url_col, html_col=html_col, date=date))
    pairs = revisits(manifest, min_bytes=min_bytes).groupBy("file").agg(F.collect_list(F.struct("ordinal", "to_file", "to_ordinal", "to_key")).alias("revisits"))
    files = saved(manifest.select("file").distinct().join(pairs, "file", "left"))
    normalise(files, stem, f"{root}/members", max(1, files.count())).write.parquet(f"{root}/index")
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    stored = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    back = read_members(index, f"{root}/members", 1 + stored // task_bytes)

    def number(c: Column) -> Column:
        return c.cast(kind)

    response = F.col("warc_type") == "response"
    return back.select(
        number(F.col("record_key")).alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("payload_sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number(F.col("refers_to_key")).alias("refers_to"),
        "file",
        "offset",
        "length",
    )
