"""Web archives: write pages as records, rewrite one-stream archives record by record with an offset index, read them back.

A one-stream archive is a single gzip member, so nothing in it can be reached without inflating all before it. ``normalise`` inflates each
archive once, in chunks, writes every record as a gzip member of its own and an index of offsets beside the archive. ``read_back``
then seeks to the members. A task holds one chunk at a time, not an archive; a record read back is held whole.

Files go to a folder that all executors share, each under a name no other attempt uses, and only the names that a finished task
returned are read, so tasks that are run again do no harm.

Defined results: a null html is an empty payload; pages with equal ids are records of their own; a null id is left out of the record and comes
back null; if all ids of equal payloads are null, all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.config import new_path, parallelism, pin
from lociframe.llm.util import same, text_of

LEAST_REVISIT = 1000  # bytes
ARCHIVE_BYTES = 64 << 20  # of records, after which a task begins another archive
CHUNK = 1 << 20
STRETCH = 4 << 20  # of an archive that is read by one task
LEVEL = 6  # of compression
GZIP = 31  # zlib's window bits for gzip
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with __payload, __bytes, __digest and __refers, the page that a revisit refers to."""
    payload = text_of(html_col).cast("binary")
    rows = pages.withColumn("__payload", payload).withColumn("__bytes", F.octet_length("__payload").cast("long")).withColumn("__digest", F.sha1("__payload"))
    first = (
        rows.where(F.col("__bytes") >= LEAST_REVISIT).groupBy("__digest").agg(F.max(id_col).alias("__refers"), F.count("*").alias("__n"))
        .where("__n > 1").select(F.col("__digest").alias("__d"), "__refers")
    )
    joined = rows.join(first, F.col("__digest") == F.col("__d"), "left").drop("__d")
    return joined.withColumn("__refers", F.when(~same(F.col("__refers"), F.col(id_col)), F.col("__refers")))


def _uri(page: int) -> str:
    return f"urn:page:{page}"


def _record_id(page: int | None) -> str:
    """The id of a page's record, so that revisits can name it without a look at it."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, _uri(page))}>"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> tuple[bytes, list[bytes]]:
    """Header and body of a record; a revisit has the payload's digest and length, but not the payload."""
    body = [HTTP] if refers is not None else [HTTP, payload]
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"WARC-Page: <{_uri(page)}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers)}", f"WARC-Refers-To-Page: <{_uri(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {sum(map(len, body))}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), body


class _Out:
    """One archive being written as a single gzip stream."""

    def __init__(self, folder: str):
        self.fs, path = _store(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.file = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.gz, self.size, self.records = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0

    def add(self, parts: list[bytes]) -> None:
        for part in parts:
            self.size += len(part)
            self.file.write(self.gz.compress(part))
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.file.write(self.gz.flush())
        self.file.close()
        return self.name, self.records


def write(rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Write the rows of ``with_revisits`` as one-stream archives; returns their names and numbers of records."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            for page, url, payload, refers in batch.itertuples(index=False):
                out = out or _Out(folder)
                header, body = record(None if pd.isna(page) else int(page), url, bytes(payload), None if pd.isna(refers) else int(refers))
                out.add([header, *body, b"\r\n\r\n"])
                if out.size >= ARCHIVE_BYTES:
                    yield pd.DataFrame([out.close()], columns=["archive", "records"])
                    out = None
        if out:
            yield pd.DataFrame([out.close()], columns=["archive", "records"])

    # Ids as text, so that pandas keeps large ones exact beside nulls.
    wanted = rows.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).cast("string").alias("url"), "__payload", F.col("__refers").cast("string"))
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    return pin(wanted.mapInPandas(save, "archive string, records long"))


class _Stream:
    """The inflated bytes of a gzip file, chunk by chunk; further members follow the first. ``at`` is how much of what is held has been taken."""

    def __init__(self, file):
        self.file, self.z, self.held, self.at = file, zlib.decompressobj(GZIP), b"", 0

    def more(self) -> bool:
        """Inflate another chunk onto what is held."""
        while True:
            raw = self.z.unconsumed_tail
            if self.z.eof:
                raw, self.z = self.z.unused_data, zlib.decompressobj(GZIP)
            raw = raw or self.file.read(CHUNK // 4)
            if not raw:
                return False
            got = self.z.decompress(raw, CHUNK)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True

    def header(self) -> bytes | None:
        seen = 0  # bytes that hold no end of a header
        while (end := self.held.find(b"\r\n\r\n", self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - 3)
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("an archive ends within a header")
                return None
        out, self.at = self.held[self.at : end + 4], end + 4
        return out

    def body(self, length: int, to: Callable[[bytes], None]) -> None:
        while length > 0:
            if self.at == len(self.held) and not self.more():
                raise ValueError("an archive ends within a record")
            part = self.held[self.at : self.at + length]
            self.at += len(part)
            length -= len(part)
            to(part)


def fields(header: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:] if ": " in line)


def normalise_archive(folder: str, archive: str) -> tuple[str, list[tuple[int, int]]]:
    """Rewrite one archive; returns the new name and (offset, length) of its members. The index beside it has a JSON line a record."""
    fs, path = _store(folder)
    name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
    spans, at = [], 0
    with (
        fs.open_input_stream(f"{path}/{archive}", compression=None) as source,
        fs.open_output_stream(f"{path}/{name}", compression=None) as target,
        fs.open_output_stream(f"{path}/{name}.index", compression=None) as index,
    ):
        stream = _Stream(source)
        while (header := stream.header()) is not None:
            gz, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0

            def put(part: bytes, last: bool = False, gz=gz) -> None:
                nonlocal size
                packed = gz.compress(part) + (gz.flush() if last else b"")
                target.write(packed)
                size += len(packed)

            put(header)
            said = fields(header)
            stream.body(int(said["Content-Length"]), put)
            stream.body(4, put)
            put(b"", last=True)
            line = {"offset": at, "length": size, "id": said.get("WARC-Record-ID"), "type": said["WARC-Type"], "url": said.get("WARC-Target-URI"), "digest": said.get("WARC-Payload-Digest")}
            index.write((json.dumps(line) + "\n").encode())
            spans.append((at, size))
            at += size
    return name, spans


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives one a task at a time; returns the names of the new ones."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"archive": [normalise_archive(folder, archive)[0] for archive in batch["archive"]]})

    return pin(archives.mapInPandas(rewrite, "archive string"))


def sidecar(names: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length, id, type, url, digest) of every record, from the index files beside the archives ``names``."""
    lines = names.sparkSession.read.schema("offset long, length long, id string, type string, url string, digest string").json(f"{folder}/*.members.warc.gz.index")
    archive = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.index$", 1)
    # Names only: an archive that a lost task left behind is not among them.
    return lines.select(archive.alias("archive"), "*").join(names, "archive", "left_semi")


READ = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, verified boolean"


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Seek to every member and read its record. A response's digest and length are taken from its payload, a revisit's from its header."""

    def bare(said: dict[str, str], key: str) -> str | None:
        value = said.get(key)
        return value[1:-1].removeprefix("urn:page:") if value else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _store(folder)
        for batch in batches:
            rows = []
            for archive, part in batch.groupby("archive", sort=False):
                with fs.open_input_file(f"{path}/{archive}") as file:
                    for offset, length in zip(part["offset"], part["length"], strict=True):
                        file.seek(int(offset))
                        header, _, rest = zlib.decompress(file.read(int(length)), GZIP).partition(b"\r\n\r\n")
                        said = fields(header)
                        payload = rest[: int(said["Content-Length"])][len(HTTP) :]
                        claimed = base64.b32decode(said["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        full = said["WARC-Type"] == "response"
                        digest = hashlib.sha1(payload).hexdigest() if full else claimed
                        size = len(payload) if full else int(said["WARC-Payload-Length"])
                        rows.append((bare(said, "WARC-Page"), size, digest, said["WARC-Type"], bare(said, "WARC-Refers-To-Page"), digest == claimed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return index.mapInPandas(read, READ)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, normalise these, and return what is read from them, a row a page."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    archives = write(with_revisits(pages, id_col, html_col), folder, id_col, url_col)
    names = normalise(archives.repartition(max(1, archives.count())), folder)
    index = sidecar(names, folder).select("archive", "offset", "length") if not names.isEmpty() else spark.createDataFrame([], "archive string, offset long, length long")
    # Archives are read in stretches, side by side, wherever Spark has read the index.
    stretches = index.repartition(parallelism(spark), "archive", F.expr(f"offset div {STRETCH}")).sortWithinPartitions("archive", "offset")
    got = read_back(stretches, folder)
    number = pages.schema[id_col].dataType
    return got.withColumn(id_col, F.col("page").cast(number)).withColumn("refers_to", F.col("refers_to").cast(number)).drop("page")
