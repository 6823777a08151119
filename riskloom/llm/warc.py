"""WARC archives: one gzip member per record, written by many tasks and read in sequence."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import fresh_path, materialize
from riskloom.sources.shared_files import create, open_stream

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins its next archive.
ARCHIVE = 32 << 20
#: Bytes that are read, inflated or deflated at a time.
CHUNK = 1 << 16
#: A record's header lines may not be longer.
HEADER = 1 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:riskloom:page:"
#: Characters that a URL keeps; all others are percent-encoded, so that none can end a header line.
URL_SAFE = "".join(chr(c) for c in range(33, 127))

RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, valid boolean, html string")
MANIFEST = "path string, records long, bytes long"


def marked_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which pages repeat the payload of a smaller page_id.

    Only ids, digests and lengths are grouped and joined by payload; the payloads stay where they
    are unless the list of revisits is too long to broadcast, and are then dealt by page.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.filter(F.col("copies") > 1).drop("copies")
    later = large.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = materialize(later.distinct().select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"), "revisits")
    same = rows["page_id"].eqNullSafe(later["_page"]) & (rows["digest"] == later["_digest"])
    return rows.join(later, same, "left").drop("_page", "_digest")


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> list[bytes]:
    """The parts of one record before compression. A revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = [http] if refers_to is not None else [http, html]
    whole = hashlib.sha256()
    for part in block:
        whole.update(part)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{whole.hexdigest()}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {sum(map(len, block))}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return [("\r\n".join(lines) + "\r\n\r\n").encode(), *block, b"\r\n\r\n"]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write one record per row into gzip archives below ``folder``; the manifest of what was written.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the smallest id is the response and the
    others revisit it; rows that share this id are all responses. A null html is empty, a null
    url has no line, a null id is written as nothing and counts as larger than all others. Only archives in the
    manifest count: an attempt that failed leaves files that no manifest names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records = None, "", 0

        def close():
            done = pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [out.tell()]})
            out.close()
            return done

        for batch in batches:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, html, digest, first in zip(ids, urls, batch.column(2), digests, refers):
                if out is None:
                    path, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = create(path)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for part in record(page_id, url, html.as_buffer().to_pybytes(), digest, first):
                    out.write(member.compress(part))
                out.write(member.flush())
                records += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    marked = marked_revisits(pages, id_col, url_col, html_col)
    return materialize(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(work, MANIFEST), "warc-manifest")


def members(raw) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; each must be used up before the next.

    At most ``CHUNK`` bytes are read and inflated at a time, whatever a member's size.
    """
    rest = b""

    def pieces(member) -> Iterator[bytes]:
        nonlocal rest
        while not member.eof:
            rest = rest or raw.read(CHUNK)
            ended = not rest
            piece = member.decompress(rest, CHUNK)
            rest = member.unused_data if member.eof else member.unconsumed_tail
            if piece:
                yield piece
            elif ended and not member.eof:
                raise EOFError("the archive ends inside a record")

    while True:
        rest = rest or raw.read(CHUNK)
        if not rest:
            return
        yield pieces(zlib.decompressobj(31))


class Framed:
    """Bytes by length or up to an empty line, from pieces of any size."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def head(self, most: int) -> list[str]:
        """The lines before the next empty line, which takes ``most`` bytes at most."""
        while (end := self.held.find(b"\r\n\r\n", 0, most)) < 0:
            piece = next(self.pieces, b"")
            if not piece or len(self.held) >= most:
                raise ValueError("a record's header does not end")
            self.held += piece
        lines, self.held = self.held[:end], self.held[end + 4:]
        return lines.decode("utf-8", "replace").split("\r\n")

    def exactly(self, length: int) -> Iterator[bytes]:
        while length:
            piece = self.held or next(self.pieces, b"")
            if not piece:
                raise ValueError("a record is shorter than its Content-Length")
            self.held = piece[length:]
            yield piece[:length]
            length -= min(length, len(piece))

    def close(self) -> None:
        """What follows the block must be the two line ends of a record, and the member's end."""
        rest = self.held
        for piece in self.pieces:
            rest += piece
            if len(rest) > 4:
                break
        if rest != b"\r\n\r\n":
            raise ValueError("a record is not framed by its Content-Length")


def fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(ID)
    return int(number) if number else None


def parse(pieces: Iterator[bytes], keep: bool) -> tuple | None:
    """One record as a row of ``RECORDS``; None for record types other than response and revisit."""
    frame = Framed(pieces)
    version, *lines = frame.head(HEADER)
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {version[:40]}")
    warc = fields(lines)
    kind = warc.get("warc-type")
    block = frame.exactly(int(warc["content-length"]))
    if kind not in ("response", "revisit"):
        for _ in block:
            pass
        frame.close()
        return None
    whole, payload, kept, size = hashlib.sha256(), hashlib.sha256(), [], 0

    def hashed() -> Iterator[bytes]:
        for piece in block:
            whole.update(piece)
            yield piece

    inner = Framed(hashed())
    http = fields(inner.head(HEADER)[1:])
    for piece in (p for source in ((inner.held,), inner.pieces) for p in source):
        payload.update(piece)
        size += len(piece)
        if keep and kind == "response":
            kept.append(piece)
    frame.close()
    said = warc.get("warc-payload-digest", "").removeprefix("sha256:")
    valid = warc.get("warc-block-digest") == f"sha256:{whole.hexdigest()}"
    if kind == "response":
        valid &= said == payload.hexdigest() and int(http.get("content-length", -1)) == size
    else:
        valid &= size == 0
        size = int(http.get("content-length", 0))
    html = b"".join(kept).decode("utf-8", "replace") if keep and kind == "response" else None
    return (page_of(warc.get("warc-record-id")), warc.get("warc-target-uri"), kind,
            page_of(warc.get("warc-refers-to")) if kind == "revisit" else None, size, said, valid, html)


def read_archives(manifest: DataFrame, keep_html: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names in ``path``, in ``RECORDS``.

    Each archive is read once, from its start, in one task, by pieces of bounded size; only a
    payload that is kept is held whole. Wrong framing is an error. ``valid`` is false where a digest or a
    length differs from what the record says, and for a revisit also where no valid response with its
    digest and length stands under the id it refers to. A revisit's html is null, its length that of the full
    payload. No archives give no rows.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.large_string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_stream(path) as raw:
                    for member in members(raw):
                        row = parse(member, keep_html)
                        if row is None:
                            continue
                        rows.append(row)
                        held += len(row[-1] or "")
                        if len(rows) == 10_000 or held > ARCHIVE:
                            yield send(rows)
                            rows, held = [], 0
                yield send(rows)

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    found = paths.mapInArrow(work, RECORDS)
    if keep_html:
        found = materialize(found, "warc-records")
    light = found.select("record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "valid")
    if not keep_html:
        found = light = materialize(found.drop("html", "url"), "warc-records")
    said = ["payload_digest", "payload_bytes"]
    wanted = light.filter("record_type = 'revisit'").select("refers_to", *said).distinct()
    held = light.filter("record_type = 'response' and valid").select(F.col("page_id").alias("refers_to"), *said).distinct()
    broken = wanted.join(held, ["refers_to", *said], "left_anti").withColumn("broken", F.lit(True))
    rows = found.join(broken, ["refers_to", *said], "left")
    return rows.withColumn("valid", F.col("valid") & F.col("broken").isNull()).select(
        [n for n in names if n in found.columns])


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(manifest, keep_html=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= 100 group by d),
r as (select p.*, case when n >= 100 and page_id is distinct from first then first end refers_to from p left join f using (d))
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
       case when refers_to is null then 'response' else 'revisit' end record_type, refers_to, true valid from r
"""
QUERIES = {"op13_warc": (op13_warc, SQL)}
