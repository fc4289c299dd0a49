"""WARC archives of pages, and a salvage reader for them.

Writing: of the pages with equal payloads the one with the largest id becomes a response, the others
become revisits of it. Each record is a gzip member of its own; a task writes archives of about
`roll` bytes each, under names that hold its attempt, and lists those it finished, so a
repeated or speculative task leaves no record twice.

Reading: archives are read a window at a time. A gzip member is inflated piece by piece and its text is
read record by record, so a member may hold any number of records; each is checked (version
line, header of at most HEADER bytes, lengths, block and payload digests) and kept if it fits, whatever becomes of the
rest of its member. After a failed check the reader looks for the next version line in the text
that is left, or, where the text itself ends too soon (damaged or cut-off data), for the next gzip magic or version line in
the archive, goes on there, and logs the bytes between as a gap: `at` and `length` are the stretch of the archive (the
last row of a member has its bytes, the others none), `inside` and `span` the stretch of the text of the member that begins at `member`. A record
without a block digest is taken from a member only if the member's own checksum holds. Memory is
bounded by the largest record, which is `most` bytes at most: a record that states more is a gap, and a false length of a
plain record is found by looking at its stated end before anything is read.

Defined cases: a null html is an empty payload; a null url is left out; a null page id is never a
target and never revisits; repeated rows of one id and payload are all responses if the id is the
largest; empty tables give no archives and no records; control characters in a url are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.common import cut
from eligo.sources.tables import fresh_path

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
ROLL = 32 << 20
WINDOW = 1 << 20
PIECE = 1 << 20
HEADER = 1 << 16
MOST = 512 << 20
RECORD = "path string, at long, length long, kind string, member long, inside long, span long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, why string"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    head += [("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of fixed header, so that reruns give equal bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses). Payloads under `least` bytes never revisit."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    heads = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("head"))
    return rows.join(heads, ["sha", "n"], "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to"))


def write(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write planned rows as archives under a folder that all tasks share: a row (path, records, bytes) per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, path, n, size, made = TaskContext.get(), None, "", 0, 0, 0
        for b in batches:
            for page_id, url, payload, refers in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                if out is None:
                    path, n, size = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    made += 1
                data = member(record(None if pd.isna(page_id) else int(page_id), url, payload, None if pd.isna(refers) else int(refers)))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    typed = rows.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))  # ids keep all digits beside nulls
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    done = typed.mapInPandas(run, "path string, records long, bytes long")
    return done.withColumn("path", F.concat(F.lit(scheme), "path"))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def _head(need, most: int) -> tuple[dict[str, str], int, int]:
    """Header fields, where the block begins and where the record ends; need(n) gives at least the first n bytes, or all there are."""
    data = need(10)
    if not re.match(rb"WARC/1\.[01]\r\n", data[:10]):
        raise ValueError("no version line")
    n, end = 1024, -1
    while end < 0:
        data = need(n)
        end = data.find(b"\r\n\r\n", 0, HEADER)
        if end < 0 and (len(data) < n or n >= HEADER):
            raise ValueError("header has no end")
        n *= 2
    fields = _fields(bytes(data[:end]))
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or int(length) > most:
        raise ValueError("content length")
    return fields, end + 4, end + 4 + int(length) + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """A record's fields once its digests fit. ValueError if not."""
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said != f"sha1:{digest(block)}":
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and stated and digest(payload) != stated:
        raise ValueError("payload digest")
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    out = {"page_id": number(fields.get("warc-record-id")), "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload_digest": stated or None}
    return out | {"payload_bytes": int(size[1]) if size else len(payload), "payload": payload if kind == "response" else None}


class _Inflater:
    """The text of one gzip member, piece by piece. After its last piece, `error` says what is wrong with it, if anything."""

    def __init__(self, read, at: int, window: int):
        self.read, self.window, self.error, self.done = read, window, None, False
        self.z, self.crc, self.size = zlib.decompressobj(-15), 0, 0
        self.fed = at + self._header(at)  # archive bytes before this place have been taken in

    def _header(self, at: int) -> int:
        """Length of the member's header."""
        data = self.read(at, 1 << 16)
        if len(data) < 10:
            raise ValueError("member is cut short")
        flags, n = data[3], 10
        if flags & 4:
            n += 2 + int.from_bytes(data[10:12], "little")
        for bit in (8, 16):
            if flags & bit:
                n = data.find(b"\0", n) + 1
                if not n:
                    raise ValueError("member header")
        return n + 2 * bool(flags & 2)

    def next(self) -> bytes:
        while not self.done:
            data = self.read(self.fed, self.window)
            if not data:
                self.error, self.done = "member is cut short", True
                break
            before, out = self.z.copy(), b""
            try:
                out = self.z.decompress(data, PIECE)
                used = len(data) - len(self.z.unconsumed_tail) - len(self.z.unused_data)
            except zlib.error as e:
                out, used = self._last(before, data)
                self.error, self.done = f"inflate: {e}", True
            self.fed += used
            self.crc, self.size = zlib.crc32(out, self.crc), self.size + len(out)
            if self.z.eof and not self.done:
                self.done, tail = True, self.read(self.fed, 8)
                if tail != self.crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little"):
                    self.error = "member checksum"
                self.fed += len(tail)
            if out:
                return out
        return b""

    @staticmethod
    def _last(z, data: bytes) -> tuple[bytes, int]:
        """What comes out before the byte that does not fit."""
        out, at = [], 0
        for step in (4096, 64, 1):
            while at < len(data):
                kept = z.copy()
                try:
                    out.append(z.decompress(data[at : at + step]))
                except zlib.error:
                    z = kept
                    break
                at += step
        return b"".join(out), min(at, len(data))


def _member(read, at: int, window: int, most: int) -> Iterator[dict]:
    """Records and gaps within the text of one gzip member. The last row has kind "end"; its `stop` is null if the member's end is not known."""
    text, base, gap, why, safe = bytearray(), 0, None, "", at + 1
    inflater, sound = _Inflater(read, at, window), None
    before = mark = inflater.fed

    def need(n: int) -> bytearray:
        nonlocal before, mark
        while len(text) < n and (piece := inflater.next()):
            text.extend(piece)
            before, mark = mark, inflater.fed
        return text

    def whole() -> bool:
        """Does the member's own checksum hold? Asked only for records that carry no digest."""
        nonlocal sound
        if sound is None:
            other = _Inflater(read, at, window)
            while other.next():
                pass
            sound = other.error is None
        return sound

    while need(1):
        try:
            fields, start, stop = _head(need, most)
            if len(need(stop)) < stop:
                raise ValueError("record is cut short")
            if text[stop - 4 : stop] != b"\r\n\r\n":
                raise ValueError("record end")
            found = _checked(fields, bytes(text[start : stop - 4]))
            if "warc-block-digest" not in fields and not whole():
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            gap, why = (base, str(e)) if gap is None else (gap, why)
            look = 1
            while (hit := text.find(b"WARC/1.", look)) < 0 and len(need(len(text) + 1)) > (keep := max(look, len(text) - 6)) + 6:
                look = keep
                del text[: look - 1]
                base, look = base + look - 1, 1
            step = hit if hit >= 0 else len(text)
        else:
            if gap is not None:
                yield {"kind": "gap", "inside": gap, "span": base - gap, "why": why}
                gap = None
            yield found | {"kind": "record", "inside": base, "span": stop}
            safe, step = max(safe, before), stop  # bytes before `safe` made a record that fits, so no other member begins there
        del text[:step]
        base += step
    if gap is not None:
        yield {"kind": "gap", "inside": gap, "span": base - gap, "why": why}
    if not base and not inflater.error:
        inflater.error = "empty member"
    # a member that ends with a whole record, or ends in order, ends where it says
    known = not inflater.error or gap is None and base and inflater.error == "member checksum"
    yield {"kind": "end", "stop": inflater.fed if known else None, "why": inflater.error, "safe": safe}


def _plain(read, at: int, size: int, most: int) -> tuple[dict, int]:
    """The plain record at a place, and where it ends. Its end is looked at before its block is read, so a false length costs nothing."""
    data = b""

    def need(n: int) -> bytes:
        nonlocal data
        if len(data) < n:
            data = read(at, n)
        return data

    fields, start, stop = _head(need, most)
    if at + stop > size:
        raise ValueError("record is cut short")
    if read(at + stop - 4, 4) != b"\r\n\r\n":
        raise ValueError("record end")
    return _checked(fields, read(at + start, stop - 4 - start)), at + stop


def salvage(read, size: int, window: int = WINDOW, most: int = MOST) -> Iterator[dict]:
    """Records and gaps of one archive; read(at, n) gives bytes. Every byte belongs to the stretch (at, length) of one row."""

    def after(look: int) -> int:
        """The next place where a member or a record may begin."""
        while look < size:
            data = read(look, window)
            if hit := NEXT.search(data):
                return look + hit.start()
            look += max(1, len(data) - 9) if look + len(data) < size else len(data)
        return size

    at = 0
    while at < size:
        if read(at, 3) != MAGIC:
            try:
                found, stop = _plain(read, at, size, most)
                yield found | {"at": at, "length": stop - at, "kind": "record", "span": stop - at}
            except ValueError as e:
                stop = after(at + 1)
                yield {"at": at, "length": stop - at, "kind": "gap", "why": str(e)}
            at = stop
            continue
        last, place = None, at
        try:
            for row in _member(read, at, window, most):
                if row["kind"] != "end":
                    if last:
                        yield last | {"at": at, "length": 0, "member": at}
                    last = row
                    continue
                stop = row["stop"] or after(row["safe"])
                lost = {"kind": "gap", "why": row["why"]}
                if last and row["why"] and last["kind"] == "record":  # what follows the last record is lost
                    place = min(row["safe"], stop) if row["stop"] is None else stop
                    yield last | {"at": at, "length": place - at, "member": at}
                    last = lost
                yield (last or lost) | {"at": place, "length": stop - place, "member": at}
        except ValueError as e:
            stop = after(at + 1)
            yield {"at": at, "length": stop - at, "kind": "gap", "why": str(e), "member": at}
        at = stop


def read(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (column kind) of the archives named in `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [f.split()[0] for f in RECORD.split(", ")]
        frame = lambda rows: pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
        for b in batches:
            for path in b["path"]:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    some, held = [], 0
                    for r in salvage(lambda at, n, f=f: (f.seek(at), f.read(n))[1], f.size()):
                        held += len(r.get("payload") or b"")
                        some.append(r | {"path": path} | ({} if payloads else {"payload": None}))
                        if len(some) >= 2000 or payloads and held > 16 << 20:
                            yield frame(some)
                            some, held = [], 0
                    if some:
                        yield frame(some)

    return paths.select("path").mapInPandas(run, RECORD)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to new archives in the shared folder and give the archives' list, a row each; they are deleted when the driver ends."""
    spark: SparkSession = pages.sparkSession
    return cut(write(planned(pages, least), fresh_path(spark, "warc")), "archives")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages as their archives tell of them: page_id, payload_bytes, payload_digest, record_type, refers_to. A gap in an archive fails the query."""
    listed = archive(pages, least)
    # an explicit number: archives are large and their list is tiny, so Spark would read all in one task
    got = read(listed.repartition(max(1, min(listed.count(), 50_000))), payloads=False)
    lost = F.raise_error(F.format_string("%s: %s bytes at %s are lost: %s", "path", "length", "at", "why")).cast("boolean")
    got = got.where(F.when(F.col("kind") == "record", True).otherwise(lost))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
