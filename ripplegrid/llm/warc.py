"""Zstandard archives of WARC records: a dictionary in the leading skippable frame, then one frame per record.

Archives are written and read by Spark's own text and binary file sources, so any store that Spark knows
will do. Records are rows of raw bytes; the row separator is an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

DICTIONARY, FRAME, EMPTY = 0x184D2A5D, 0xFD2FB528, "P*M\x18\0\0\0\0"
#: The dictionary is trained on so many pages' first characters; it bears on the archives' size alone.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 20_000, 32 << 10
#: Bytes of an archive; a longer record has an archive of its own.
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: raw content serves as well
        return b"".join(samples)[: DICTIONARY_BYTES >> 1]


def skippable(data: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, whole frame or, of a skippable frame, its content) of each frame, found by walking headers and blocks."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError(f"{len(view) - at} stray bytes at {at}")
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & ~0xF == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            begin, end = at + 8, at + 8 + size
        elif magic == FRAME:
            begin, about = at, view[at + 4]
            single, sized = about >> 5 & 1, about >> 6
            end = at + 5 + (not single) + (0, 1, 2, 4)[about & 3] + ((1 if single else 0) if not sized else 1 << sized)
            last = 0
            while not last:
                if end + 3 > len(view):
                    raise ValueError(f"frame at {at} is cut short")
                block = int.from_bytes(view[end : end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                if kind == 3:
                    raise ValueError(f"frame at {at} has a block of reserved type")
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * (about >> 2 & 1)
        else:
            raise ValueError(f"no frame at {at}: {magic:#x}")
        if end > len(view):
            raise ValueError(f"frame at {at} is cut short")
        yield magic, bytes(view[begin:end])
        at = end


def record(kind: str, ident: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; ValueError if a header, length or digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC header")
    fields = _fields(lines)
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"header lacks {', '.join(sorted(lacking))}")
    block, size = rest[:-4], fields["content-length"]
    if not size.isdigit() or int(size) != len(block) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's")
    if fields.get("warc-block-digest", d := f"sha1:{base32_sha1(block)}") != d:
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = _fields(http.split(b"\r\n")[1:])
    if fields["warc-type"] == "response":
        if told.get("content-length", str(len(payload))) != str(len(payload)):
            raise ValueError("the payload's length differs")
        if fields.get("warc-payload-digest", d := f"sha1:{base32_sha1(payload)}") != d:
            raise ValueError("the payload's digest differs")
    return fields, told, payload


def classified(pages: DataFrame, least_bytes: int, key: str, html: str) -> DataFrame:
    """(key, digest, refers_to): refers_to is null for a response. No payload is moved; hot digests meet only in a pre-aggregated maximum."""
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    light = pages.select(F.col(key), F.sha1(text.cast("binary")).alias("digest"), (F.octet_length(text) >= least_bytes).alias("shared"))
    top = light.filter("shared").groupBy("digest").agg(F.max(key).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = light.join(top, "digest", "left")
    return found.select(key, "digest", F.when(~F.col(key).eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")).dropDuplicates([key, "digest"])


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record per row of pages: html in UTF-8 as payload (null: empty).

    Of records with equal payloads of least_bytes or more, that with the largest key is the response and the
    others revisit it; smaller payloads are all responses. Rows that repeat the largest key are responses
    too, and so are all of a group without any key. An archive has at most archive_bytes, or one record more; a
    partition makes as many as it needs, each with the dictionary in its first frame. No rows give no archive.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    sample = [r[0].encode() for r in pages.select(F.substring(text, 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()]
    head = spark.sparkContext.broadcast(train_dictionary(sample))
    kinds = classified(pages, least_bytes, key, html).withColumnRenamed(key, "k").withColumnRenamed("digest", "d")
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    joined = rows.join(kinds, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))).select(F.col("key").cast("string"), "url", "html", F.col("refers_to").cast("string"))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        packer, first, held, size = None, b"", [], 0
        for batch in batches:
            if len(batch) and packer is None:
                packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(head.value), write_checksum=True)
                first = skippable(head.value)
            for ident, uri, body, to in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in batch.columns), strict=True):
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
                frame = packer.compress(record("response" if to is None else "revisit", ident or "", uri, date, body.encode(), to))
                if held and size + len(frame) > archive_bytes:
                    yield pd.DataFrame({"archive": [first + b"".join(held)]})
                    held, size = [], 0
                held.append(frame)
                size += len(frame)
        if held:
            yield pd.DataFrame({"archive": [first + b"".join(held)]})

    # A row is a whole archive, and each has a file of its own.
    archives = joined.mapInPandas(work, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str, *, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row per record of the archives under path: archive, record_type, record_id, target_uri, payload_bytes, payload_digest, refers_to, problem (, payload).

    Each archive's dictionary is loaded from its leading skippable frame, each record decoded from a frame of
    its own, its headers, lengths and digests checked. strict: a faulty record or archive raises; else it is a
    row with a problem, and what follows a damaged frame in the archive is not read. A dictionary frame elsewhere than
    in front is passed over. A task holds one archive at a time, of at most 2 GB, Spark's bound for a binary value.
    """

    def rows(content: bytes) -> Iterator[dict]:
        import zstandard

        decoder = zstandard.ZstdDecompressor()
        try:
            for place, (magic, data) in enumerate(frames(content)):
                if magic == DICTIONARY and not place:
                    known = zstandard.ZstdDecompressor().decompress(data) if data[:4] == struct.pack("<I", FRAME) else data
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
                if magic != FRAME:
                    continue
                try:
                    fields, told, payload = parse(decoder.decompressobj().decompress(data))
                    size = int(told["content-length"]) if "content-length" in told else len(payload)
                    yield {
                        "record_type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size,
                        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "problem": None, "payload": payload,
                    }
                except (ValueError, UnicodeDecodeError, zstandard.ZstdError) as e:
                    if strict:
                        raise
                    yield {"problem": str(e)}
        except ValueError as e:
            if strict:
                raise
            yield {"problem": str(e)}

    columns = ["archive", "record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "problem"] + ["payload"] * payloads

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held: list[dict] = []
                size = 0
                for row in rows(content):
                    held.append(row | {"archive": name})
                    size += len(row.get("payload") or b"") if payloads else 64
                    if len(held) >= 1024 or size > 1 << 22:
                        yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})

    schema = "archive string, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, problem string" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, schema)


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 0, key: str = "page_id", path: str | None = None) -> DataFrame:
    """Writes pages as archives, reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from the archives alone."""
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archives(pages, path, least_bytes=least_bytes, key=key)
    kind = pages.schema[key].dataType.simpleString()
    ident = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') AS {kind})")
    return read_archives(spark, path).select(ident("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))
