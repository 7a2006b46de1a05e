"""WARC archives: writing, normalising monolithic gzip files, reading back by offset.

Writers stream each partition's records through one gzip stream per file. The normaliser inflates such a file once,
rewrites every record as a gzip member of its own and writes a sidecar index of (offset, length) beside it, so that any
record can be read alone. Records of equal payloads of at least `least` bytes are stored once: the row with the
smallest page_id is the response, the others are revisits of it.

Files lie in one folder that all executors reach; names carry the task attempt, and only files that a stored manifest
lists are read, so a lost or repeated task leaves no trace in the result.

Edge cases: null html is an empty payload; rows with a null page_id are archived, revisit others, and are never the
response that others name; rows that share page_id and payload stand as equal responses; a null url is left out; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import only, scratch, sized, stored, table

CRLF = b"\r\n"
MANIFEST = "archive string, records bigint"
INDEX = "archive string, sidecar string, records bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, offset bigint, length bigint"


def _store(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _urn(page_id, salt: str) -> str:
    import uuid

    name = f"page:{page_id}" if page_id is not None else f"row:{salt}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def page_record(page_id, url, payload: bytes, digest: str, refers_to, salt: str, date: str) -> bytes:
    revisit = refers_to is not None
    at = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id, salt)), ("WARC-Date", date), ("WARC-Target-URI", at), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-ID", page_id)]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, "")), ("X-Refers-To-Page", refers_to)]
    return record([*fields, ("Content-Type", "text/html; charset=utf-8")], b"" if revisit else payload)


def decided(pages: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """Pages with payload, digest and the page that each one revisits (null: it is a response)."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    digests = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    firsts = stored(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    few = sized(firsts, 200_000)
    if few is not firsts:
        both = rows.join(few, "digest", "left")
    else:  # payloads are dealt by digest and a salt, so that the copies of one page do not meet in one task
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        both = rows.join(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"], "left")
    return both.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_monoliths(rows: DataFrame, folder: str, roll: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows as whole-file gzip streams, a new file after `roll` bytes; the stored manifest names them."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        task, made = TaskContext.get(), []
        out = packer = None
        size = count = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(packer.flush())
                out.close()
                made.append((name, count))
            out = None

        for b in batches:
            for n, (page_id, url, payload, digest, refers_to) in enumerate(zip(*(b.column(i) for i in range(5)))):
                if out is None:
                    name, size, count = f"{base}/p{task.partitionId():06d}-a{task.taskAttemptId()}-{len(made):04d}.warc.gz", 0, 0
                    out, packer = fs.open_output_stream(name, compression=None), zlib.compressobj(6, wbits=31)
                    out.write(packer.compress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(None, name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: gridflux\r\n")))
                rec = page_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), f"{name}:{count}", date)
                out.write(packer.compress(rec))
                size, count = size + len(rec), count + 1
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip stream of one or more members, each with its header and closing blank lines; memory is bounded by a chunk and a record."""
    inflate, held, ended, rest = zlib.decompressobj(wbits=31), bytearray(), False, b""

    def more() -> None:
        """Inflate at most a chunk further."""
        nonlocal inflate, ended, rest
        rest = rest or stream.read(chunk)
        if not rest:
            held.extend(inflate.flush())
            ended = True
            return
        held.extend(inflate.decompress(rest, chunk))
        rest = inflate.unconsumed_tail
        if inflate.eof:
            rest, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)

    while True:
        while (end := held.find(CRLF * 2)) < 0 and not ended:
            more()
        if end < 0:
            if held.strip():
                raise ValueError("archive ends inside a record header")
            return
        length = next(int(x.split(b":", 1)[1]) for x in bytes(held[:end]).split(CRLF) if x.lower().startswith(b"content-length:"))
        total = end + 4 + length + 4
        while len(held) < total and not ended:
            more()
        if len(held) < total:
            raise ValueError("archive ends inside a record")
        yield bytes(held[:total])
        del held[:total]


def parsed(rec: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = rec.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite every listed monolith with one gzip member per record and a sidecar index; the stored result names both."""

    def run(batches):
        import json

        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        made = []
        for b in batches:
            for source in b.column(0).to_pylist():
                stem = f"{base}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-n{TaskContext.get().taskAttemptId()}"
                at = count = 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(f"{stem}.warc.gz", compression=None) as out, fs.open_output_stream(f"{stem}.idx", compression=None) as side:
                    for rec in records_of(stream):
                        packer = zlib.compressobj(6, wbits=31)
                        member = packer.compress(rec) + packer.flush()
                        out.write(member)
                        fields = parsed(rec)[0]
                        if fields["WARC-Type"] != "warcinfo":
                            side.write(json.dumps({"id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "offset": at, "length": len(member)}).encode() + b"\n")
                            count += 1
                        at += len(member)
                made.append((f"{stem}.warc.gz", f"{stem}.idx", count))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["archive", "sidecar", "records"])

    return stored(_one_per_task(manifest).mapInArrow(run, INDEX), "index")


def _one_per_task(files: DataFrame) -> DataFrame:
    n = max(1, min(files.count(), 100_000))
    return files.repartition(n)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives, read alone by its offset; a response's payload must have its stated digest."""

    def run(batches):
        import hashlib
        import json

        import pyarrow as pa

        fs, _ = _store(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORDS.split(", ")]
        for b in batches:
            for archive, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with fs.open_input_stream(sidecar, compression=None) as s:
                    entries = [json.loads(x) for x in s.read().splitlines()]
                with fs.open_input_file(archive) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        fields, block = parsed(zlib.decompress(f.read(e["length"]), wbits=31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{archive}: payload at {e['offset']} doesn't have its digest")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023,E731
                        rows.append((number("X-Page-ID"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page"), fields.get("WARC-Target-URI"), archive, e["offset"], e["length"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _one_per_task(index).mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write, normalise and read back; returns the records with their places."""
    manifest = write_monoliths(decided(only(pages, "page_id", "url", "html"), least), f"{folder}/mono")
    return read_back(normalise(manifest, f"{folder}/members"), f"{folder}/members")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = archive(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
