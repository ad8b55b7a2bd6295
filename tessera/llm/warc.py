"""WARC archives: writing captures, reading records, and assembling them into transactions.

Each row becomes a request, a response (or a revisit) and a metadata record, in gzip members of their own, tied by
WARC-Concurrent-To. A payload of at least ``revisit_bytes`` bytes that other rows have too is stored once, in the
response of the smallest id; the others become revisit records that refer to it.

Reading needs no order and no neighbourhood: records are read from byte ranges of all files, and a transaction is put
together by joining on identifiers. A request or metadata record belongs to a response or revisit if one of the two
names the other in WARC-Concurrent-To, or through a chain of records that do. One nested row per capture comes out, with
all its requests and metadata records in the order of their ids. Archives from elsewhere are read by whole files
(`archives`); digests and lengths are those of payloads without their HTTP transfer and content codings.

Tasks write files under new names and return their byte ranges; Spark's commit of that manifest decides which count.

Defined results: a null payload is empty; a null URL leaves the header out; of rows with equal id and payload one is
the response (that with the smallest content key); rows that are equal in id, URL and payload are numbered; null ids
rank last; an empty table gives archives without files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files, pretoken
from tessera.runtime import CHUNK, in_chunks, lookup_left, materialise, new_folder, pick, row_key, small_batches

REVISIT_BYTES = 100
RANGE_BYTES = 4 << 20
GZIP_LEVEL = 6
FEED = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, start long, end long, records long"
RECORDS = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, declared_digest string, fields map<string,string>, payload_bytes long, payload_digest string, block binary"
)


def record_urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def safe(url: str) -> str:
    """A URL without characters that would break a header line."""
    return "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(kind: str, urn: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def capture(own: tuple, url: str | None, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """Request, response or revisit, and metadata of one row. A row is named by its id, content key and number among equal rows."""
    row_id, urn = own[0], record_urn("capture", *own)
    to = [("WARC-Target-URI", safe(url))] if url is not None else []
    digests = [("WARC-Payload-Digest", f"sha256:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        main = record("response", urn, to + digests + kind, http + payload)
    else:
        main = record("revisit", urn, to + digests + [("WARC-Refers-To", record_urn("capture", *refers)), ("WARC-Profile", PROFILE)] + kind, http)
    m = re.match(r"[^:]*://([^/?#]*)([^#]*)", safe(url or ""))
    ask = f"GET {(m and m[2]) or '/'} HTTP/1.1\r\nHost: {m[1] if m else ''}\r\n\r\n".encode()
    with_ = [("WARC-Concurrent-To", urn)]
    request = record("request", record_urn("request", *own), to + with_ + [("Content-Type", "application/http; msgtype=request")], ask)
    fields = (f"row-id: {row_id}\r\n" if row_id is not None else "") + f"payload-length: {len(payload)}\r\n"
    metadata = record("metadata", record_urn("metadata", *own), to + with_ + [("Content-Type", "application/warc-fields")], fields.encode())
    return request + main + metadata


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write archives of ``df``; returns the manifest: file, start, end, records.

    Rows are known by their content (`runtime.row_key` of id, URL and payload digest), never by where they are read, so
    the plan made in a first reading fits the second one however that one is split.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    k1, k2 = row_key(rows, ["id", "url", "sha"])
    rows = rows.withColumn("k1", k1).withColumn("k2", k2)
    keyed = rows.groupBy("k1", "k2").agg(
        F.first("id").alias("id"), F.first("sha").alias("sha"), F.max(F.octet_length("payload") >= revisit_bytes).alias("large"), F.count(F.lit(1)).alias("times")
    )
    keyed = materialise(keyed, "warc-keys")
    total, most = keyed.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    groups = keyed.where("large").groupBy("sha").agg(first.alias("keep"), F.sum("times").alias("n")).where("n > 1")
    groups = materialise(groups.select("sha", *[F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("id", "k1", "k2")], "n"), "warc-groups")
    plan = materialise(lookup_left(keyed, groups, "sha", "n", total, F.col("k1")).drop("id", "large", "n"), "warc-plan")
    plan = pick(rows.drop("sha"), plan, ["k1", "k2"], "times", total)
    plan = in_chunks(plan, "times", "from", most).select("id", "url", "payload", "k1", "k2", "sha", "keep_id", "keep_k1", "keep_k2", "times", "from")

    def run(batches):
        part, out, at, start, n = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            raw, offsets = pretoken.utf8_of(batch.column(2))
            ids, urls, k1s, k2s, shas, keep_ids, keep_1s, keep_2s, times, froms = (batch.column(k).to_pylist() for k in (0, 1, *range(3, 11)))
            done = []
            for k in range(len(ids)):
                if out is None:
                    out, name = files.new_file(folder, part, ".warc.gz")
                body = raw[offsets[k] : offsets[k + 1]].tobytes()
                keeper = None if keep_1s[k] is None else (keep_ids[k], keep_1s[k], keep_2s[k], 0)
                for copy in range(froms[k], min(times[k], froms[k] + CHUNK)):
                    own = (ids[k], k1s[k], k2s[k], copy)
                    at += out.write(capture(own, urls[k], body, shas[k], None if own == keeper else keeper))
                    n += 3
                    if at - start >= RANGE_BYTES:
                        done.append((name, start, at, n))
                        start, n = at, 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["file", "start", "end", "records"])
        if out is not None:
            out.close()
            if n:
                yield pa.RecordBatch.from_pylist([{"file": name, "start": start, "end": at, "records": n}])

    plan.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def archives(spark, paths: str | list[str]) -> DataFrame:
    """A manifest of archives from elsewhere: one range for each file, since only reading finds where its members begin.

    ``paths`` are files or folders (all files below); their names must be reachable from every executor.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(None).cast("long").alias("records"))


def members(source, end: int | None = None) -> Iterator[bytes]:
    """Contents of the gzip members in bytes, or in a stream up to ``end``. Input is read in pieces, so a member, not a file, is in memory."""
    source = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
    held = b""
    while True:
        held = held or source.read(FEED if end is None else min(FEED, end - source.tell()))
        if not held:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not held:
                held = source.read(FEED if end is None else min(FEED, end - source.tell()))
                if not held:
                    raise ValueError("archive is cut short")
            out.append(z.decompress(held))
            held = z.unused_data
        yield b"".join(out)


def decoded(head: bytes, body: bytes) -> bytes:
    """An HTTP payload without its transfer and content codings (chunked; gzip, deflate). Unknown or broken ones stay as they are."""
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields.setdefault(k.strip().lower(), v.strip().lower())
    try:
        if "chunked" in fields.get("transfer-encoding", ""):
            out, p = [], 0
            while True:
                stop = body.index(b"\r\n", p)
                n = int(body[p:stop].split(b";")[0], 16)
                if n == 0:
                    break
                out.append(body[stop + 2 : stop + 2 + n])
                p = stop + 4 + n
            body = b"".join(out)
        for coding in reversed([c.strip() for c in fields.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 47)
            elif coding == "deflate":
                body = zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
    except (ValueError, zlib.error):
        pass
    return body


def parse(data: bytes, with_block: bool) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {data[:40]!r}")
    pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    one = dict(pairs)
    block = rest[: int(one["content-length"])]
    kind = one.get("content-type", "")
    top, _, rest = block.partition(b"\r\n\r\n")
    payload = decoded(top, rest) if kind.startswith("application/http") else block
    fields = [x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x] if kind == "application/warc-fields" else []
    return {
        "record_id": one["warc-record-id"],
        "type": one["warc-type"],
        "target_uri": one.get("warc-target-uri"),
        "date": one.get("warc-date"),
        "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"],
        "refers_to": one.get("warc-refers-to"),
        "content_type": kind or None,
        "declared_digest": one.get("warc-payload-digest"),
        "fields": [(k.strip().lower(), v.strip()) for k, _, v in fields],
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
        "block": block if with_block else None,
    }


ARROW = pa.schema(
    [
        *[(c, pa.string()) for c in ("record_id", "type", "target_uri", "date")],
        ("concurrent_to", pa.list_(pa.string())),
        *[(c, pa.string()) for c in ("refers_to", "content_type", "declared_digest")],
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("block", pa.binary()),
    ]
)


def read(manifest: DataFrame, with_block: bool = True) -> DataFrame:
    """One row per record. Digest and length of payloads are taken from the bytes read, also if blocks are left out."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                with files.open_at(r["file"], r["start"]) as f:
                    for data in members(f, r["end"]):
                        rows.append(parse(data, with_block))
                        size += len(data)
                        if size > RANGE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return manifest.repartition(n, "file", "start").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, type, response, requests, metadata (arrays by record id), n_requests, n_metadata.

    Chains of concurrent-to links are followed until no record is added; a record belongs to the captures that are the
    fewest links away. Links are followed in either direction. ``records`` is read several times; hand it over materialised.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    captures = records.where(main).dropDuplicates(["record_id"])
    ties = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    ties = ties.union(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    heads = captures.select(F.col("record_id").alias("capture_id"))
    rest = records.where(~main).select("record_id")
    ties = materialise(ties.join(rest, ties["a"] == rest["record_id"], "left_semi"), "warc-ties")
    near = materialise(ties.join(heads, ties["b"] == heads["capture_id"]).select("a", "capture_id").distinct(), "warc-belongs")
    belongs, free = near, ties.join(near.select("a"), "a", "left_anti")
    while not free.isEmpty():
        through = near.select(F.col("a").alias("via"), "capture_id")
        near = materialise(free.join(through, free["b"] == through["via"]).select("a", "capture_id").distinct(), "warc-belongs")
        if near.isEmpty():
            break
        belongs, free = belongs.union(near), free.join(near.select("a"), "a", "left_anti")
    others = records.where(~main).dropDuplicates(["record_id"]).select("record_id", F.col("type").alias("_t"), F.struct(*records.columns).alias("_r"))
    found = belongs.join(others, belongs["a"] == others["record_id"])
    order = lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)
    nested = lambda t: F.array_sort(F.collect_list(F.when(F.col("_t") == t, F.col("_r"))), order)
    grouped = found.groupBy("capture_id").agg(nested("request").alias("requests"), nested("metadata").alias("metadata"))
    out = captures.select(F.col("record_id").alias("capture_id"), "type", F.struct(*records.columns).alias("response"))
    out = out.join(grouped, "capture_id", "left")
    many = [F.coalesce(F.col(c), F.array().cast(grouped.schema[c].dataType)).alias(c) for c in ("requests", "metadata")]
    out = out.select("capture_id", "type", "response", *many)
    return out.select("*", F.size("requests").cast("long").alias("n_requests"), F.size("metadata").cast("long").alias("n_metadata"))


def resolve(captures: DataFrame, id_field: str = "row-id") -> DataFrame:
    """Digest columns of each capture, those of a revisit from the response it refers to.

    row_id, payload_bytes, payload_digest, record_type, refers_to, n_requests, n_metadata, digest_ok.
    """
    flat = captures.select(
        "capture_id",
        F.get("metadata", 0)["fields"][id_field].cast("long").alias("row_id"),
        F.col("type").alias("record_type"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.substring_index("response.declared_digest", ":", -1).alias("declared"),
        F.col("response.refers_to").alias("target"),
        "n_requests",
        "n_metadata",
    )
    flat = materialise(flat, "warc-captures")
    wanted = flat.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    stored = flat.where("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("row_id").alias("_row"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    stored = materialise(stored.join(wanted, "target"), "warc-stored")
    full = lookup_left(flat, stored, "target", "_n", flat.count(), F.col("capture_id"))
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("_digest")).otherwise(F.col("payload_digest"))
    return full.select(
        "row_id",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("_row")).alias("refers_to"),
        "n_requests",
        "n_metadata",
        (digest == F.col("declared")).alias("digest_ok"),
    )
