"""WARC files, one gzip member a record: a distributed writer and a splittable reader.

The writer lets Spark's text writer put down each record's bytes, so its commit protocol covers lost tasks and any file
system of Spark works. The last byte of a gzip member is the top byte of its length, zero below 16 MiB; it is left off
and written as the line separator. A longer record is followed by an empty member, which ends in a zero byte too.

The reader lets Spark's line reader scan byte ranges for the gzip magic: a row is what lies between two magics, owned by
the range in which it starts. Compressed data can hold the magic by chance, so a row starts a record only if a
member begins there and its first bytes decode to a WARC header; other rows continue the record before. Rows that
continue a record of an earlier range are few, and are put together by a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraseg.llm.common import arrow_limits, written

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
#: Payloads that more than one in so many repeats share are broadcast: at most so many.
HOT_PAYLOADS = 1000
#: Files named ``.gz`` are read as they are, in ranges. The line reader takes the codec whose reversed ending sorts last before
#: the reversed name: this one, which sorts after ``.gz``. Names do not end in it, so no codec applies and the file is cut; one
#: that did would be read as it is, too, but in one piece.
NO_ENDING = ".!.gz"
AS_THEY_ARE = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": NO_ENDING,
    # The same setting as the client libraries that come with Spark name it.
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": NO_ENDING,
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary, error string"
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def with_revisits(pages: DataFrame, *, id_col: str, payload_col: str, least_bytes: int = 1000) -> DataFrame:
    """``pages`` with ``payload`` (never null), ``payload_digest`` (hex SHA-1), ``record_type`` and ``refers_to``.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest id is the response, the others revisit
    it. Rows that repeat both id and payload are alike. Null ids are smallest. Payloads are equal if their SHA-1 is.
    Other columns are kept; those with the names of the new ones are replaced.

    Payloads move by digest. Those that more than a thousandth of all repeats share (a thousand at most, so they are
    broadcast) and those too short to be revisited are dealt out by id instead.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    first = written(
        rows.filter(large).groupBy("payload_digest").agg(F.max(id_col).alias("__original"), F.count("*").alias("__copies"))
        .filter("__copies > 1").withColumnRenamed("payload_digest", "__digest")
    )
    repeats = first.agg(F.sum("__copies")).first()[0] or 0
    hot = first.filter(F.col("__copies") * HOT_PAYLOADS > repeats).select(F.col("__digest").alias("__hot_digest"), F.col("__original").alias("__hot_original"))
    marked = rows.join(F.broadcast(hot), large & (F.col("payload_digest") == F.col("__hot_digest")), "left")
    alone = F.concat(F.lit("alone "), F.xxhash64(id_col).cast("string"))
    marked = marked.withColumn("__key", F.when(large & F.col("__hot_digest").isNull(), F.col("payload_digest")).otherwise(alone))
    joined = marked.join(first, F.col("__key") == F.col("__digest"), "left")
    original = F.coalesce("__hot_original", "__original")
    again = large & original.isNotNull() & ~original.eqNullSafe(F.col(id_col))
    return joined.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, original),
    }).drop("__original", "__hot_original", "__hot_digest", "__copies", "__digest", "__key")


def _clean(value) -> str:
    return "" if value is None else " ".join(str(value).split())


def _record(row: dict) -> bytes:
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [
        "WARC/1.0", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {_clean(row['date']) or DATE}",
        f"WARC-Target-URI: {_clean(row['target_uri'])}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {REVISIT}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    member = gzip.compress(data, 6, mtime=0)
    return (member if not member[-1] else member + gzip.compress(b"", mtime=0))[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield pa.RecordBatch.from_arrays([pa.array([_record(r) for r in batch.slice(at, 256).to_pylist()], pa.binary())], ["member"])


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``record_id, record_type, target_uri, date, payload_digest, refers_to, payload`` rows; one file a partition.

    Null payloads are empty, null texts too, a null date is the epoch; other columns are ignored. No rows, no records.
    """
    arrow_limits(records.sparkSession)
    names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload"]
    members = records.select(names).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _begins(piece: bytes) -> bool:
    """Whether a member starts here and decodes to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(piece, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _parsed(member: bytes) -> dict:
    row = dict.fromkeys(_FIELDS)
    try:
        engine = zlib.decompressobj(31)
        data = engine.decompress(member)
        if not engine.eof:
            raise ValueError("the member is cut off")
        head, _, rest = data.partition(b"\r\n\r\n")
        named = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            named[key.strip().lower()] = value.strip()
        bare = lambda key: named[key].strip("<>") if key in named else None
        row |= {"record_id": bare("warc-record-id"), "record_type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "refers_to": bare("warc-refers-to")}
        block = rest[: int(named["content-length"])]
        if len(block) < int(named["content-length"]):
            raise ValueError("the block is shorter than its length")
        digest = named.get("warc-payload-digest", "")
        if digest.startswith("sha1:"):
            row["payload_digest"] = base64.b32decode(digest[5:]).hex()
        if "application/http" in named.get("content-type", ""):
            http, _, block = block.partition(b"\r\n\r\n")
            length = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            row["payload_bytes"] = int(length[0]) if length else len(block)
        else:
            row["payload_bytes"] = len(block)
        if row["record_type"] != "revisit":
            row |= {"payload": block, "payload_bytes": len(block)}
            if row["payload_digest"] not in (None, hashlib.sha1(block).hexdigest()):
                row["error"] = "the payload does not have its digest"
    except (zlib.error, ValueError, KeyError) as problem:
        row["error"] = str(problem)
    return row


def _batch(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r[n] for r in rows], _TYPES[k]) for n, k in (x.split() for x in RECORD.split(", "))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records; besides, pieces of records that may go on in, or come from, another range."""
    names = [*_FIELDS, "file", "range", "place", "opens", "piece"]
    spot, held, place = None, None, 0

    def out(records: list[dict], pieces: list[tuple]) -> pa.RecordBatch:
        rows = records + [dict.fromkeys(_FIELDS)] * len(pieces)
        more = [(None,) * 5] * len(records) + pieces
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([*_batch(rows), *(pa.array([x[i] for x in more], t) for i, t in enumerate(types))], names)

    def whole(member: bytes) -> bool:
        engine = zlib.decompressobj(31)
        try:
            engine.decompress(member)
        except zlib.error:
            return False
        return engine.eof

    for batch in batches:
        records, pieces = [], []
        for value, file, start in zip(*(batch.column(i) for i in range(3))):
            value, here = value.as_py(), (file.as_py(), start.as_py())
            if here != spot:
                if held is not None:
                    # The last record of a range: it may go on in the next.
                    if whole(held):
                        records.append(_parsed(held))
                    else:
                        pieces.append((*spot, place, True, held))
                spot, held, place = here, None, 0
            piece = MAGIC + value
            place += 1
            if _begins(piece):
                if held is not None:
                    records.append(_parsed(held))
                held = piece
            elif held is not None:
                held += piece
            elif place > 1 or start.as_py() > 0 or value:
                pieces.append((*spot, place, False, piece))
        if records or pieces:
            yield out(records, pieces)
    if held is not None:
        yield out([_parsed(held)], []) if whole(held) else out([], [(*spot, place, True, held)])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_parsed(b"".join(p["piece"] for p in pieces)) for pieces in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(_batch(rows), _FIELDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of gzip-member WARC files; ``error`` says what is wrong with a damaged one.

    Files named ``.gz`` are cut into ranges like all others.
    Revisits have no payload; their digest and length are those of the full one. Files without records give no rows;
    bytes before a file's first record are skipped.
    """
    arrow_limits(spark)
    lines = spark.read.options(**AS_THEY_ARE).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    rows = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))
    found = written(rows.mapInArrow(_scan, f"{RECORD}, file string, range long, place long, opens boolean, piece binary"))
    records = found.filter("file is null").select(*_FIELDS)
    # A piece belongs to the last record that was left open before it in its file.
    order = Window.partitionBy("file").orderBy("range", "place")
    pieces = found.filter("file is not null").withColumn("opened", F.max(F.when(F.col("opens"), F.struct("range", "place"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = (
        pieces.filter("opened is not null").groupBy("file", "opened")
        .agg(F.sort_array(F.collect_list(F.struct("range", "place", "piece"))).alias("pieces")).select("pieces")
        .mapInArrow(_join_pieces, RECORD)
    )
    return records.union(joined)
