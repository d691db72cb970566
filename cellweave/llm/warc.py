"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key. Each range of keys gives an archive file (one gzip member per record), an index
file (lines ``key json``, BLOCK_LINES to a gzip block) and a sparse directory (a line ``key offset length`` for each
block). A lookup finds the shards whose range of keys may hold a key, binary-searches their directories, reads blocks by
range, binary-searches these, and reads records by offset and length.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Files, shared_dir, shipped, written
from .url_filter import host_and_path

#: Fixed value: payloads below this many bytes are never deduplicated.
LEAST = 1000
BLOCK_LINES, LEVEL = 512, 6
#: Characters of a key that ranges of shards are told apart by, and shards that one lookup goes over at most.
KEY_CHARS, MOST_SHARDS = 256, 1_000_000
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "shard int, first_key string, last_key string, n bigint"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a url; '' for a null url, ')' and the url itself where there is no host."""
    url = F.coalesce(url, F.lit(""))
    host, _ = host_and_path(url)
    rest = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*([^#]*)", 1), "^$", "/")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(url == "", "").when(host == "", F.concat(F.lit(")"), url)).otherwise(key)


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Fields of an unzipped record; a response's digest is that of its payload and must be the one its header names."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "")[10:-1]) else None  # noqa: E731  of <urn:page:N>
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and header differ")
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}


def _write(batches, root: str):
    import pyarrow as pa
    from pyspark import TaskContext

    shard, files = TaskContext.get().partitionId(), Files(root)
    lines: list[str] = []
    blocks: list[bytes] = []
    directory: list[str] = []
    seen = {"n": 0, "first": None, "last": None, "at": 0, "indexed": 0}

    def close_block():
        block = gzip.compress("\n".join(lines).encode(), LEVEL, mtime=0)
        directory.append(f"{lines[0].rpartition(' {')[0]}\t{seen['indexed']}\t{len(block)}")
        blocks.append(block)
        seen["indexed"] += len(block)
        lines.clear()

    def records():
        marked = None
        for batch in batches:
            for key, page_id, digest, refers_to, url, html, marker in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if marker == 0:
                    marked = (key, page_id, digest), refers_to
                    continue
                target = marked[1] if marked and marked[0] == (key, page_id, digest) else None
                member = gzip.compress(_record(page_id, url or "", html or b"", digest, target), LEVEL, mtime=0)
                place = {"page_id": page_id, "offset": seen["at"], "length": len(member)}
                if url and ("\r" in url or "\n" in url):
                    place["url"] = url  # a record's header cannot hold it as it is
                lines.append(f"{json.dumps(key)} " + json.dumps(place))
                seen["first"] = key if seen["n"] == 0 else seen["first"]
                seen["last"], seen["n"], seen["at"] = key, seen["n"] + 1, seen["at"] + len(member)
                if len(lines) == BLOCK_LINES:
                    close_block()
                yield member

    files.write(f"archive-{shard:08d}.warc.gz", records())
    if lines:
        close_block()
    files.write(f"index-{shard:08d}.gz", blocks)
    files.write(f"directory-{shard:08d}.txt", ["\n".join(directory).encode()])
    yield pa.RecordBatch.from_arrays([pa.array([shard], "int32"), pa.array([seen["first"]], pa.string()), pa.array([seen["last"]], pa.string()), pa.array([seen["n"]], "int64")], ["shard", "first_key", "last_key", "n"])


class Shard:
    """One range of keys: its directory in memory, its index blocks and records read by range."""

    def __init__(self, files: Files, shard: int):
        with files.open(f"directory-{shard:08d}.txt") as f:
            rows = [line.split("\t") for line in f.read().decode().split("\n") if line]
        self.keys = [json.loads(k) for k, _, _ in rows]
        self.places = [(int(a), int(n)) for _, a, n in rows]
        self.index, self.archive = files.open(f"index-{shard:08d}.gz"), files.open(f"archive-{shard:08d}.warc.gz")
        self.at, self.lines = -1, []

    def block(self, k: int) -> list[tuple[str, dict]]:
        at, length = self.places[k]
        self.index.seek(at)
        lines = gzip.decompress(self.index.read(length)).decode().split("\n")
        return [(json.loads(key), json.loads("{" + rest)) for key, _, rest in (line.rpartition(" {") for line in lines)]

    def record(self, place: dict) -> dict:
        self.archive.seek(place["offset"])
        fields = parse(gzip.decompress(self.archive.read(place["length"])))
        return fields | {"url": place.get("url", fields["url"])}

    def find(self, key: str):
        """Yields the records of one key, from the block in which it may start on; the block read last is kept."""
        for k in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                return
            if k != self.at:
                self.at, self.lines = k, self.block(k)
            block = self.lines
            at = bisect.bisect_left(block, key, key=lambda line: line[0])
            while at < len(block) and block[at][0] == key:
                yield self.record(block[at][1])
                at += 1

    def close(self) -> None:
        self.index.close()
        self.archive.close()


def _shards_of(batches, ranges):
    """For each key the shards whose range may hold it: (shard, key), by binary search in the sorted ranges."""
    import pyarrow as pa

    shards, firsts, lasts = ranges.value
    # shards may share a border key, so the greatest last key so far is what a search can go by
    most = list(accumulate(lasts, max))
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for key in batch.column(0).to_pylist():
            short = key[:KEY_CHARS]
            for i in range(bisect.bisect_left(most, short), bisect.bisect_right(firsts, short)):
                if lasts[i] >= short:
                    found[0].append(shards[i])
                    found[1].append(key)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.string())], ["shard", "key"])


def _find(batches, root: str):
    """Rows come sorted by shard and key; a record's payload is dropped once its digest is known to fit."""
    import pyarrow as pa

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    files, shard, number, rows = Files(root), None, None, []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for this, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if this != number:
                if shard is not None:
                    shard.close()
                number, shard = this, Shard(files, this)
            for record in shard.find(key):
                rows.append(tuple(record[n] for n in names))
                if len(rows) == 512:
                    yield flush()
                    rows = []
    if rows:
        yield flush()
    if shard is not None:
        shard.close()


def write_archives(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Writes archives, indexes and directories below ``root``; returns the manifest (shard, first_key, last_key, n).

    Of records with equal payloads of ``least`` bytes or more the one with the largest page_id is a response, the others
    are revisits that name it. Only that choice is made by digest, on rows without payloads; each payload moves once, to
    its range of keys. Groups of equal payloads are reduced before they meet. Null html and urls are empty ones; repeated
    rows are records each; an empty table gives an empty manifest.
    """
    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"), F.lit(1).alias("marker"))
    slim = rows.filter(F.octet_length("html") >= least).select("key", "page_id", "digest")
    # written, so that its join is between two shuffles and Spark can split a hot digest
    tops = written(slim.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1 and top is not null").drop("c"))
    again = slim.join(tops, "digest").filter("not page_id <=> top").select("key", "page_id", "digest", F.col("top").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), F.lit(0).alias("marker")).distinct()
    dealt = rows.unionByName(again).repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest", "marker")
    return written(shipped(dealt).mapInArrow(lambda batches: _write(batches, root), _MANIFEST)).filter("n > 0")


def lookup(manifest: DataFrame, root: str, urls: DataFrame) -> DataFrame:
    """The captures of each different url key of ``urls`` (column ``url``): a row for each record. Null urls have the empty key; keys
    without a capture give none. Keys go to the shards whose range may hold them, in the order of the index, and a
    very common key's captures are found in all the shards that they span."""
    rows = manifest.select("shard", F.substring("first_key", 1, KEY_CHARS).alias("a"), F.substring("last_key", 1, KEY_CHARS).alias("b")).limit(MOST_SHARDS + 1).collect()
    if len(rows) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    rows.sort(key=lambda r: (r["a"], r["shard"]))
    # one number and two short keys for each shard
    ranges = manifest.sparkSession.sparkContext.broadcast(tuple([r[i] for r in rows] for i in range(3)))
    keys = shipped(urls.select(url_key(F.col("url")).alias("key")).distinct())
    met = keys.mapInArrow(lambda batches: _shards_of(batches, ranges), "shard int, key string")
    met = met.repartition(max(1, min(len(rows), 20_000)), "shard").sortWithinPartitions("shard", "key")  # a number given is not coalesced
    return met.mapInArrow(lambda batches: _find(batches, root), _READ)


def warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to and url of each page, read back from archives
    by looking up the pages' urls.

    Null html is an empty payload and a null url an empty one; other urls come back as they were. A null page_id is
    archived without a number; if its payload recurs it is a revisit of the largest page_id, and a response where no row
    of the group has one. Rows that repeat a group's largest page_id are responses each. A record holds a whole page
    however long. An empty table gives no rows.
    """
    root = shared_dir(pages.sparkSession)
    return lookup(write_archives(pages, root), root, pages)
