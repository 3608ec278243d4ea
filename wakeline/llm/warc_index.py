"""WARC archives with revisit records, and one capture index merged from the archives' own sorted runs.

Tasks write archives (a gzip member per record, files of bounded size) and, for each file, a run of index rows sorted by URL
key, timestamp and capture id. Sampled splitters cut the key space into even buckets; in each bucket a loser tree
merges the slices of all runs; bucket after bucket, the captures are globally ordered, so a URL's history is contiguous.

A payload of MIN_REVISIT bytes or more that several captures share is stored with the smallest id; the others are revisits that
refer to it. Null payloads are empty, null URLs have an empty key, null ids are written as such (a null id is never referred
to while another capture has the payload); repeated rows get equal records; an empty table gives no files and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.common import durable, join_facts, row_keys, whole_groups
from wakeline.llm.token_files import _put
from wakeline.session import shared_folder

MIN_REVISIT = 100        # bytes from which a payload is stored once
FILE_BYTES = 32 << 20    # an archive is closed beyond it
BUCKET_ROWS = 20_000     # captures merged at once, where there are shuffle partitions enough
SAMPLES = 64             # sampled keys a bucket, of which one becomes a splitter

RUN = "urlkey string, ts long, id long, file string, offset long, length long, run string, pos long"


def url_key(url: str | None) -> str:
    """Host labels from the top domain down, then path and query: sorts the captures of a site together."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.removeprefix("www.").split(".")))
    return key + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


class LoserTree:
    """k-way merge: inner nodes hold the loser of each match, so a new head replays one path of log2 k matches."""

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:         # while the tree is built: wait for the opponent
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]] is not None:
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._replay(w)


def revisits(captures: DataFrame) -> DataFrame:
    """k1, k2, refers_to of the captures that repeat a payload. captures: id, url, ts, payload, k1, k2."""
    slim = captures.select("k1", "k2", "id", F.sha2(F.encode(F.coalesce("payload", F.lit("")), "UTF-8"), 256).alias("digest"),
                           F.octet_length(F.coalesce("payload", F.lit(""))).alias("n"))
    slim = durable(slim.filter(F.col("n") >= MIN_REVISIT).drop("n"))
    first = durable(slim.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    again = join_facts(slim, first, "digest", "rows", ["k1", "k2"], how="inner")
    return again.filter(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))).select(
        "k1", "k2", F.col("first_id").alias("refers_to")).distinct()


def _record(i, url, ts, payload: bytes, refers) -> bytes:
    import datetime

    digest = hashlib.sha256(payload).hexdigest()
    body = b"" if refers is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:capture:{'null' if i is None else i}>",
             f"WARC-Date: {datetime.datetime.fromtimestamp(ts or 0, datetime.UTC):%Y-%m-%dT%H:%M:%SZ}",
             f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:capture:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + z.flush()


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns their sorted index runs, durable (RUN)."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = row_keys(captures, "payload", "id")
    rows = rows.join(revisits(rows), ["k1", "k2"], "left").select("id", "url", "ts", "payload", "refers_to")

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size, index = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            name = f"captures-{part:06d}-{k:04d}.warc.gz"
            _put(folder, name, b"".join(held))
            index.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))
            cols = list(zip(*index, strict=True))
            n = len(index)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([name] * n, pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64())],
                ["urlkey", "ts", "id", "file", "offset", "length", "run", "pos"])
        for b in batches:
            for i, url, ts, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rec = _record(i, url, ts, (payload or "").encode("utf-8", "surrogatepass"), refers)
                index.append((url_key(url), ts or 0, i, size, len(rec)))
                held.append(rec)
                size += len(rec)
                if size >= FILE_BYTES:
                    yield close()
                    k, held, size, index = k + 1, [], 0, []
        if held:
            yield close()
    return durable(rows.mapInArrow(run, RUN))


def merge_runs(runs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The runs as one index in global order of (urlkey, ts, id): adds bucket and place (position inside the bucket)."""
    total = runs.count()
    n_buckets = max(1, min(-(-total // bucket_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, total // (SAMPLES * n_buckets))
    cut = []
    if n_buckets > 1:       # about SAMPLES keys a bucket, and no more buckets than shuffle partitions
        keys = runs.filter(F.pmod(F.xxhash64("urlkey", "ts", "id", "file", "offset"), F.lit(step)) == 0).select("urlkey", "ts", "id").collect()
        keys = sorted((r[0], r[1], r[2] is None, r[2] or 0) for r in keys)
        cut = [keys[len(keys) * i // n_buckets] for i in range(1, n_buckets)] if keys else []

    def assign(batches):
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            at = [bisect.bisect_right(cut, (u, t, i is None, i or 0)) for u, t, i in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "bucket"])

    def merge(batches):
        for t in whole_groups(batches, ["bucket"]):
            rows = list(zip(*(t.column(c).to_pylist() for c in ("urlkey", "ts", "id", "file", "offset", "length", "run", "bucket")), strict=True))
            out, i = [], 0
            while i < len(rows):
                bucket, slices = rows[i][7], []
                while i < len(rows) and rows[i][7] == bucket:
                    j = i
                    while j < len(rows) and rows[j][6:] == rows[i][6:]:
                        j += 1
                    slices.append(rows[i:j])
                    i = j
                out += [(*r[:6], bucket, k) for k, r in enumerate(LoserTree(slices, lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3], r[4])))]
            cols = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["urlkey", "ts", "id", "file", "offset", "length", "bucket", "place"])
    dealt = runs.mapInArrow(assign, RUN + ", bucket long").repartition("bucket").sortWithinPartitions("bucket", "run", "pos")
    return dealt.mapInArrow(merge, "urlkey string, ts long, id long, file string, offset long, length long, bucket long, place long")


def read_archives(spark, folder: str) -> DataFrame:
    """Records of all archives, parsed from the files: file, offset, id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "file string, offset long, id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None):
        v = (urn or "null").removeprefix("<urn:capture:").removesuffix(">")
        return None if v == "null" else int(v)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at, out = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    z = zlib.decompressobj(31)
                    raw = z.decompress(data[at:at + (1 << 16)])
                    fed = min(len(data), at + (1 << 16))
                    while not z.eof:
                        raw += z.decompress(data[fed:fed + (1 << 20)])
                        fed = min(len(data), fed + (1 << 20))
                    head, _, body = raw.partition(b"\r\n\r\n")
                    h = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
                    payload, digest = body[:int(h["Content-Length"])], h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path} at {at}: the payload does not have its digest")
                    out.append((path, at, number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                    at = fed - len(z.unused_data)
                cols = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["file", "offset", "id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def archive_folder(spark) -> str:
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    folder = folder[len("file:"):] if folder.startswith("file:") else folder
    return folder if "://" in folder else "file:///" + folder.lstrip("/")


def global_places(index: DataFrame) -> DataFrame:
    """`place` inside a bucket made the place in the whole index. There are no more buckets than shuffle partitions, so the table
    of their first places is small whatever the number of captures."""
    w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    return index.join(F.broadcast(first), "bucket").withColumn("place", F.col("place") + F.col("_first")).drop("_first")


def archive(captures: DataFrame) -> DataFrame:
    """Write, merge the index, and read every indexed record back. captures: id, url, ts, payload. `place` is the capture's
    position in the global order of (urlkey, ts, id); captures of a URL are neighbours there, so it orders their history."""
    folder = archive_folder(captures.sparkSession)
    index = global_places(durable(merge_runs(write_archives(captures, folder))))
    return index.select("urlkey", "ts", "file", "offset", "length", "bucket", "place").join(read_archives(captures.sparkSession, folder), ["file", "offset"])
