"""WARC archives of web pages, and capture histories by an external merge of their indexes.

Writing: each page becomes one record of a gzipped WARC file. Of pages with equal payloads of at least MIN_REVISIT
bytes the smallest page_id is a response, the others are revisits that refer to it and carry no payload again. Only
digests and sizes are shuffled to find them; payloads stay in their input task. A file is closed before it would exceed
FILE_BYTES of records; a longer record is a file of its own.
Reading: the archives are parsed record by record; lengths and SHA-256 digests of responses are taken from the payload
bytes that came back, those of revisits from the record's headers. The entries of one archive, sorted by URL key, time
and page, are a run. Runs are dealt out by key range, about RANGE_ENTRIES entries to a range, and each range's runs are
merged by a loser tree that reads them batch by batch, so ranges 0, 1, ... with their positions are the captures in
global order. capture_histories numbers them through.

Null html is an empty payload, a null URL an empty one; line breaks in URLs are percent-coded in headers. A null page_id
is never referred to. Repeated rows of one page_id are records each: all responses, or all revisits of the same page.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollforge.llm.shared import new_path, remove, written

MIN_REVISIT, FILE_BYTES, RANGE_ENTRIES, BATCH_ENTRIES = 100, 64 << 20, 200_000, 2_000
#: Rows sent to every task take about ROW_BYTES each there; more than MAX_BROADCAST bytes are shuffled instead.
ROW_BYTES, MAX_BROADCAST = 128, 64 << 20
BREAK = "\r\n\r\n"
ENTRY = [("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.string()), ("record_offset", pa.int64())]
ENTRY_SCHEMA = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, record_offset long"
MERGED_SCHEMA = ENTRY_SCHEMA + ", key_range int, position long"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Gzipped WARC files below path. A page's date is its page_id in seconds after 2020, as pages have no time."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = [F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n")]
    slim = written(pages.select(*base), "digests")
    firsts = slim.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    firsts = firsts.select(F.col("digest").alias("first_digest"), "first_id")
    again = slim.where(F.col("n") >= MIN_REVISIT).hint("merge").join(firsts.hint("merge"), F.col("digest") == F.col("first_digest")).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = written(again.select("page_id", "url", "digest", "n", "first_id"), "revisits")
    gone = again.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    rows = pages.select(*base, payload.alias("html"))
    same = F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    few = again.count() * ROW_BYTES <= MAX_BROADCAST
    own = rows.join(F.broadcast(gone), same, "left_anti") if few else rows.hint("merge").join(gone.hint("merge"), same, "left_anti")
    zone = spark.conf.get("spark.sql.session.timeZone")
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1577836800), zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit("\r\n"))

    def head(kind: str, more: Column, length: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Target-URI", address), line("WARC-Date", stamp),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("X-Payload-Length", F.col("n").cast("string")), more,
            line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("Content-Length: "), length.cast("string"), F.lit(BREAK),
        )

    refers = F.concat(line("WARC-Refers-To", name(F.col("first_id"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    responses = own.select(F.concat(head("response", F.lit(""), F.col("n")), F.col("html")).alias("value"))
    revisits = again.select(head("revisit", refers, F.lit(0)).alias("value"))

    def filed(batches):
        number, size = 0, 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            files = np.zeros(batch.num_rows, np.int32)
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > FILE_BYTES:
                    number, size = number + 1, 0
                size += n
                files[i] = number
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files)], ["value", "file"])

    dealt = responses.unionByName(revisits).mapInArrow(filed, "value string, file int")
    dealt.write.partitionBy("file").option("lineSep", BREAK).option("compression", "gzip").text(path)
    remove(slim, again)


def records(packed: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a gzipped WARC file; only a record at a time is held unpacked."""
    held, base, at = bytearray(), 0, 0
    reader, view = zlib.decompressobj(31), memoryview(packed)

    def fill() -> bool:
        nonlocal at, reader
        while at < len(view):
            piece = reader.decompress(view[at : at + 65536])
            at += 65536
            while reader.eof and reader.unused_data:
                rest, reader = reader.unused_data, zlib.decompressobj(31)
                piece += reader.decompress(rest)
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4:
            if not fill():
                break
        yield base, headers, bytes(held[end + 4 : end + 4 + size])
        done = end + 4 + size + 4
        del held[:done]
        base += done


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case: pages of one site sort together."""
    rest = url.split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split(":")[0].split("."))) + ")" + slash + path.split("#", 1)[0]


def _number(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "null") else int(value)


def _sort_key(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[7], entry[8]


def _batch(rows: list[tuple], extra: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    fields = [*ENTRY, *extra]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below path; each archive's entries come sorted, as one run."""

    def index(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run, rows = "/".join(name.rsplit("/", 2)[-2:]), []
                for offset, head, block in records(content.as_buffer().to_pybytes()):
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(block).hexdigest()
                    size = int(head["x-payload-length"]) if revisit else len(block)
                    rows.append((url_key(head["warc-target-uri"]), head["warc-date"], _number(head["warc-record-id"]), size, digest, head["warc-type"], _number(head.get("warc-refers-to", "")), run, offset))
                rows.sort(key=_sort_key)
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(index, ENTRY_SCHEMA)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so a new head plays one path only.

    Runs are iterators; no more of each than its head is held here.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else _sort_key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build()

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y or x == y and a < b)

    def _build(self) -> int:
        won = {self.k + i: i for i in range(self.k)}
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won.get(1, 0 if self.k == 1 else -1)

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = found = next(self.runs[run], None)
            self.keys[run] = None if found is None else _sort_key(found)
            node = (self.k + run) // 2
            while node >= 1:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_ENTRIES):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, BATCH_ENTRIES).columns), strict=True)


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All entries in global order: by key_range, then position. A URL with very many captures spans several ranges.

    runs is a written table. A task holds its range as Arrow batches of a bounded number of entries, and a few rows of
    each run at a time beside them.
    """
    keys = ["url_key", "captured_at", "page_id"]
    ranges = ranges or max(1, -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(ranges, *keys)

    def merge(batches):
        found: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column(7).to_pylist()
            begin = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[begin]:
                    found.setdefault(names[begin], []).append(batch.slice(begin, i - begin))
                    begin = i
        number, out = TaskContext.get().partitionId(), []
        more = [("key_range", pa.int32()), ("position", pa.int64())]
        for position, row in enumerate(LoserTree([_rows(found[k]) for k in sorted(found)])):
            out.append((*row, number, position))
            if len(out) == 10_000:
                yield _batch(out, more)
                out = []
        yield _batch(out, more)

    return dealt.sortWithinPartitions("run", *keys, "record_offset").mapInArrow(merge, MERGED_SCHEMA)


def capture_histories(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """Writes the archives into the shared folder, reads them back and merges their indexes; position is the global place.

    A range's first place is the number of entries in the ranges before it: one row for each range.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    runs = written(read_runs(pages.sparkSession, path), "runs")
    merged = written(merge_runs(runs, ranges), "captures")
    remove(runs)
    sizes = merged.groupBy("key_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("key_range").alias("own_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    placed = merged.hint("merge").join(begins.hint("merge"), F.col("key_range") == F.col("own_range"))
    return placed.withColumn("position", F.col("begins") + F.col("position")).drop("own_range", "begins")
