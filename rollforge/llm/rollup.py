"""Token counts as rollups that signed deltas keep up to date.

A batch of changes (op, doc_id, source, language, version, tokens) is committed once under its name. Insertions add
rows; deletions take all live rows of a doc_id and version; revisions replace their counts. Every change becomes signed
ledger rows, and the batch's sums by source, language and tokenizer version become its delta. Totals are the sums of
all committed deltas, so they never read a document again.

Ledger rows lie in BUCKETS folders by a hash of doc_id. A commit reads the buckets that its deletions and revisions fall
in, and of those only the rows of their documents; a small batch does not read the whole history.

Every attempt of a commit writes its ledger rows and its delta under a name of its own; the marker file that names the
attempt is created last, and only one attempt of a batch can create it. So a batch that was cut off is written anew, a
committed one is skipped when it is sent again, and of two writers of one batch one counts. Writers of different batches
have to take turns, as a batch's removals depend on those before it.

Null sources and languages are groups of their own; null text counts as empty. Repeated rows of an insertion are
counted each. Deleting what is not live changes nothing; revising it inserts it. Within a batch deletions and revisions
act on what earlier batches left. An empty batch commits an empty delta. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.llm.packing import text_blocks
from rollforge.llm.shared import new_path, remove, slices, written
from rollforge.llm.tokens import word_bpe

KEYS = ["source", "language", "version"]
LEDGER = "doc_id long, source string, language string, version string, tokens long, sign int"
DELTA = "source string, language string, version string, docs long, tokens long"
VERSIONS = ("byte_bpe_50k", "word_bpe_49k")
BUCKETS = 64


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """A rollup below one folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "rollup")

    def _files(self, path: str):
        """A Hadoop path and the file system that holds it."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Committed batches, each with the attempt that counts."""
        top, files = self._files(f"{self.path}/commits")
        names = sorted(s.getPath().getName() for s in files.listStatus(top)) if files.exists(top) else []
        return {n: self._attempt(n) for n in names if not n.startswith((".", "_"))}

    def _attempt(self, batch: str) -> str:
        where, files = self._files(f"{self.path}/commits/{batch}")
        stream = files.open(where)
        try:
            return bytes(b & 0xFF for b in iter(stream.read, -1)).decode()
        finally:
            stream.close()

    def committed(self, batch: str) -> bool:
        where, files = self._files(f"{self.path}/commits/{batch}")
        return files.exists(where)

    def _publish(self, batch: str, attempt: str) -> bool:
        """Creates the batch's marker, unless another attempt has done so."""
        where, files = self._files(f"{self.path}/commits/{batch}")
        try:
            stream = files.create(where, False)
        except Py4JJavaError:
            if self.committed(batch):
                return False
            raise
        stream.write(bytearray(attempt.encode()))
        stream.close()
        return True

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}-{attempt}" for b, attempt in self.batches().items()]
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def live(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows that are counted now, with how often each is; of the whole ledger or of the rows given."""
        rows = self._read("ledger", LEDGER) if rows is None else rows
        return rows.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").cast("int").alias("copies")).where("copies > 0")

    def _removals(self, changes: DataFrame) -> DataFrame:
        """The live rows that deletions and revisions take, as ledger rows."""
        gone = changes.where(F.col("op").isin("delete", "revise")).select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), _bucket(F.col("doc_id")).alias("gone_bucket")).distinct()
        gone = written(gone, "gone")
        touched = sorted(r.gone_bucket for r in gone.select("gone_bucket").distinct().collect())  # BUCKETS numbers at most
        rows = self._read("ledger", LEDGER + ", bucket int").where(F.col("bucket").isin(touched))
        same = (F.col("bucket") == F.col("gone_bucket")) & F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.col("version").eqNullSafe(F.col("gone_version"))
        return self.live(rows.hint("merge").join(gone.hint("merge"), same, "left_semi")).select("doc_id", *KEYS, "tokens", (-F.col("copies")).alias("sign"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if the batch was committed before; its changes are not read then."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"batch name {batch!r}")
        if self.committed(batch):
            return False
        # written once: additions and removals both read the changes, whose counting may be long
        changes = written(changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), *KEYS, F.col("tokens").cast("long").alias("tokens")), "changes")
        rows = changes.where(F.col("op").isin("insert", "revise")).select("doc_id", *KEYS, "tokens", F.lit(1).alias("sign"))
        if self.batches():
            rows = rows.unionByName(self._removals(changes))
        attempt = uuid.uuid4().hex
        ledger = f"{self.path}/ledger/{batch}-{attempt}"
        rows.withColumn("bucket", _bucket(F.col("doc_id"))).repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(ledger)
        kept = self.spark.read.schema(LEDGER).parquet(ledger)
        sums = kept.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.write.parquet(f"{self.path}/delta/{batch}-{attempt}")
        remove(changes)
        return self._publish(batch, attempt)

    def totals(self) -> DataFrame:
        """source, language, version, docs, tokens; groups that fell to nothing are left out."""
        return self._read("delta", DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


_RANKS: dict[str, object] = {}


def _rank_coder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    if path not in _RANKS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _RANKS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path]


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, paths: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, language, version, tokens: a row for each document and tokenizer version.

    paths names each version's vocabulary file where it is not the installed public one.
    """
    paths = paths or {}

    def counted(version: str, texts: list) -> list[int]:
        import public_tokenizers

        if version == "word_bpe_49k":
            return [len(x) >> 2 for x in word_bpe(paths.get(version)).encode(texts)]
        coder = _rank_coder(paths.get(version) or public_tokenizers.path(f"{version}.tiktoken"))
        return [len(coder.encode_ordinary(t or "")) for t in texts]

    def count(batches):
        for batch in slices(batches):
            ids, texts, sources, languages = (c.to_pylist() for c in batch.columns)
            for rows, block in text_blocks(list(range(len(ids))), texts):
                for version in versions:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[r] for r in rows], pa.int64()), pa.array([sources[r] for r in rows], pa.string()), pa.array([languages[r] for r in rows], pa.string()),
                        pa.array([version] * len(rows), pa.string()), pa.array(counted(version, block), pa.int64()),
                    ], ["doc_id", "source", "language", "version", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(count, "doc_id long, source string, language string, version string, tokens long")


ESTIMATE = "four_chars"


def rolled_up(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Totals of a corpus that is first counted by an estimate (a token for four characters) under each version and one of its own,
    then revised exactly; at last the estimate's own version is withdrawn by deletions."""
    rollup = TokenRollup(docs.sparkSession)
    named = docs.select("doc_id", "source", F.col("lang").alias("language"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    rollup.commit("0-estimate", named.withColumn("op", F.lit("insert")).withColumn("version", F.explode(F.array(*map(F.lit, (*versions, ESTIMATE))))))
    exact = count_tokens(docs, versions).withColumn("op", F.lit("revise"))
    rollup.commit("1-exact", exact)
    rollup.commit("1-exact", exact)  # sent again, as a retry would: it counts once
    rollup.commit("2-withdrawn", named.withColumn("op", F.lit("delete")).withColumn("version", F.lit(ESTIMATE)))
    return rollup.totals()
