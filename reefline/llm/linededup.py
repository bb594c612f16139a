"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents becomes one run: its line keys as 128-bit hashes with
the number of documents and the largest doc_id, bucketed and sorted by hash. A
new batch merge-anti-joins the runs there are: keys that no run has make its own
run, keys already seen go to a table of repeats. ``fan_in`` runs of a level are
compacted into one of the next level, so a key is rewritten a logarithmic number
of times. Runs share buckets and sort order, so these joins shuffle nothing.

A line's key is the line without white space at both ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points in at least ``min_docs``
documents lose their lines in all documents but the one with the largest doc_id.

Cases: null or empty text is one empty line. A row without doc_id counts for no
key and loses no line. Rows with one doc_id are one document: each keeps or
loses lines as that document does. Equal lines of the kept document all stay.
Other columns are handed on; a column named like an output is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm.common import folder, remove

KEY = ["h1", "h2"]
NOTES = "notes"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Distinct hashes of the long keys of a text."""
    keys = F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, key_hash))


class LineRuns:
    """Levelled sorted runs in a shared folder. One writer at a time."""

    def __init__(self, spark: SparkSession, where: str, buckets: int, fan_in: int = 4):
        self.spark, self.where, self.buckets, self.fan_in = spark, where, buckets, fan_in
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.names: list[str] = []
        self.version = 0
        self.keeps = False  # whether runs that were replaced stay until the next save
        self.stale: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select(*KEY, "n_docs", "last_doc")
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.where}/{name}")
            .saveAsTable(name)
        )
        self.names.append(name)
        return name

    def save(self) -> None:
        """Note the runs there are, as a new version beside the earlier ones."""
        rows = [(level, name) for level, names in enumerate(self.levels) for name in names]
        rows += [(-1, name) for name in self.repeats]
        noted = self.spark.createDataFrame(rows, "level int, name string")
        noted = noted.withColumns({"buckets": F.lit(self.buckets), "fan_in": F.lit(self.fan_in)})
        self.version += 1
        noted.coalesce(1).write.mode("overwrite").parquet(f"{self.where}/{NOTES}/version={self.version}")
        stale, self.stale, self.keeps = self.stale, [], True
        for name in stale:  # no saved version needs them any more
            self._delete(name)

    @classmethod
    def open(cls, spark: SparkSession, where: str) -> LineRuns:
        """The runs as the last saved version has them. Tables that this session does not know are declared again."""
        noted = spark.read.schema("level int, name string, buckets int, fan_in int, version int").parquet(f"{where}/{NOTES}")
        last = noted.agg(F.max("version")).first()[0]
        rows = noted.filter(F.col("version") == last).orderBy("name").collect()  # a logarithmic number of runs
        found = cls(spark, where, rows[0]["buckets"], rows[0]["fan_in"])
        found.version, found.keeps = last, True
        found.levels = [[] for _ in range(1 + max(0, *[r["level"] for r in rows]))]
        for r in rows:
            if not spark.catalog.tableExists(r["name"]):
                spark.sql(
                    f"CREATE TABLE {r['name']} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_doc BIGINT) USING parquet "
                    f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {found.buckets} BUCKETS LOCATION '{where}/{r['name']}'"
                )
            found.names.append(r["name"])
            (found.repeats if r["level"] < 0 else found.levels[r["level"]]).append(r["name"])
        return found

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds."""
        for run in self.runs():
            batch = batch.join(run.select(*KEY), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of distinct keys (``h1, h2, n_docs, last_doc``)."""
        own = self._write(batch)
        if not self.runs():
            self.levels[0].append(own)
        else:
            keys = self.spark.table(own)
            new = self._write(self.fresh(keys))
            self.repeats.append(
                self._write(keys.join(self.spark.table(new).select(*KEY), KEY, "left_anti"))
            )
            self.levels[0].append(new)
            self._drop(own)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan_in:
                self._compact(level)

    def _compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next. They share no key."""
        old = self.levels[level]
        rows = self.spark.table(old[0])
        for name in old[1:]:
            rows = rows.unionByName(self.spark.table(name))
        merged = self._write(rows.repartition(self.buckets, *KEY))
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged)
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.names.remove(name)
        if self.keeps:
            self.stale.append(name)
        else:
            self._delete(name)

    def _delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.where}/{name}")

    def common(self, min_docs: int) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the largest doc_id."""
        first = [r.filter(F.col("n_docs") >= min_docs) for r in self.runs()]
        later = [self.spark.table(n) for n in self.repeats]
        if later:
            again = _all(later).select(*KEY).distinct()
            first += [r.filter(F.col("n_docs") < min_docs).join(again, KEY, "left_semi") for r in self.runs()]
        return (
            _all(first + later)
            .groupBy(*KEY)
            .agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            .filter(F.col("n_docs") >= min_docs)
        )

    def close(self) -> None:
        """Forget the tables' names and delete their files."""
        self.keeps = False
        for name in list(self.names):
            self._drop(name)
        remove(self.spark, self.where)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct line keys of documents: how many documents hold each, and the largest."""
    return (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("h"))
        .select("doc_id", "h.h1", "h.h2")
        .groupBy(*KEY)
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    )


def deliver(docs: DataFrame, where: str, first: bool, min_docs: int = 3, min_chars: int = 20, fan_in: int = 3) -> DataFrame:
    """Add a delivery of documents to the runs in ``where`` (begin them if ``first``); the keys to drop by now.

    Deliveries hold different documents: one that is added twice counts twice. A
    delivery that failed before it was saved may be added again.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, where, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in) if first else LineRuns.open(spark, where)
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    runs.keeps = True
    runs.add(batch_keys(plain, min_chars).repartition(runs.buckets, *KEY))
    runs.save()
    return runs.common(min_docs)


def common_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fan_in: int) -> DataFrame:
    """Feed the documents to the runs batch by batch; the keys to drop as a written table."""
    spark = docs.sparkSession
    where = folder(spark, "lines")
    runs = LineRuns(spark, where, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    staged = f"{where}/staged"
    (  # the texts are read once: keys are staged by batch
        docs.filter(F.col("doc_id").isNotNull())
        .select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
            F.explode(line_hashes(F.col("text"), min_chars)).alias("h"),
        )
        .select("batch", "doc_id", "h.h1", "h.h2")
        .groupBy("batch", *KEY)
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .write.partitionBy("batch")
        .parquet(staged)
    )
    schema = "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint, batch int"
    for k in range(batches):
        part = spark.read.schema(schema).parquet(staged).filter(F.col("batch") == k)
        runs.add(part.repartition(runs.buckets, *KEY))
    out = f"{folder(spark, 'common-lines')}"
    runs.common(min_docs).write.parquet(out)
    runs.close()
    return spark.read.schema("h1 bigint, h2 bigint, n_docs bigint, last_doc bigint").parquet(out)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """The documents with ``text`` freed of common lines, ``n_lines`` before and ``n_dropped``."""
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    common = common_lines(plain, min_docs, min_chars, batches, fan_in)
    # a row is known by id and text, so repeated rows stay what they are
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), "text")
    drops = (
        plain.filter(F.col("doc_id").isNotNull())
        .select(row.alias("row"), "doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("h"))
        .select("row", "doc_id", "h.h1", "h.h2")
        .join(common, KEY)
        .filter(F.col("doc_id") < F.col("last_doc"))
        .groupBy("row")
        .agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    )
    kept_columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    held = docs.select(
        F.struct(*kept_columns).alias("rest"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"),
    )
    lines = F.split("text", "\n")
    stays = F.filter(
        lines,
        lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col("gone"), key_hash(line_key(x))),
    )
    return (
        held.join(drops.hint("shuffle_hash"), "row", "left")
        .withColumn("n_lines", F.size(lines).cast("bigint"))
        .withColumn("stays", F.when(F.col("gone").isNotNull(), stays))
        .select(
            "rest.*",
            F.coalesce(F.array_join("stays", "\n"), F.col("text")).alias("text"),
            "n_lines",
            (F.col("n_lines") - F.coalesce(F.size("stays").cast("bigint"), F.col("n_lines"))).alias("n_dropped"),
        )
    )
