"""Sources and sinks: JSON lines, task directories, keyed JSON objects, TSV,
table sets, split-partitioned datasets, result logs, prediction cache."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: fixed values: words that common table readers take for a missing value
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A", "#NA", "-nan", "-NaN")

RESULT_SCHEMA = ("model STRING, dataset STRING, prompt STRING, random_demos DOUBLE, "
                 "informative_demos DOUBLE, difference DOUBLE")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record per line, nested arrays and structs, declared schema."""
    return spark.read.schema(schema).json(path)


def read_task_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.json`` file is one task; rows = its ``Instances`` with
    input and first output; ``task`` = file name without extension."""
    schema = "Instances ARRAY<STRUCT<input: STRING, output: ARRAY<STRING>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*.json") \
        .select("Instances", F.col("_metadata.file_name").alias("_f"))
    ex = raw.select(F.regexp_replace("_f", r"\.json$", "").alias("task"), F.posexplode("Instances").alias("pos", "i"))
    return ex.select("task", "pos", F.col("i.input").alias("input"), F.get(F.col("i.output"), 0).alias("label"))


def _task_of(path):
    """Task of a file: its name without extension, or, for a part file, the
    name of its folder (``name``, ``name.json`` or ``task=name``)."""
    parts = F.split(path, "/")
    own, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    name = F.when(own.startswith("part-"), folder).otherwise(own)
    return F.regexp_replace(F.regexp_replace(name, r"^task=", ""), r"\.json$", "")


def read_tasks(spark: SparkSession, path: str, ids: Sequence[str]) -> DataFrame:
    """Tasks asked for by id: for each id the task of the smallest name that
    contains it, as ``read_task_dir`` gives them.

    File names are listed and matched first, only the files of the matching
    tasks are opened.  The list that reaches the driver has one task for each
    id at most."""
    from demoforge.operators.filters import select_tasks
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", _task_of(F.col("path")).alias("task"))
    chosen = select_tasks(files, "task", ids, first=True)
    found = chosen.join(files, "task").select("task_id", "task", "path").collect()
    missing = sorted(set(ids) - {r.task_id for r in found})
    if missing:
        raise ValueError(f"no task has {missing} in its name")
    schema = "Instances ARRAY<STRUCT<input: STRING, output: ARRAY<STRING>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(sorted({r.path for r in found})).select(
        "Instances", _task_of(F.col("_metadata.file_path")).alias("task"))
    ex = raw.select("task", F.posexplode("Instances").alias("pos", "i"))
    return ex.select("task", "pos", F.col("i.input").alias("input"), F.get(F.col("i.output"), 0).alias("label"))


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, per_line: bool = False) -> DataFrame:
    """JSON objects mapping ids to values, one per file or, ``per_line``, one
    per line: rows (id, value).  A whole file is one row of one task; a large
    set of ids is better kept with an object per line."""
    txt = spark.read.option("wholetext", not per_line).text(path)
    m = F.from_json("value", f"MAP<STRING, {value_schema}>")
    return txt.select(F.explode(m).alias("id", "value"))


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated, quoted fields; empty values and the usual words for a
    missing one (``MISSING``) become NULL."""
    r = spark.read.option("sep", "\t").option("header", header).option("quote", '"')
    raw = r.csv(path) if header else r.schema(_as_strings(schema)).csv(path) if schema else r.csv(path)
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not schema:
        return raw
    kinds = StructType.fromDDL(schema)
    return raw.select(*[F.col(f"`{c}`").cast(k.dataType).alias(k.name) for c, k in zip(raw.columns, kinds)])


def _as_strings(schema: str) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in StructType.fromDDL(schema)])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Headerless six-column result log."""
    return read_tsv(spark, path, RESULT_SCHEMA, header=False)


#: a field of a tab-separated line after its tab, quoted or plain
_FIELD = r'\t("(?:[^"]|"")*"|[^\t]*)'


def _fields(line):
    """Fields of a line: quotes taken off, missing values as NULL."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(_FIELD), F.lit(1))

    def plain(f):
        inner = F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1),
                       F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
        return F.when(~inner.isin(*MISSING), inner)

    return F.transform(raw, plain)


def read_table_set(spark: SparkSession, index_path: str, table_dir: str, uid_col: str = "[SKIP] UID",
                   skip_marker: str = "SKIP") -> DataFrame:
    """Tables named (one per line) in an index file, as (uid, text).

    A table is a tab-separated file with a header, or a folder of such part
    files; tables may have different columns.  Text = a row's columns without
    ``skip_marker`` in their names, missing ones empty, joined by a blank; the
    first uid wins in index order, then in file order.

    One scan reads the lines of all files with their place; the first line of
    every file is its header, joined back by file and zipped with the fields,
    so the plan has the same size for any number of tables and nothing is
    collected.  A quoted field may hold tabs, not line breaks."""
    base = table_dir.rstrip("/").rsplit("/", 1)[-1]
    lines = spark.read.option("recursiveFileLookup", True).text(table_dir).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("row")).alias("at"))
    inside = F.element_at(F.split("file", f"/{re.escape(base)}/"), -1)
    lines = lines.where(F.col("value") != "").withColumn("table", F.try_url_decode(F.split_part(inside, F.lit("/"), F.lit(1))))
    index = spark.read.text(index_path).select(
        F.trim("value").alias("table"), F.struct(F.col("_metadata.file_block_start").alias("start"),
                                                 F.monotonically_increasing_id().alias("row")).alias("order"))
    index = index.where(F.col("table") != "").groupBy("table").agg(F.min("order").alias("order"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"), F.first("table").alias("table"))
    heads = heads.join(index, "table").select("file", "order", "first", _fields(F.col("head")).alias("names"))
    rows = lines.select("file", "at", _fields(F.col("value")).alias("fields")).join(heads, "file").where(F.col("at") > F.col("first"))
    shown = F.filter(F.arrays_zip("names", "fields"), lambda c: ~F.contains(c["names"], F.lit(skip_marker)))
    text = F.array_join(F.transform(shown, lambda c: F.coalesce(c["fields"], F.lit(""))), " ")
    uid = F.get(F.col("fields"), (F.array_position("names", F.lit(uid_col)) - 1).cast("int"))
    return rows.select(uid.alias("uid"), text.alias("text"), "order", "at").groupBy("uid").agg(
        F.min_by("text", F.struct("order", "at")).alias("text"))


def read_split(spark: SparkSession, path: str, split: str | Sequence[str]) -> DataFrame:
    """A dataset stored partitioned by ``split``: the filter prunes partitions."""
    splits = [split] if isinstance(split, str) else list(split)
    return spark.read.parquet(path).where(F.col("split").isin(splits))


def write_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Long result rows as TSV with five decimals (the log format); a NULL
    score is an empty field."""
    cols = ["model", "dataset", "prompt"]
    out = df.select(*cols, *[F.when(F.col(c).isNotNull(), F.format_string("%.5f", F.col(c))).alias(c)
                             for c in ("random_demos", "informative_demos", "difference")])
    out.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_wide(df: DataFrame, path: str, rows: Sequence[str], col: str, values: Sequence[str], value: str) -> None:
    """One line per ``rows`` key, one column per listed value of ``col`` (mean
    of ``value``, five decimals, NULL empty), as TSV with a header."""
    wide = df.groupBy(*rows).pivot(col, list(values)).agg(F.avg(value))
    wide.select(*rows, *[F.when(F.col(f"`{v}`").isNotNull(), F.format_string("%.5f", F.col(f"`{v}`"))).alias(v) for v in values]) \
        .write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch_id", files: int | None = None) -> None:
    """Training batches as files in batch order: a file holds whole
    consecutive batches, sorted (sampled range boundaries, no one-task sort)."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df.repartitionByRange(n, batch).sortWithinPartitions(batch).write.mode("error").parquet(path)


def batch_shard(spark: SparkSession, path: str, shard: int = 0, of: int = 1, start: int = 0, batch: str = "batch_id") -> DataFrame:
    """The rows of shard ``shard`` of ``of`` (every ``of``-th batch) from batch
    ``start`` on.  Files that end before ``start`` are pruned by their
    statistics."""
    if not 0 <= shard < of:
        raise ValueError(f"no shard {shard} of {of}")
    return spark.read.parquet(path).where((F.col(batch) >= start) & (F.pmod(F.col(batch), F.lit(of)) == shard))


def iterate_batches(spark: SparkSession, path: str, order: str = "idx", shard: int = 0, of: int = 1, start: int = 0,
                    batch: str = "batch_id"):
    """(batch number, rows in ``order``) of a shard, ascending, for a training
    loop: file after file, so that the reader holds one part of one file.  A
    loop that stopped goes on with ``start`` = the last batch it saw plus one."""
    spans = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.min(batch).alias("lo"), F.max(batch).alias("hi")).orderBy("lo").collect()
    for span in spans:
        if span.hi < start:
            continue
        rows: list = []
        for r in batch_shard(spark, span.f, shard, of, start, batch).orderBy(batch, order).toLocalIterator():
            if rows and rows[-1][batch] != r[batch]:
                yield rows[-1][batch], rows
                rows = []
            rows.append(r)
        if rows:
            yield rows[-1][batch], rows


#: a cache of so many generations is merged into one by the next commit
MERGE_GENERATIONS = 32
GENERATION = "cache_generation"
MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path class for ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, generations) of the newest whole manifest; (0, []) without one.

    Manifests stand in a folder that readers of the whole path pass over.
    Files that are no generation are no cache of ours: an error, not an empty
    cache."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/{MANIFESTS}")
    if fs.exists(at(path)):
        strange = [f.getPath().getName() for f in fs.listStatus(at(path))]
        strange = [n for n in strange if n[0] not in "_." and not n.startswith(f"{GENERATION}=")]
        if strange:
            raise ValueError(f"{path} holds files that no manifest lists: {strange[:3]}")
    numbers = sorted((int(f.getPath().getName()) for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
    for n in numbers:
        lines = [r.value for r in spark.read.text(f"{path}/{MANIFESTS}/{n}").collect()]
        if lines and lines[-1] == "end":
            return n, lines[:-1]
    return (numbers[0] if numbers else 0), []


def cache_generations(spark: SparkSession, path: str) -> list[str]:
    """The committed generations of a cache."""
    return _manifest(spark, path)[1]


def _generations(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame | None:
    """The rows of generations, folders of one partitioned table."""
    if not names:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/{g}" for g in names]).drop(GENERATION)


def _write_generation(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    name = f"{GENERATION}=g{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{name}")
    return name


def _commit(spark: SparkSession, path: str, known: list[str], new: str, key: Sequence[str], partition_by: Sequence[str]) -> list[str]:
    """List ``new`` in the next manifest; generations that others committed
    after ``known`` win: rows of keys they hold leave ``new`` first.

    A manifest is created, never overwritten, and its number is free for one
    writer only; the loser looks again."""
    fs, at = _files(spark, path)
    while True:
        number, listed = _manifest(spark, path)
        others = [g for g in listed if g not in known]
        if others:
            mine = _generations(spark, path, [new])
            new = _write_generation(cache_misses(mine, _generations(spark, path, others), key), path, partition_by)
            known = [*known, *others]
        names = [*listed, new]
        if len(names) > MERGE_GENERATIONS:
            names = [_write_generation(_generations(spark, path, names), path, partition_by)]
        try:
            out = fs.create(at(f"{path}/{MANIFESTS}/{number + 1}"), False)
        except Exception as e:  # noqa: BLE001
            if "already exists" not in str(e):
                raise
            continue
        out.write(bytearray("\n".join([*names, "end", ""]).encode()))
        out.close()
        return names


def _same(a: DataFrame, b: DataFrame, key: Sequence[str]):
    cond = a[key[0]].eqNullSafe(b[key[0]])
    for c in key[1:]:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def cache_misses(todo: DataFrame, cached: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Requested rows whose key (NULL equals NULL) is not stored."""
    if cached is None:
        return todo
    c = cached.select(*key)
    return todo.join(c, _same(todo, c, key), "left_anti")


def with_cache(spark: SparkSession, todo: DataFrame, path: str, key: Sequence[str], compute,
               partition_by: Sequence[str] = (), unique: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Prediction cache keyed by the full run key (model, task, strategy,
    K, word limit, sample idx ...): rows already stored are reused, the
    missing ones (NULL keys match NULL keys) are computed, stored and
    returned too.  ``partition_by`` (run-level key columns) lays the cache out
    so a run's probe reads only its own partitions.  ``unique``: ``todo`` has
    one row a key, which saves a shuffle; ``keys`` may give its keys (or more
    rows of them) where reading ``todo`` again costs more.

    A run writes its rows as a generation of its own and then commits a
    manifest that lists the generations that count; readers look at nothing
    else, so a run that fails leaves no trace and the folder is never read
    while it is written.  Of two runs that computed the same key the first to
    commit wins.  A cache that is listed but cannot be read is an error, never
    an empty cache."""
    key, path = list(key), path.rstrip("/")
    known = cache_generations(spark, path)
    missing = cache_misses(todo, _generations(spark, path, known), key)
    new = _write_generation(compute(missing if unique else missing.dropDuplicates(key)), path, partition_by)
    stored = _generations(spark, path, _commit(spark, path, known, new, key, partition_by))
    keys = todo.select(*key) if keys is None else keys
    return stored.join(keys, _same(stored, keys, key), "left_semi")
