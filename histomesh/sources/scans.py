"""Reading matrices, dictionaries, metadata, sheets and result tables.

All samples are read by one scan. The sample of a row is the folder its file
lies in, either ``<sample>`` or ``sample_id=<sample>``. The last two folder names
together are its bundle: files of one bundle share indices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histomesh.lineage import scratch_path, small
from histomesh.operators.roles import column, embedding_array

# Columns and types of the three result tables.
_LABEL = T.StringType()
_GROUP = [T.StructField(c, _LABEL) for c in ("condition", "sample", "compartment")]
ABUNDANCE_SCHEMA = T.StructType(
    _GROUP
    + [
        T.StructField("cell_type", _LABEL),
        T.StructField("n_cells", T.LongType()),
        T.StructField("compartment_total_cells", T.LongType()),
        T.StructField("sample_total_cells", T.LongType()),
        T.StructField("cell_type_fraction", T.DoubleType()),
        T.StructField("compartment_fraction", T.DoubleType()),
    ]
)
NEIGHBOR_SCHEMA = T.StructType(
    _GROUP
    + [
        T.StructField("source_cell_type", _LABEL),
        T.StructField("source_n_cells", T.LongType()),
        T.StructField("neighbor_cell_type", _LABEL),
        T.StructField("neighbor_count", T.DoubleType()),
        T.StructField("neighbor_fraction", T.DoubleType()),
        T.StructField("neighbor_presence", T.DoubleType()),
    ]
)
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("condition", _LABEL),
        T.StructField("compartment", _LABEL),
        T.StructField("source_cell_type", _LABEL),
        T.StructField("neighbor_cell_type", _LABEL),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_supporting_samples", T.LongType()),
        T.StructField("total_source_cells", T.LongType()),
        T.StructField("mean_neighbor_count", T.DoubleType()),
        T.StructField("mean_neighbor_fraction", T.DoubleType()),
        T.StructField("sd_neighbor_fraction", T.DoubleType()),
        T.StructField("mean_neighbor_presence", T.DoubleType()),
        T.StructField("sd_neighbor_presence", T.DoubleType()),
    ]
)


def _decoded(name):
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _folder(path, up: int = 1):
    """Name of a folder above a file; partition folders are escaped once more."""
    name = _decoded(F.element_at(F.split(path, "/"), -1 - up))
    named = F.regexp_extract(name, "^sample_id=(.*)$", 1)
    return F.when(F.startswith(name, F.lit("sample_id=")), _decoded(named)).otherwise(name)


def _place(path):
    """Sample and bundle of a file."""
    bundle = F.concat_ws("/", _folder(path, 2), _folder(path, 1))
    return _folder(path).alias("sample_id"), bundle.alias("bundle")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``(sample_id, bundle, position, value)``, positions from zero per file.

    Row ids rise in file order within a read task. Subtracting the first id of
    the file's piece, and adding the lengths of its earlier pieces, numbers the
    lines without sorting or gathering them; pieces are broadcast if they are few.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    lines = lines.withColumn("task", F.shiftright("id", 33))
    pieces = lines.groupBy("file", "task").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("length")
    )
    before = Window.partitionBy("file").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "file", "task", "first", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"), *_place(F.col("file"))
    )
    return lines.join(small(starts), ["file", "task"]).select(
        "sample_id",
        "bundle",
        (F.col("id") - F.col("first") + F.col("start")).alias("position"),
        "value",
    )


def read_dictionary(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """Ordered names: the first tab field of each line, and its position."""
    return numbered_lines(spark, path).select(
        "sample_id", "bundle", "position", F.element_at(F.split("value", "\t"), 1).alias(name)
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Ordered features: names, and the ids and types beside them where files have these fields."""
    fields = F.split("value", "\t")
    told = [F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in ((1, "feature_id"), (2, "feature_type"))]
    return numbered_lines(spark, path).select("sample_id", "bundle", "position", F.get(fields, F.lit(0)).alias("name"), *told)


def read_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Matrix text files as ``(entries, sizes)``, entries as they stand, repeats included.

    ``entries(sample_id, bundle, gene_ix, cell_ix, n)`` has one-based indices.
    ``sizes(sample_id, bundle, n_genes, n_cells, n_entries, n_lines)`` comes from the size lines,
    ``n_lines`` being the entries that are really there. The text is parsed by one scan and kept as
    numbers, with the row ids of that scan, by which the first line of a file is told from its
    entries. Size lines, one a file, are broadcast if they are few, so no entry is dealt out by file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("id"),
        F.trim("value").alias("value"),
    )
    # comments, blank lines and lines that begin with white space are passed over
    whole = lines.where(~F.substring("value", 1, 1).isin("", "%", "\t", "\n", "\x0b", "\f", "\r")).select(
        "file", "id", F.split("value", "\\s+").alias("part")
    )
    columns = ["gene_ix", "cell_ix", "n"]
    numbers = [F.get("part", F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(zip(columns, ("long", "long", "double"), strict=True))]
    landed = scratch_path(spark, "lines")
    whole.select("file", "id", *numbers).write.parquet(landed)
    kept = spark.read.parquet(landed)
    heads = kept.groupBy("file").agg(
        *[F.min_by(c, "id").alias(c) for c in columns], F.min("id").alias("first"), (F.count(F.lit(1)) - 1).alias("n_lines")
    )
    heads = small(heads.select("file", *_place(F.col("file")), *columns, "first", "n_lines"))
    sizes = heads.select(
        "sample_id",
        "bundle",
        F.col("gene_ix").alias("n_genes"),
        F.col("cell_ix").alias("n_cells"),
        F.col("n").cast("long").alias("n_entries"),
        "n_lines",
    )
    entries = (
        kept.join(heads.select("file", "first", "sample_id", "bundle"), "file")
        .where("id <> first")
        .select("sample_id", "bundle", *columns)
    )
    return entries, sizes


def read_triplets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Matrix text files as ``(triplets, sizes)``: the entries of :func:`read_entries`, repeated ones added up."""
    entries, sizes = read_entries(spark, path)
    return entries.groupBy("sample_id", "bundle", "gene_ix", "cell_ix").agg(F.sum("n").alias("n")), sizes


def named_counts(triplets: DataFrame, genes: DataFrame, cells: DataFrame, more=()) -> DataFrame:
    """Replace matrix indices by gene names and cell ids, bundle by bundle; ``more`` columns stay.

    The gene dictionaries are broadcast if a count proves them small, so the entries
    are dealt out by cell only.
    """
    g = genes.select("bundle", (F.col("position") + 1).alias("gene_ix"), F.col("name").alias("gene"))
    c = cells.select("bundle", (F.col("position") + 1).alias("cell_ix"), F.col("name").alias("cell_id"))
    return (
        triplets.join(small(g), ["bundle", "gene_ix"])
        .join(c, ["bundle", "cell_ix"])
        .select("sample_id", "cell_id", "gene", "n", *more)
    )


def read_metadata(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet if the path says so, else CSV with a header, compressed or not.

    Without a schema every CSV column is text; casts are left to the caller, so
    that nothing is guessed from the data.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV metadata of many samples, with the sample taken from the folder.

    A ``sample_id`` of the file's own is kept as ``stated_sample``, for the checks.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True)
    table = reader.csv(path).withColumn("folder", _folder(F.col("_metadata.file_path")))
    if "sample_id" in table.columns:
        table = table.withColumnRenamed("sample_id", "stated_sample")
    return table.withColumnRenamed("folder", "sample_id")


def read_embedding(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table of numeric components as one array per cell."""
    return embedding_array(read_metadata(spark, path, schema))


def read_sample_embedding(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CSV components of many samples as one array per cell: the columns that hold numbers only."""
    table = read_sample_metadata(spark, path)
    others = [c for c in table.columns if c not in ("sample_id", "cell_id", "stated_sample")]
    words = table.agg(*[F.count_if(column(c).isNotNull() & column(c).try_cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(others)]).first() if others else ()
    numeric = [c for c, n in zip(others, words, strict=True) if not n]
    if not numeric:
        raise ValueError(f"no column of {path} holds numbers")
    return table.select("sample_id", "cell_id", F.array(*[column(c).cast("double") for c in numeric]).alias(name))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated sample sheet; quotes have no special meaning."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result table with its types pinned, so that label ``0`` stays text.

    Only an empty field is null; a label such as ``NA`` is kept.
    """
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
