"""Comparing a new cohort with a reference cohort, exactly.

Both sides are canonical tables: ``cells`` keyed by ``(sample_id, cell_id)``,
``genes(position, gene)`` and long ``counts(sample_id, cell_id, gene, n)``.
Checks are joins and conditional sums; nothing is ordered or collected to
compare. Every report row is ``(check, passed, metrics)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.functions.geometry import is_finite
from histomesh.functions.ids import after_colon, text
from histomesh.lineage import cut, few, small, spread
from histomesh.operators.checks import CheckFailed, count_violations, require
from histomesh.operators.normalize import canonical_counts
from histomesh.operators.roles import column

KEY = ["sample_id", "cell_id"]
# The label fields that must agree.
REQUIRED_LABELS = ("cluster_sub", "celltype_short", "celltype_full")
CENTROID = ("centroid_x", "centroid_y")


def legacy_keys(cells: DataFrame, name: str = "obs_name", sample: str = "sample") -> DataFrame:
    """Composite keys of a side whose cell id is the part behind the colon of its name."""
    keyed = cells.withColumn("cell_id", after_colon(name)).withColumn("sample_id", text(sample))
    refuse = F.raise_error(F.lit("row names must have the form '<source>:<cell id>'"))
    return keyed.withColumn(
        "cell_id", F.when(F.col("cell_id") == "", refuse).otherwise(F.col("cell_id"))
    )


def shape_diff(new_cells, new_genes, ref_cells, ref_genes) -> DataFrame:
    """Numbers of cells and genes on both sides."""

    def rows(df: DataFrame, fact: str, side: str) -> DataFrame:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.lit(fact).alias("fact"), F.lit(side).alias("side"), "n")

    stacked = reduce(
        DataFrame.unionByName,
        [
            rows(new_cells, "cells", "new"),
            rows(new_genes, "genes", "new"),
            rows(ref_cells, "cells", "reference"),
            rows(ref_genes, "genes", "reference"),
        ],
    )
    both = stacked.groupBy("fact").pivot("side", ["new", "reference"]).agg(F.max("n"))
    return both.withColumn("passed", F.col("new") == F.col("reference"))


def feature_order_diff(new_genes: DataFrame, ref_genes: DataFrame) -> DataFrame:
    """First position where the gene lists differ, or where one of them ends.

    A pure difference in length is reported at the end of the shorter list,
    without names. Equal lists give one row that passes.
    """
    a = new_genes.select("position", F.col("gene").alias("new"))
    b = ref_genes.select("position", F.col("gene").alias("reference"))
    joined = a.join(b, "position", "full")
    both = F.col("new").isNotNull() & F.col("reference").isNotNull()
    differs = joined.where(~F.col("new").eqNullSafe(F.col("reference")))
    first = F.min_by(
        F.struct(
            "position",
            F.when(both, F.col("new")).alias("new"),
            F.when(both, F.col("reference")).alias("reference"),
        ),
        F.struct((~both).alias("beyond"), "position"),
    )
    return differs.agg(first.alias("first"), F.count(F.lit(1)).alias("n")).select(
        (F.col("n") == 0).alias("passed"), "first.position", "first.new", "first.reference"
    )


def sample_count_diff(new_cells: DataFrame, ref_cells: DataFrame) -> DataFrame:
    """Cells per sample on both sides."""

    def counted(cells: DataFrame, name: str) -> DataFrame:
        return cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))

    both = counted(new_cells, "new").join(counted(ref_cells, "reference"), "sample_id", "full")
    return both.withColumn("passed", F.col("new").eqNullSafe(F.col("reference")))


def samples_check(new_cells: DataFrame, ref_cells: DataFrame, expected: int) -> DataFrame:
    """Equal counts per sample, and the expected number of samples on both sides."""
    per_sample = sample_count_diff(new_cells, ref_cells)
    return per_sample.agg(
        F.count("new").alias("new_samples"),
        F.count("reference").alias("reference_samples"),
        F.count_if(~F.col("passed")).alias("different"),
    ).withColumn(
        "passed",
        (F.col("new_samples") == expected)
        & (F.col("reference_samples") == expected)
        & (F.col("different") == 0),
    )


def identity_diff(new_cells: DataFrame, ref_cells: DataFrame) -> DataFrame:
    """Uniqueness, extra and missing keys with an example, and equal row order.

    Order is compared only if both sides carry a ``position`` column.
    """
    ordered = "position" in new_cells.columns and "position" in ref_cells.columns

    def keyed(cells: DataFrame, side: str) -> DataFrame:
        place = F.min("position") if ordered else F.lit(None).cast("long")
        return cells.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias(f"n_{side}"), place.alias(f"at_{side}")
        )

    joined = keyed(new_cells, "new").join(keyed(ref_cells, "ref"), KEY, "full")
    extra, missing = F.col("n_ref").isNull(), F.col("n_new").isNull()
    name = F.concat_ws(":", *KEY)

    def example(rule: Column, place: str) -> Column:
        first = F.struct(F.col(place) if ordered else F.lit(0), name.alias("name"))
        return F.min(F.when(rule, first)).getField("name")

    report = joined.agg(
        F.coalesce(F.max("n_new") <= 1, F.lit(True)).alias("new_unique"),
        F.coalesce(F.max("n_ref") <= 1, F.lit(True)).alias("reference_unique"),
        F.count_if(extra).alias("extra_in_new"),
        F.count_if(missing).alias("missing_from_new"),
        example(extra, "at_new").alias("first_extra"),
        example(missing, "at_ref").alias("first_missing"),
        F.count_if(~F.col("at_new").eqNullSafe(F.col("at_ref"))).alias("moved"),
    )
    passed = (
        F.col("new_unique")
        & F.col("reference_unique")
        & (F.col("extra_in_new") == 0)
        & (F.col("missing_from_new") == 0)
    )
    same = passed & (F.col("moved") == 0) if ordered else F.lit(None).cast("boolean")
    return report.withColumn("passed", passed).withColumn("same_order", same).drop("moved")


def conditions_by_sample(cells: DataFrame) -> DataFrame:
    """Each sample with each of its conditions; more than one row is a conflict."""
    return cells.groupBy("sample_id", text("condition").alias("condition")).agg(
        F.count(F.lit(1)).alias("n_cells")
    )


def paired_cells(new_cells: DataFrame, ref_cells: DataFrame) -> DataFrame:
    """Cells on both sides, each side's other columns as one struct: ``n`` and ``r``.

    Several checks may share one such table; each of them is then one aggregation.
    """

    def side(cells: DataFrame, name: str) -> DataFrame:
        return cells.select(*KEY, F.struct(*[column(c) for c in cells.columns if c not in KEY]).alias(name))

    return side(new_cells, "n").join(side(ref_cells, "r"), KEY)


def condition_diff(new_cells: DataFrame, ref_cells: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Blank, differing and conflicting conditions, over cells on both sides."""
    pairs = paired_cells(new_cells, ref_cells) if pairs is None else pairs
    per_sample = (
        pairs.select("sample_id", text("n.condition").alias("new"), text("r.condition").alias("ref"))
        .groupBy("sample_id")
        .agg(
            F.count_if(F.col("new") == "").alias("new_missing"),
            F.count_if(F.col("ref") == "").alias("reference_missing"),
            F.count_if(F.col("new") != F.col("ref")).alias("mismatched"),
            (F.min("new") != F.max("new")).alias("new_conflict"),
            (F.min("ref") != F.max("ref")).alias("reference_conflict"),
        )
    )
    zero = F.lit(0)
    report = per_sample.agg(
        *[
            F.coalesce(F.sum(c), zero).alias(c)
            for c in ("new_missing", "reference_missing", "mismatched")
        ],
        F.count_if("new_conflict").alias("new_conflicts"),
        F.count_if("reference_conflict").alias("reference_conflicts"),
    )
    return report.withColumn("passed", reduce(lambda p, q: p & q, [F.col(c) == 0 for c in report.columns]))


def label_diff(
    new_cells: DataFrame, ref_cells: DataFrame, fields=REQUIRED_LABELS, pairs: DataFrame | None = None
) -> DataFrame:
    """Blank and differing labels per field, from one join and one aggregation."""
    absent = [f for f in fields if f not in new_cells.columns or f not in ref_cells.columns]
    present = [f for f in fields if f not in absent]
    pairs = paired_cells(new_cells, ref_cells) if pairs is None else pairs
    both = pairs.select(*[text(f"{side[0]}.{f}").alias(f"{side}_{f}") for side in ("new", "ref") for f in present])
    measured = [
        F.struct(
            F.lit(f).alias("field"),
            F.count_if(F.col(f"new_{f}") == "").alias("missing_or_empty"),
            F.count_if(F.col(f"new_{f}") != F.col(f"ref_{f}")).alias("mismatched"),
        )
        for f in present
    ]
    unknown = [
        F.struct(
            F.lit(f).alias("field"),
            F.lit(None).cast("long").alias("missing_or_empty"),
            F.lit(None).cast("long").alias("mismatched"),
        )
        for f in absent
    ]
    rows = both.agg(F.array(*measured, *unknown).alias("rows")).select(F.inline("rows"))
    clean = (F.col("missing_or_empty") == 0) & (F.col("mismatched") == 0)
    return rows.withColumn("passed", F.coalesce(clean, F.lit(False)))


def _pairing(name: str, new, ref, atol: float) -> Column:
    """Aggregate of one coordinate pairing; only the new side must be finite.

    An undefined difference is not a mismatch and does not count for the
    largest difference, unlike in Spark's own ordering of NaN.
    """
    finite = reduce(lambda p, q: p & q, [is_finite(c) for c in new])
    gaps = [F.abs(F.col(a) - F.col(b)) for a, b in zip(new, ref)]
    defined = [F.when(~F.isnan(gap), gap) for gap in gaps]
    far = reduce(lambda p, q: p | q, [F.coalesce(gap > atol, F.lit(False)) for gap in defined])
    return F.struct(
        F.lit(name).alias("pairing"),
        F.count_if(~finite).alias("nonfinite_rows"),
        F.count_if(~finite | far).alias("mismatched_rows"),
        F.coalesce(F.max(F.greatest(*defined)), F.lit(0.0)).alias("max_abs_difference"),
    )


def coordinate_diff(
    new_cells: DataFrame, ref_cells: DataFrame, atol: float = 1e-6, pairs: DataFrame | None = None
) -> DataFrame:
    """Centroids and spatial coordinates against the other side and each other."""
    if atol < 0:
        raise ValueError("the coordinate tolerance must not be negative")
    places = (*CENTROID, "x", "y")
    pairs = paired_cells(new_cells, ref_cells) if pairs is None else pairs
    both = pairs.select(
        *[F.col(f"{side[0]}.{c}").cast("double").alias(f"{side}_{c}") for side in ("new", "ref") for c in places]
    )
    new_centroid, ref_centroid = [[f"{s}_{c}" for c in CENTROID] for s in ("new", "ref")]
    new_spatial, ref_spatial = [[f"{s}_{c}" for c in ("x", "y")] for s in ("new", "ref")]
    pairings = F.array(
        _pairing("centroids_vs_reference", new_centroid, ref_centroid, atol),
        _pairing("spatial_vs_reference", new_spatial, ref_spatial, atol),
        _pairing("new_spatial_vs_centroids", new_spatial, new_centroid, atol),
    )
    rows = both.agg(pairings.alias("rows")).select(F.inline("rows"))
    return rows.withColumn("passed", F.col("mismatched_rows") == 0)


def count_entries(new_counts: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """Entries whose canonical count differs, absent ones counting as zero."""
    a = canonical_counts(new_counts).withColumnRenamed("n", "new")
    b = canonical_counts(ref_counts).withColumnRenamed("n", "reference")
    return (
        a.join(b, [*KEY, "gene"], "full")
        .na.fill(0, ["new", "reference"])
        .where("new <> reference")
    )


def count_diff(new_counts: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """Cells and entries with different counts, and the first such cell."""
    per_cell = count_entries(new_counts, ref_counts).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("entries")
    )
    return per_cell.agg(
        F.count(F.lit(1)).alias("mismatched_rows"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("mismatched_entries"),
        F.min(F.struct(*KEY)).alias("first"),
    ).select(
        (F.col("mismatched_rows") == 0).alias("passed"),
        "mismatched_rows",
        "mismatched_entries",
        F.col("first.sample_id").alias("first_sample"),
        F.col("first.cell_id").alias("first_cell"),
    )


def row_digest(counts: DataFrame) -> DataFrame:
    """A short fingerprint of each cell's canonical counts.

    Entry hashes are added up, so the aggregation is combined before the shuffle
    and needs neither order nor a list of entries. Two independent 64-bit sums
    and the number of entries together identify a row.
    """
    return (
        canonical_counts(counts)
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.sum(F.xxhash64("gene", "n").cast("decimal(38,0)")).alias("sum_a"),
            F.sum(F.xxhash64("n", "gene", F.lit("second")).cast("decimal(38,0)")).alias("sum_b"),
        )
    )


def digest_diff(new_counts: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """Cells whose fingerprints differ or exist on one side only."""
    facts = ["entries", "sum_a", "sum_b"]
    a = row_digest(new_counts).select(*KEY, F.struct(*facts).alias("new"))
    b = row_digest(ref_counts).select(*KEY, F.struct(*facts).alias("reference"))
    joined = a.join(b, KEY, "full")
    return joined.where(~F.col("new").eqNullSafe(F.col("reference"))).select(*KEY)


DIGEST = ("entries", "sum_a", "sum_b")


def digest_blocks(digests: DataFrame) -> DataFrame:
    """Digests of cells added up to blocks of a sample: ``(sample_id, block, cells, entries, sum_a, sum_b)``.

    A block holds the cells whose id's MD5 starts alike; what is added up are hashes of a cell's id
    with its digest, so blocks of different cells differ too.
    """
    block = F.substring(F.md5(F.col("cell_id").cast("string")), 1, 2).alias("block")
    cell = [F.xxhash64("cell_id", *DIGEST, F.lit(salt)).cast("decimal(38,0)") for salt in ("a", "b")]
    return digests.groupBy("sample_id", block).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("entries").alias("entries"), F.sum(cell[0]).alias("sum_a"), F.sum(cell[1]).alias("sum_b")
    )


def _sides(new: DataFrame, ref: DataFrame, keys) -> DataFrame:
    """Both sides' facts about equal keys, ``new`` and ``reference``, one null if a side lacks the key."""
    a, b = [t.select(*keys, F.struct(*[c for c in t.columns if c not in keys]).alias(name)) for t, name in ((new, "new"), (ref, "reference"))]
    return a.join(b, list(keys), "full")


def digest_levels(new_counts: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """Which samples and which of their blocks are equal: ``(level, sample_id, block, new_cells, reference_cells, equal)``."""
    both = _sides(*[digest_blocks(row_digest(c)) for c in (new_counts, ref_counts)], ["sample_id", "block"])
    cells = [F.coalesce(F.col(f"{side}.cells"), F.lit(0)).alias(f"{side}_cells") for side in ("new", "reference")]
    blocks = cut(both.select("sample_id", "block", *cells, F.col("new").eqNullSafe(F.col("reference")).alias("equal")))
    samples = blocks.groupBy("sample_id").agg(
        F.sum("new_cells").alias("new_cells"), F.sum("reference_cells").alias("reference_cells"), F.bool_and("equal").alias("equal")
    )
    return blocks.withColumn("level", F.lit("block")).unionByName(
        samples.withColumns({"level": F.lit("sample"), "block": F.lit("")})
    ).select("level", "sample_id", "block", "new_cells", "reference_cells", "equal")


def count_diff_by_digest(new_counts: DataFrame, ref_counts: DataFrame, most: int = 500_000) -> DataFrame:
    """The result of :func:`count_diff` from digests: entries meet only where digests differ.

    Each side is read once for its cells' digests; blocks are compared first, then the cells of
    differing blocks. Entries of differing cells, if there are any, are read again; if more than
    ``most`` cells differ, they meet their cells and each other in parts bounded by rows.
    """
    new, ref = [cut(row_digest(c)) for c in (new_counts, ref_counts)]
    sizes = [t.agg(F.count(F.lit(1)), F.coalesce(F.sum("entries"), F.lit(0))).first() for t in (new, ref)]
    cells, entries = [max(column) for column in zip(*sizes)]
    both = _sides(digest_blocks(new), digest_blocks(ref), ["sample_id", "block"])
    open_ = small(both.where(~F.col("new").eqNullSafe(F.col("reference"))).select("sample_id", "block"))
    block = F.substring(F.md5(F.col("cell_id").cast("string")), 1, 2)
    inside = [t.withColumn("block", block).join(open_, ["sample_id", "block"], "left_semi").drop("block") for t in (new, ref)]
    sides = _sides(*[spread(t, cells, *KEY) for t in inside], KEY)
    differing = cut(sides.where(~F.col("new").eqNullSafe(F.col("reference"))).select(*KEY))
    n = differing.count()
    if n <= most:
        return count_diff(*[c.join(few(differing, n, most), KEY, "left_semi") for c in (new_counts, ref_counts)])
    dealt = [spread(canonical_counts(c), entries, *KEY) for c in (new_counts, ref_counts)]
    return count_diff(*[c.join(spread(differing, entries, *KEY), KEY, "left_semi") for c in dealt])


# The names of checks and pairings, in ``parity_report`` and above, are fixed values: the report's interface.
def _row(name: str, checked: DataFrame) -> DataFrame:
    """Fold the rows of a check into one report row."""
    metrics = F.to_json(F.collect_list(F.struct(*[c for c in checked.columns if c != "passed"])))
    return checked.agg(
        F.lit(name).alias("check"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        metrics.alias("metrics"),
    )


def parity_report(
    new: dict[str, DataFrame],
    reference: dict[str, DataFrame],
    expected_samples: int = 12,
    atol: float = 1e-6,
) -> DataFrame:
    """All checks, one row each.

    Without matching identities the checks that need aligned cells are skipped;
    without matching shape or genes the count check is. A skipped check fails.
    """
    if expected_samples < 1:
        raise ValueError("the expected number of samples must be positive")
    for side, tables in (("new", new), ("reference", reference)):
        for name in ("cells", "genes", "counts"):
            if name not in tables:
                raise KeyError(f"the {side} cohort has no {name} table")
    spark = new["cells"].sparkSession

    def skipped(name: str, reason: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(name).alias("check"), F.lit(False).alias("passed"), F.lit(reason).alias("metrics")
        )

    shape = shape_diff(new["cells"], new["genes"], reference["cells"], reference["genes"])
    rows = max(side["cells"].count() for side in (new, reference))
    sides = [spread(side["cells"], rows, *KEY) for side in (new, reference)]
    first = reduce(
        DataFrame.unionByName,
        [
            _row("shape", shape),
            _row("gene_order", feature_order_diff(new["genes"], reference["genes"])),
            _row("samples", samples_check(new["cells"], reference["cells"], expected_samples)),
            _row("cell_identity", identity_diff(*sides)),
        ],
    )
    first = cut(first)
    passed = {row["check"]: row["passed"] for row in first.collect()}
    later = [first]
    if not passed["cell_identity"]:
        reason = "the two sides do not list the same cells"
        later += [skipped(n, reason) for n in ("conditions", "metadata", "coordinates", "raw_counts")]
    else:
        pairs = cut(paired_cells(*sides))
        later += [
            _row("conditions", condition_diff(*sides, pairs=pairs)),
            _row("metadata", label_diff(*sides, pairs=pairs)),
            _row("coordinates", coordinate_diff(*sides, atol, pairs=pairs)),
        ]
        if not (passed["shape"] and passed["gene_order"]):
            later.append(skipped("raw_counts", "sizes or genes differ between the sides"))
        else:
            later.append(_counts_row(new["counts"], reference["counts"], skipped))
    return reduce(DataFrame.unionByName, later)


def _counts_row(new_counts: DataFrame, ref_counts: DataFrame, failed) -> DataFrame:
    for counts in (new_counts, ref_counts):
        try:
            require(count_violations(counts.groupBy(*KEY, "gene").agg(F.sum("n").alias("n"))))
        except CheckFailed as error:
            return failed("raw_counts", str(error))
    return _row("raw_counts", count_diff_by_digest(new_counts, ref_counts))


def report_status(report: DataFrame) -> str:
    """``pass`` if every check passed, else ``fail``."""
    return "pass" if report.where(~F.col("passed")).isEmpty() else "fail"
