"""Reading, checking, aligning, curating and comparing small cohorts."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from histomesh.functions import ids
from histomesh.lineage import scratch_path
from histomesh.operators import align as a
from histomesh.operators import checks as q
from histomesh.operators import domains as d
from histomesh.operators import normalize as m
from histomesh.operators import parity as p
from histomesh.operators import roles
from histomesh.plans import cohort, stages
from histomesh.sources import scans, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as handle:
        handle.write(text)


def bundle(root, sample, genes, cells, entries, condition=None):
    folder = root / sample
    lines = ["%%MatrixMarket matrix coordinate integer general", "% note", f"{len(genes)} {len(cells)} {len(entries)}"]
    write(folder / "counts.mtx.gz", "\n".join(lines + [" ".join(map(str, e)) for e in entries]) + "\n")
    write(folder / "genes.tsv.gz", "".join(f"{g}\tid-{g}\n" for g in genes))
    write(folder / "barcodes.tsv.gz", "".join(f"{x}\n" for x in cells))
    head = "cell_id,cell_type" + (",condition" if condition else "")
    # Metadata in another order than the matrix, with a surplus row.
    body = [f"{x},type-{x}" + (f",{condition}" if condition else "") for x in reversed([*cells, "spare"])]
    write(folder / "obs.csv.gz", "\n".join([head, *body]) + "\n")
    places = [f"{x},{i + 0.5},{10 * i}" for i, x in reversed(list(enumerate(cells)))]
    write(folder / "spatial.csv.gz", "\n".join(["cell_id,x,y", *places]) + "\n")


def files(root):
    names = {"counts": "counts.mtx.gz", "genes": "genes.tsv.gz", "barcodes": "barcodes.tsv.gz", "obs": "obs.csv.gz", "spatial": "spatial.csv.gz"}
    return {key: f"{root}/*/{name}" for key, name in names.items()}


@pytest.fixture
def root(tmp_path):
    bundle(tmp_path, "s a", ["G1", "G2"], ["c1", "c2"], [(1, 1, 1), (1, 2, 2), (2, 2, 3), (2, 2, 4)])
    bundle(tmp_path, "s+b", ["G2", "G3"], ["c1", "c2"], [(1, 1, 4), (2, 2, 5)])
    return tmp_path


@pytest.fixture
def sheet(spark):
    return spark.createDataFrame([("s a", "ctrl", "p1"), ("s+b", "drug", "p2")], "sample_id string, condition string, input_path string")


def test_cohort_from_bundles(spark, root, sheet):
    built = cohort.build_cohort(spark, files(root), sheet, target=10.0, join="outer")
    cells = {(x["sample_id"], x["cell_id"]): x for x in built["cells"].collect()}
    assert len(cells) == 4 and cells["s a", "c2"]["cell_type"] == "type-c2"
    assert (cells["s a", "c1"]["x"], cells["s+b", "c2"]["y"]) == (0.5, 10.0)
    assert cells["s+b", "c1"]["condition"] == "drug"
    x = {(r["sample_id"], r["cell_id"], r["gene"]): r for r in built["expression"].collect()}
    assert x["s a", "c2", "G2"]["n"] == 7  # repeated entries add up
    assert x["s a", "c2", "G1"]["x"] == pytest.approx(math.log1p(2 * 10 / 9))
    assert sorted(r["gene"] for r in built["genes"].collect()) == ["G1", "G2", "G3"]

    inner = cohort.build_cohort(spark, files(root), sheet, target=10.0)
    assert {r["gene"] for r in inner["expression"].collect()} == {"G2"}
    kept = inner["expression"].where("sample_id = 's a' and cell_id = 'c2'").first()
    assert kept["x"] == pytest.approx(x["s a", "c2", "G2"]["x"])  # not rescaled

    path = scratch_path(spark, "cohort")
    cohort.write_cohort(built, path)
    assert spark.read.parquet(f"{path}/cells").count() == 4
    facts = {(r["fact"], r["label"]): r["n"] for r in spark.read.json(f"{path}/manifest").collect()}
    assert facts["cells", ""] == 4 and facts["genes", ""] == 3 and facts["sample", "s a"] == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        cohort.write_cohort(built, path)


def test_cohort_refuses_what_does_not_fit(spark, root, sheet, tmp_path):
    with pytest.raises(q.CheckFailed, match="sheet"):
        cohort.build_cohort(spark, files(root), sheet.where("condition = 'ctrl'"))
    other = tmp_path / "other"
    bundle(other, "s a", ["G1", "G1"], ["c1", "c2"], [(3, 1, 1)])
    with pytest.raises(q.CheckFailed, match="duplicate_key|index_range"):
        cohort.build_cohort(spark, files(other), sheet)


def test_cut_off_matrix_is_refused(spark, root, sheet):
    with gzip.open(root / "s+b" / "counts.mtx.gz", "rt") as handle:
        lines = handle.read().splitlines()
    write(root / "s+b" / "counts.mtx.gz", "\n".join(lines[:-1]) + "\n")
    with pytest.raises(q.CheckFailed, match="entries"):
        cohort.build_cohort(spark, files(root), sheet)


def test_contradicting_sample_label_is_refused(spark, root, sheet):
    for sample in ("s a", "s+b"):
        write(root / sample / "obs.csv.gz", "cell_id,sample_id\nc1,s a\nc2,s a\n")
    with pytest.raises(q.CheckFailed, match="stated_sample"):
        cohort.build_cohort(spark, files(root), sheet)
    write(root / "s+b" / "obs.csv.gz", "cell_id,sample_id\nc1,s+b\nc2,s+b\n")
    built = cohort.build_cohort(spark, files(root), sheet)
    assert built["cells"].count() == 4 and "stated_sample" not in built["cells"].columns


def test_parts_lie_where_the_manifest_says(spark):
    cells = spark.createDataFrame([("b/x", "1", "c"), ("a", "1", "c"), ("a", "2", "c")], "sample_id string, cell_id string, condition string")
    path = scratch_path(spark, "parts")
    manifest = sinks.part_manifest(cells)
    sinks.write_parts(cells, manifest, path)
    for row in manifest.collect():
        part = spark.read.parquet(f"{path}/{row['bundle_dir']}")
        assert {r["sample_id"] for r in part.collect()} == {row["sample_id"]} and part.count() == row["n_cells"]


def test_columns_with_dots_and_ticks(spark):
    odd = spark.createDataFrame([("s", "c", 1.5, 2.0, 3.0, "t")], "sample_id string, cell_id string, `percent.mt` double, x double, y double, `a``b` string")
    assert roles.with_coordinates(odd).first()["percent.mt"] == 1.5
    bound = roles.bind_roles(odd, roles.Roles(condition=None, cell_type="a`b", compartment=None))
    assert bound.first()["cell_type"] == "t" and bound.first()["percent.mt"] == 1.5
    assert roles.embedding_array(odd).first()["embedding"] == [1.5, 2.0, 3.0]


def test_bundles_survive_a_round_trip_in_pieces(spark):
    cells = spark.range(40).select(
        F.concat(F.lit("s "), F.col("id") % 2).alias("sample_id"), F.col("id").cast("string").alias("cell_id"),
        F.lit("a,\"b\"").alias("note"), F.col("id").cast("double").alias("x"), (F.col("id") / 3).alias("y"),
    )
    counts = cells.select("sample_id", "cell_id", F.concat(F.lit("G"), F.col("x").cast("int") % 3).alias("gene"), (F.col("x") + 1).cast("int").alias("n"))
    path = scratch_path(spark, "bundles")
    sinks.write_bundles(cells, counts, counts, path, cells_per_bundle=6)
    triplets, sizes = scans.read_triplets(spark, f"{path}/counts")
    genes, names = (scans.read_dictionary(spark, f"{path}/{n}") for n in ("genes", "barcodes"))
    assert sizes.count() > 4
    assert q.dimension_violations(triplets, genes, names, sizes).isEmpty()
    back = scans.named_counts(triplets, genes, names).select("sample_id", "cell_id", "gene", F.col("n").cast("int"))
    assert back.exceptAll(counts).isEmpty() and counts.exceptAll(back).isEmpty()
    obs = scans.read_sample_metadata(spark, f"{path}/obs")
    assert obs.select("note").distinct().first()[0] == 'a,"b"' and obs.count() == 40


def test_bundles_compute_cells_and_counts_once(spark):
    """What bundles are written from is computed once, and a task opens few files however short they are."""
    seen = {name: spark.sparkContext.accumulator(0) for name in ("cells", "counts")}

    def watched(df, name):
        total = seen[name]
        return spark.createDataFrame(df.rdd.map(lambda row: (total.add(1), row)[1]), df.schema)

    cells = spark.range(40).select(F.lit("s").alias("sample_id"), F.col("id").cast("string").alias("cell_id"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"))
    counts = cells.select("sample_id", "cell_id", F.concat(F.lit("G"), F.col("x").cast("int") % 3).alias("gene"), F.lit(2).alias("n"))
    path = scratch_path(spark, "bundles")
    sinks.write_bundles(watched(cells, "cells"), watched(counts, "counts"), counts, path, cells_per_bundle=6)
    assert {name: total.value for name, total in seen.items()} == {"cells": 40, "counts": 40}
    lines = spark.range(70).selectExpr("id AS shard", "'s' AS sample_id", "0 AS place", "'v' AS value")
    assert sinks._by_bundle(lines, 70, 1000).rdd.getNumPartitions() == 101


def test_entries_are_read_as_they_stand(spark, tmp_path):
    """Repeats stay apart until triplets add them up; comments, blank and indented lines are none."""
    (tmp_path / "s").mkdir()
    write(tmp_path / "s" / "counts.mtx.gz", "%%MatrixMarket\n\n  2 2  3 \n1 1 4\n1\t1 5\n\t9 9 9\n%x\n2 2 6\n")
    entries, sizes = scans.read_entries(spark, f"{tmp_path}/*/counts.mtx.gz")
    assert sorted(tuple(r)[2:] for r in entries.collect()) == [(1, 1, 4.0), (1, 1, 5.0), (2, 2, 6.0)]
    assert sizes.select("sample_id", "n_genes", "n_cells", "n_entries", "n_lines").collect() == [("s", 2, 2, 3, 3)]
    triplets, _ = scans.read_triplets(spark, f"{tmp_path}/*/counts.mtx.gz")
    assert sorted(tuple(r)[2:] for r in triplets.collect()) == [(1, 1, 9.0), (2, 2, 6.0)]


def test_count_rules(spark):
    values = [("ok", 7.0), ("neg", -1.0), ("nan", float("nan")), ("big", 2147483648.0), ("half", 1.5), ("near", 3.0 + 1e-9)]
    counts = spark.createDataFrame(values, "cell string, n double")
    found = {r["key"]: r["check"] for r in q.count_violations(counts, ["cell"]).collect()}
    assert found == {"neg": "finite_nonnegative", "nan": "finite_nonnegative", "big": "storage_range", "half": "whole_number", "near": "whole_number"}
    assert q.count_violations(counts, ["cell"], tol=1e-8).where("key = 'near'").isEmpty()
    assert q.count_violations(counts.limit(0), ["cell"]).isEmpty()


def test_label_and_condition_rules(spark):
    cells = spark.createDataFrame([("s", "ctrl", "A"), ("s", "drug", None)], "sample_id string, condition string, cell_type string")
    with pytest.raises(KeyError, match="region"):
        q.label_violations(cells, ["region"])
    with pytest.raises(q.CheckFailed, match="missing_label"):
        q.require(q.label_violations(cells, ["cell_type"]))
    with pytest.raises(q.CheckFailed, match="one_condition"):
        q.require(q.condition_conflicts(cells))
    q.require(q.condition_conflicts(cells.where("condition = 'ctrl'")))


def test_roles_and_coordinates(spark):
    df = spark.createDataFrame([(1, "c", "x", 2.0, 3.0, 9.0)], "specimen int, barcode string, treatment string, centroid_x double, centroid_y double, x double")
    bound = roles.bind_roles(df, roles.Roles("specimen", "barcode", "treatment", None, None, None))
    assert bound.first()["sample_id"] == "1" and "x" in bound.columns
    assert roles.with_coordinates(df).select("x", "y").first() == (2.0, 3.0)
    with pytest.raises(KeyError):
        roles.bind_roles(df, roles.Roles())
    with pytest.raises(ValueError):
        roles.with_coordinates(df.select("x"))


def test_id_expressions(spark):
    df = spark.createDataFrame([("a_1_22_3",), ("src:x:y",), ("plain",), (None,)], "id string")
    rows = df.select(ids.without_merge_suffix("id"), ids.merge_depth("id"), ids.after_colon("id"), ids.text("id")).collect()
    assert tuple(rows[0]) == ("a", 3, "", "a_1_22_3")
    assert rows[1][2] == "x:y" and rows[2][1] == 0 and rows[3][3] == ""


def test_alignment_is_complete_or_refused(spark):
    left = spark.createDataFrame([("s", "1"), ("s", "2")], "sample_id string, cell_id string")
    right = spark.createDataFrame([("s", "2", "B"), ("s", "1", "A"), ("s", "9", "Z")], "sample_id string, cell_id string, t string")
    assert sorted(r["t"] for r in a.align(left, right).collect()) == ["A", "B"]
    with pytest.raises(q.CheckFailed, match="missing 1"):
        a.align(left, right.where("t <> 'A'"))
    with pytest.raises(q.CheckFailed, match="duplicate"):
        a.align(left, right.union(right))
    with pytest.raises(q.CheckFailed, match="already exist"):
        a.attach_annotations(left.withColumn("t", F.lit(1)), right)


def curation_inputs(spark):
    fields = "source_id string, sample_id string, cell_id string, condition string, cluster_sub string, celltype_short string, celltype_full string, centroid_x double, centroid_y double"
    rows = [
        ("f1", "m1", "same-1", "ctrl", "c1", "T", "T one", 1.0, 2.0), ("f1", "m1", "x_y", "ctrl", "c2", "T", "T two", 3.0, 4.0),
        ("f2", "m2", "same-1", "drug", "c1", "B", "B one", 5.0, 6.0), ("f2", "m2", "z-2", "drug", "c3", "B", "B two", 7.0, 8.0),
    ]
    sources = spark.createDataFrame(rows, fields)
    tails = {"m1": "_1_1_1", "m2": "_2_2"}
    base = spark.createDataFrame([(r[1], r[2] + tails[r[1]], "old", 9.5) for r in rows], "sample_id string, cell_id string, condition string, score double")
    sheet = spark.createDataFrame([("m1", " ctrl", "f1"), ("m2", "drug", "f2 ")], "sample_id string, condition string, input_path string")
    return base, sources, sheet


def test_curation_needs_permission_and_is_then_complete(spark):
    base, sources, sheet = curation_inputs(spark)
    with pytest.raises(q.CheckFailed, match="would match completely"):
        stages.run_curation(base, sources, sheet)
    done = stages.run_curation(base, sources, sheet, allow_merge_suffix=True)
    rows = {(r["sample_id"], r["cell_id"]): r for r in done["cells"].collect()}
    assert rows["m2", "same-1"]["celltype_full"] == "B one" and rows["m2", "same-1"]["condition"] == "drug"
    assert all(r["score"] == 9.5 for r in rows.values())
    report = done["identity"].first()
    assert (report["ids_changed"], report["max_depth"], report["exact"]) == (4, 3, False)
    with pytest.raises(q.CheckFailed, match="source_condition"):
        stages.run_curation(base, sources, sheet.replace("drug", "other"), True)
    with pytest.raises(q.CheckFailed, match="differ"):
        stages.run_curation(base.where("sample_id = 'm1'"), sources, sheet, True)


def test_coordinates_come_from_the_first_complete_source(spark):
    cells = spark.createDataFrame([("s", "1", "n1"), ("s", "2", "n2")], "sample_id string, cell_id string, cell_name string")
    partial = spark.createDataFrame([("s", "1", 0.0, 0.0)], "sample_id string, cell_id string, x double, y double")
    infinite = spark.createDataFrame([("s", "n1", 1.0, 1.0), ("s", "n2", float("inf"), 1.0)], "sample_id string, cell_name string, x double, y double")
    image = spark.createDataFrame([("s", "1", 3.0, 4.0), ("s", "2", 5.0, 6.0)], "sample_id string, cell_id string, imagecol double, imagerow double")
    rows = a.first_complete_coordinates(cells, [partial, infinite, image]).collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(3.0, 4.0), (5.0, 6.0)]
    with pytest.raises(q.CheckFailed):
        a.first_complete_coordinates(cells, [partial, infinite])


PLACES = [("p", 0), ("p", 1), ("p", 2), ("q", 3), ("q", 4), ("r", 5)]
PANEL = ["H1", "H2", "H3", "H4", "H5"]


def parity_side(spark, conditions=("wild", "wild", "wild", "knocked", "knocked", "treated"), extra=0, order=(0, 1, 2, 3, 4, 5), shift=0.0):
    """Six cells in three samples; every value follows from the number of the cell."""
    rows = []
    for place, i in enumerate(order):
        x, y = 10.0 - 1.5 * i + shift, 0.25 * i * i
        rows.append((PLACES[i][0], f"n{i}", conditions[i], f"k{7 * i % 5}", f"t{i % 3}", f"type {i % 3}", x, y, x, y, place))
    fields = "sample_id string, cell_id string, condition string, cluster_sub string, celltype_short string, celltype_full string, centroid_x double, centroid_y double, x double, y double, position long"
    counts = [(s, f"n{i}", g, (3 * i + 2 * k) % 4 + (extra if (i, k) == (4, 3) else 0)) for s, i in PLACES for k, g in enumerate(PANEL) if (i + k) % 2]
    return {
        "cells": spark.createDataFrame(rows, fields),
        "genes": spark.createDataFrame(list(enumerate(PANEL)), "position long, gene string"),
        "counts": spark.createDataFrame(counts, "sample_id string, cell_id string, gene string, n long"),
    }


def outcome(report):
    return {r["check"]: r["passed"] for r in report.collect()}


def test_parity_of_a_permuted_copy(spark):
    new, old = parity_side(spark, order=(4, 1, 5, 0, 3, 2)), parity_side(spark)
    report = p.parity_report(new, old, expected_samples=3)
    assert p.report_status(report) == "pass"
    identity = p.identity_diff(new["cells"], old["cells"]).first()
    assert identity["passed"] and not identity["same_order"]


@pytest.mark.parametrize(
    "change, failing",
    [
        ({"extra": 1}, {"raw_counts"}),
        ({"conditions": ("wild",) * 6}, {"conditions"}),
        ({"conditions": ("wild", "wild", "knocked", "knocked", "knocked", "treated")}, {"conditions"}),
        ({"shift": 1e-3}, {"coordinates"}),
    ],
)
def test_parity_finds_each_difference(spark, change, failing):
    report = p.parity_report(parity_side(spark, **change), parity_side(spark), expected_samples=3)
    assert {k for k, ok in outcome(report).items() if not ok} == failing
    assert p.report_status(report) == "fail"


def test_parity_skips_what_cannot_be_compared(spark):
    new, old = parity_side(spark), parity_side(spark)
    fewer = {**new, "cells": new["cells"].where("cell_id <> 'n2'")}
    result = outcome(p.parity_report(fewer, old, expected_samples=3))
    assert result["gene_order"] and not any(v for k, v in result.items() if k != "gene_order")
    renamed = {**new, "genes": new["genes"].replace("H4", "h4")}
    result = outcome(p.parity_report(renamed, old, expected_samples=3))
    assert {k for k, ok in result.items() if not ok} == {"gene_order", "raw_counts"}
    first = p.feature_order_diff(renamed["genes"], old["genes"]).first()
    assert (first["position"], first["new"], first["reference"]) == (3, "h4", "H4")
    shorter = p.feature_order_diff(new["genes"].where("position < 4"), old["genes"]).first()
    assert (shorter["position"], shorter["new"]) == (4, None)
    broken = {**new, "counts": new["counts"].withColumn("n", F.col("n") + 0.5)}
    assert outcome(p.parity_report(broken, old, expected_samples=3))["raw_counts"] is False


def test_undefined_expected_coordinates_are_not_a_mismatch(spark):
    new, old = parity_side(spark)["cells"], parity_side(spark)["cells"]
    undefined = old.withColumn("x", F.lit(float("nan")))
    rows = {r["pairing"]: r for r in p.coordinate_diff(new, undefined).collect()}
    assert rows["spatial_vs_reference"]["passed"] and rows["spatial_vs_reference"]["max_abs_difference"] == 0.0
    rows = {r["pairing"]: r for r in p.coordinate_diff(undefined, old).collect()}
    assert rows["spatial_vs_reference"]["nonfinite_rows"] == 6


def test_digests_agree_with_entries(spark):
    new, old = parity_side(spark, extra=1)["counts"], parity_side(spark)["counts"]
    assert [tuple(r) for r in p.digest_diff(new, old).collect()] == [("q", "n4")]
    assert p.digest_diff(old, old.repartition(3)).isEmpty()


def test_normalisation_edges(spark):
    counts = spark.createDataFrame([("s", "a", "G", 0), ("s", "b", "G", 3), ("s", "b", "H", 1)], "sample_id string, cell_id string, gene string, n int")
    rows = {(r["cell_id"], r["gene"]): r["x"] for r in m.log_normalize(counts, 4.0).collect()}
    assert rows["a", "G"] == 0.0 and rows["b", "H"] == pytest.approx(0.6931471805599453)
    with pytest.raises(ValueError):
        m.log_normalize(counts, 0)
    features = spark.createDataFrame([("G", None, "Gene Expression"), ("H", "h1", "Control")], "gene string, feature_id string, feature_type string")
    kept = m.filter_features(counts, features).collect()
    assert {r["gene"] for r in kept} == {"G"} and kept[0]["feature_id"] == "G"
    with pytest.raises(q.CheckFailed):
        m.select_features(features, "Protein")


def test_representation_is_centred_within_samples(spark):
    rows = [(f"s{i % 2}", str(i), g, float((i * k) % 7 + (i % 2) * 50)) for i in range(20) for k, g in ((1, "G"), (3, "H"), (5, "I"))]
    x = spark.createDataFrame(rows, "sample_id string, cell_id string, gene string, x double")
    scores = m.pca_representation(x, x.select("sample_id", "cell_id").distinct(), 2)
    means = scores.groupBy("sample_id").agg(F.avg(F.col("embedding")[0]).alias("m")).collect()
    assert len(means) == 2 and all(abs(r["m"]) < 1e-9 for r in means)


def test_representation_is_reused_or_made(spark):
    x = spark.createDataFrame([("s", "1", "G", 2.0), ("s", "2", "H", 3.0)], "sample_id string, cell_id string, gene string, x double")
    cells = spark.createDataFrame([("s", "1", [9.0]), ("s", "2", [8.0]), ("s", "3", [7.0])], "sample_id string, cell_id string, own array<double>")
    plain = {r["cell_id"]: r["embedding"] for r in m.cell_representation(cells, x, "X").collect()}
    assert plain == {"1": [2.0, 0.0], "2": [0.0, 3.0], "3": [0.0, 0.0]}
    assert {r["embedding"][0] for r in m.cell_representation(cells, x, "own").collect()} == {9.0, 8.0, 7.0}
    assert len(m.cell_representation(cells, x, "X_pca", k=1).first()["embedding"]) == 1
    with pytest.raises(ValueError):
        m.pca_representation(x, cells, 3)


def test_label_agreement_by_hand(spark):
    pairs = spark.createDataFrame([("0", "0"), ("0", "0"), ("0", "1"), ("1", "1")], "a string, b string")
    # One pair together in both; three and two together in each.
    assert d.label_agreement(pairs).first()["agreement"] == pytest.approx(1 / 6**0.5)


def test_domain_stage(spark):
    rows = [
        (f"s{i % 2}", str(i), "ctrl" if i % 2 else "drug", "T", float(i % 8), float(i // 8) + 0.01 * (i % 5), [float(10 * (i // 32)) + 0.1 * (i % 7), 0.2 * (i % 3)])
        for i in range(64)
    ]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, condition string, cell_type string, x double, y double, embedding array<double>")
    done = stages.run_domains(cells, mode="knn", k=3, layers=1, reduce_to=2, min_k=2, max_k=2, runs=2, seed=1, max_iter=5)
    assert done["best_k"] == 2 and done["cells"].count() == 64
    stable = done["stability"].first()
    assert stable["n_comparisons"] == 2 * 2**2 and 0 <= stable["mean_stability"] <= 1
    tables = stages.run_composition(done["cells"], 3, 5.0, scratch_path(spark, "stage"))
    page = stages.review_page(tables)
    assert page["overview"].count() >= 2 and page["fraction_matrix"].count() >= 1
    with pytest.raises(ValueError):
        stages.spatial_graph(cells, "grid")


def test_results_reload_with_labels_as_text(spark):
    path = scratch_path(spark, "results")
    row = [("NA", "0", "1", "2", 1, 2, 3, 0.5, 0.25)]
    sinks.write_results(spark.createDataFrame(row, scans.ABUNDANCE_SCHEMA), path)
    back = scans.read_results(spark, path, scans.ABUNDANCE_SCHEMA).first()
    assert (back["condition"], back["sample"], back["compartment"]) == ("NA", "0", "1")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_results(spark.createDataFrame(row, scans.ABUNDANCE_SCHEMA), path)


def test_wrong_stability_parameters(spark):
    with pytest.raises(ValueError):
        d.fit_range(spark.range(1), 1, 3)


def blobs(spark, seed=3, n=600, d=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    places = rng.normal(0, 40, (4, d))
    at = rng.integers(0, 4, n)
    points = places[at] + rng.normal(0, 1, (n, d)) * np.array([1.0, 2.0, 0.5, 3.0])[at][:, None]
    rows = [(f"s{i % 3}", str(i), points[i].tolist()) for i in range(n)]
    return points, at, d_vectors(spark, rows)


def d_vectors(spark, rows):
    return d.as_vectors(spark.createDataFrame(rows, "sample_id string, cell_id string, features array<double>")).repartition(3)


def test_mixtures_fitted_together_equal_plain_steps(spark):
    """One scan advances all fits: the likelihood is that of the density, and the moments those of the groups."""
    import numpy as np

    points, at, vectors = blobs(spark)
    models = d.fit_many(vectors, [(4, 0), (4, 1), (2, 0)], seed=5, tol=1e-6)
    best = models[4, d.likeliest(models, 4)]
    for group in range(4):
        own = points[at == group]
        k = int(np.argmin(((best.means - own.mean(0)) ** 2).sum(1)))
        assert np.allclose(best.means[k], own.mean(0), atol=0.05) and np.allclose(best.covariances[k], np.cov(own.T, bias=True), atol=0.2)
        assert best.weights[k] == pytest.approx(len(own) / len(points), abs=0.01)
    for model in models.values():
        total = 0.0
        for x in points:
            dens = [w * np.exp(-0.5 * (x - m) @ np.linalg.solve(c, x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True)]
            total += np.log(sum(dens))
        assert model.log_likelihood == pytest.approx(total, rel=1e-3)
    labels = {r["cell_id"]: r["labels"] for r in d.stacked_labels(vectors, list(models.values())).collect()}
    for i, x in enumerate(points):
        for place, model in enumerate(models.values()):
            logs = [np.log(w) - 0.5 * (x - m) @ np.linalg.solve(c, x - m) - 0.5 * np.linalg.slogdet(c)[1] for w, m, c in zip(model.weights, model.means, model.covariances, strict=True)]
            assert labels[str(i)][place] == int(np.argmax(logs))


def test_search_does_not_depend_on_how_many_runs_share_a_scan(spark):
    _, _, vectors = blobs(spark, n=200)
    found = [d.search(vectors, 2, 5, 4, seed=1, max_iter=20, convergence=c, at_once=n) for c, n in ((None, 1), (None, 4), (0.05, 1), (0.05, 3))]
    tables = [{r["k"]: (round(r["mean_stability"], 9), r["n_comparisons"]) for r in s.stability.collect()} for s in found]
    assert tables[0] == tables[1] and tables[2] == tables[3] and len(tables[0]) == 4
    long, models = d.fit_range(vectors, 2, 5, 4, seed=1, max_iter=20, convergence=None)
    slow = {r["k"]: (round(r["mean_stability"], 9), r["n_comparisons"]) for r in d.stability(d.neighbour_agreements(long), 2, 5).collect()}
    assert slow == tables[0] and set(models) == set(found[0].models)


def test_all_runs_share_their_scans(spark, monkeypatch):
    """Where no run can be the last before the end, no fit or label waits for a run before it."""
    _, _, vectors = blobs(spark, n=200)
    calls, fit = [], d.fit_many
    monkeypatch.setattr(d, "fit_many", lambda v, fits, *rest: calls.append(len(fits)) or fit(v, fits, *rest))
    found = d.search(vectors, 2, 3, 4, seed=1, max_iter=5, convergence=None, at_once=2)
    assert calls == [3 * 4] and len(found.fits) == 3 * 4


def test_a_part_of_many_cells_leaves_few_scans_of_all(spark, monkeypatch):
    """Fits that a larger part took further end where those without it end, all cells scanned."""
    import numpy as np

    _, _, vectors = blobs(spark)
    whole = d.fit_many(vectors, [(4, 0), (4, 1)], seed=5, tol=1e-6)
    scans, climb = [], d._climbed
    monkeypatch.setattr(d, "MIDDLE", 64)
    monkeypatch.setattr(d, "_climbed", lambda *a: scans.append(a) or climb(*a))
    parted = d.fit_many(vectors, [(4, 0), (4, 1)], seed=5, tol=1e-6)
    assert len(scans) == 3
    best = d.likeliest(whole, 4)
    assert parted[4, best].log_likelihood == pytest.approx(whole[4, best].log_likelihood, rel=1e-3)
    assert np.allclose(sorted(parted[4, best].means.ravel()), sorted(whole[4, best].means.ravel()), atol=0.05)


def test_mixtures_of_few_or_equal_points(spark):
    equal = d_vectors(spark, [("s", str(i), [1.0, 2.0]) for i in range(5)])
    models = d.fit_many(equal, [(3, 0)], max_iter=4)
    assert abs(models[3, 0].means - [1.0, 2.0]).max() < 1e-6
    with pytest.raises(ValueError, match="no vectors"):
        d.fit_many(d_vectors(spark, []), [(2, 0)])


def test_components_equal_a_dense_decomposition(spark):
    import numpy as np

    from histomesh.operators import gram

    rng = np.random.default_rng(2)
    dense = rng.poisson(0.4, (80, 9)).astype(float)
    dense[7] = 0
    sample = np.arange(80) % 3
    rows = [(f"s{sample[i]}", str(i), f"g{j}", float(dense[i, j])) for i in range(80) for j in range(9) if dense[i, j]]
    x = spark.createDataFrame(rows, "sample_id string, cell_id string, gene string, x double").repartition(4)
    cells = spark.createDataFrame([(f"s{sample[i]}", str(i)) for i in range(80)], "sample_id string, cell_id string")
    centred = dense - np.array([dense[sample == s].mean(0) for s in range(3)])[sample]
    values, axes = np.linalg.eigh(centred.T @ centred)
    scores = {r["cell_id"]: r["embedding"] for r in m.pca_representation(x, cells, 4).collect()}
    wanted = np.abs(centred @ axes[:, ::-1][:, :4])
    assert np.allclose(np.abs([scores[str(i)] for i in range(80)]), wanted, atol=1e-8)
    entries, size = m.indexed_entries(x)
    rows = gram.sparse_rows(entries, ["sample_id", "cell_id"])
    for held in (8 * size, 8 * size * 3, 1 << 20):
        found = np.zeros((size, size))
        for r in gram.gram(rows, size, held).collect():
            found[r["i"]] = r["row"]
        assert np.allclose(found, dense.T @ dense)


def test_expression_itself_takes_any_panel(spark):
    genes = spark.range(70_000).select(F.format_string("g%05d", "id").alias("gene"))
    x = genes.select(F.lit("s").alias("sample_id"), F.lit("1").alias("cell_id"), "gene", F.lit(1.0).alias("x")).where("gene in ('g00000', 'g00007', 'g69999')")
    wide = x.unionByName(genes.select(F.lit("s").alias("sample_id"), F.lit("2").alias("cell_id"), "gene", F.lit(2.0).alias("x")))
    cells = spark.createDataFrame([("s", "1"), ("s", "3")], "sample_id string, cell_id string")
    rows = {r["cell_id"]: r["embedding"] for r in m.cell_representation(cells, wide, "X").collect()}
    assert len(rows["1"]) == 70_000 and [i for i, v in enumerate(rows["1"]) if v] == [0, 7, 69_999]
    assert rows["3"] == [0.0] * 70_000
    with pytest.raises(ValueError, match="at most"):
        m.pca_representation(wide, cells, 2)


def test_domain_stage_makes_the_representation_it_lacks(spark):
    rows = [(f"s{i % 2}", str(i), "ctrl" if i % 2 else "drug", "T", float(i % 8), float(i // 8)) for i in range(64)]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, condition string, cell_type string, x double, y double")
    entries = [(r[0], r[1], g, 4.0 + i % 3) for i, r in enumerate(rows) for g in (("G", "H") if i < 32 else ("I", "J"))]
    x = spark.createDataFrame(entries, "sample_id string, cell_id string, gene string, x double")
    with pytest.raises(KeyError):
        stages.run_domains(cells, "X_pca")
    for vec in ("X_pca", "X", None):
        done = stages.run_domains(cells, vec, "knn", 3, layers=1, expression=x, components=2, min_k=2, max_k=2, runs=2, seed=1, max_iter=20)
        found = {int(r["cell_id"]): r["compartment"] for r in done["cells"].collect()}
        assert len(found) == 64 and len({found[i] for i in range(24)}) == 1 and found[0] != found[63]


def test_ingest_with_types_components_manifest_and_fallback(spark, root, sheet, tmp_path):
    for sample, kinds in (("s a", ("Gene Expression", "Control")), ("s+b", ("Gene Expression", "Gene Expression"))):
        genes = {"s a": ["G1", "G2"], "s+b": ["G2", "G3"]}[sample]
        write(root / sample / "genes.tsv.gz", "".join(f"{g}\tid-{g}\t{k}\n" for g, k in zip(genes, kinds, strict=True)))
        write(root / sample / "pca.csv.gz", "cell_id,note,PC_1,PC_2\nc2,b,3.5,4\nc1,a,1,-2e1\nspare,z,0,0\n")
        write(root / sample / "short.csv.gz", "cell_id,x,y\nc1,1,2\n")
    given = files(root) | {"pca": f"{root}/*/pca.csv.gz", "spatial": [f"{root}/*/short.csv.gz", f"{root}/*/spatial.csv.gz"]}
    manifest = spark.createDataFrame([("s a", "ctrl", 2), ("s+b", "drug", 2)], "sample_id string, condition string, n_cells long")
    built = cohort.build_cohort(spark, given, sheet, None, target=None, join="outer", manifest=manifest, kind="Gene Expression")
    cells = {(r["sample_id"], r["cell_id"]): r for r in built["cells"].collect()}
    assert cells["s a", "c1"]["X_pca"] == [1.0, -20.0] and cells["s+b", "c2"]["X_pca"] == [3.5, 4.0]
    assert (cells["s a", "c2"]["x"], cells["s a", "c2"]["y"]) == (1.5, 10.0)
    found = {(r["sample_id"], r["cell_id"], r["gene"]): r["x"] for r in built["expression"].collect()}
    assert found == {("s a", "c1", "G1"): 1.0, ("s a", "c2", "G1"): 2.0, ("s+b", "c1", "G2"): 4.0, ("s+b", "c2", "G3"): 5.0}
    features = {r["gene"]: (r["feature_id"], r["feature_type"]) for r in built["features"].collect()}
    assert features == {g: (f"id-{g}", "Gene Expression") for g in ("G1", "G2", "G3")}
    out = scratch_path(spark, "cohort")
    cohort.write_cohort(built, out)
    facts = {(r["fact"], r["label"]): r["n"] for r in spark.read.json(f"{out}/manifest").collect()}
    assert facts["cells", ""] == 4 and facts["genes", ""] == 3 and facts["join", "outer"] == 2
    assert sorted(v for (fact, _), v in facts.items() if fact == "source") == [2, 2]
    for wrong in ([("s a", "ctrl", 3), ("s+b", "drug", 2)], [("s a", "ctrl", 2), ("s+b", "ctrl", 2)], [("s a", "ctrl", 2)]):
        with pytest.raises(q.CheckFailed, match="source_"):
            cohort.build_cohort(spark, given, sheet, manifest=spark.createDataFrame(wrong, manifest.schema))


def test_rows_are_dealt_to_files_by_their_identity(spark):
    rows = spark.range(3000).select(F.lit("s").alias("sample_id"), F.col("id").cast("string").alias("cell_id"), F.lit("g").alias("gene"))
    together = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(together)
    spark.conf.set(together, "false")
    try:
        at = [{r["cell_id"]: r["p"] for r in sinks._dealt(df, "sample_id", 300).withColumn("p", F.spark_partition_id()).collect()} for df in (rows, rows.repartition(7))]
    finally:
        spark.conf.set(together, before)
    assert at[0] == at[1] and len(set(at[0].values())) > 1


def test_entries_stay_in_parts_of_bounded_size(spark):
    """A grouping after the deal keeps the number of parts that the rows ask for; few rows are left alone."""
    from histomesh.lineage import spread

    rows = spark.range(1000).selectExpr("cast(id as string) AS cell_id", "id % 7 AS n")
    many = spread(rows, 1000, "cell_id", per_part=40).groupBy("cell_id").agg(F.sum("n").alias("n"))
    assert many.rdd.getNumPartitions() == 25 and many.count() == 1000
    assert spread(rows, 1000, "cell_id") is rows


def test_sparse_rows_are_grouped_in_parts_of_bounded_size(spark):
    """As many parts as the told number of entries asks for, and the same rows."""
    from histomesh.operators import gram

    entries = spark.range(600).selectExpr("cast(id div 300 AS string) AS sample_id", "cast(id div 3 AS string) AS cell_id", "cast(id % 3 AS int) AS ix", "1.0D AS x")
    keys = ["sample_id", "cell_id"]
    many = gram.sparse_rows(entries, keys, 5_000_000)
    assert many.rdd.getNumPartitions() == 20
    assert many.exceptAll(gram.sparse_rows(entries, keys)).isEmpty() and many.count() == 200


def test_few_scans_of_all_cells_are_left_after_the_sample(spark, monkeypatch):
    """Fits climb on the sample first: cells are scanned a few times, not once per step."""
    scans, climbed = [], d._climbed

    def counted(stack, state, scan, max_iter, tol):
        steps = []
        found = climbed(stack, state, lambda *a: steps.append(1) or scan(*a), max_iter, tol)
        scans.append(len(steps))
        return found

    monkeypatch.setattr(d, "_climbed", counted)
    _, _, vectors = blobs(spark)
    d.fit_many(vectors, [(4, 0), (4, 1), (2, 0)], seed=5)
    assert len(scans) == 2 and scans[0] > scans[1] and scans[1] <= 3


def test_entries_of_many_differing_cells_meet_in_parts_bounded_by_rows(spark, monkeypatch):
    import re
    from functools import partial

    from histomesh.lineage import spread

    monkeypatch.setattr(p, "spread", partial(spread, per_part=40))
    old = spark.range(1200).selectExpr("'s' AS sample_id", "CAST(id % 300 AS STRING) AS cell_id", "concat('g', id % 7) AS gene", "id % 5 AS n")
    new = old.withColumn("n", F.expr("n + CASE WHEN cell_id < '9' THEN 1 ELSE 0 END"))
    found = p.count_diff_by_digest(new, old, most=10)
    assert found.collect() == p.count_diff(new, old).collect() and found.first()["mismatched_rows"] > 200
    kept = int(old.groupBy("cell_id", "gene").agg(F.sum("n").alias("n")).where("n <> 0").count())
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\(sample_id#\d+, cell_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert parts and min(parts) >= kept / 40
    assert p.count_diff_by_digest(new, old).collect() == found.collect()
