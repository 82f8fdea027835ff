"""Tree tables to spectrum distances through the command line."""

import gzip
import threading

import pytest

from pyspark.sql import functions as F

from coeval import cli
from coeval import schema as layout
from coeval.cli import main
from coeval.sources import bundles

SITES = 60
DRAWS = 2


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    """Two draws of sixty sites; each site mutates its own node under its own parent."""
    root = tmp_path_factory.mktemp("flow")
    for draw in range(DRAWS):
        folder = root / f"draw{draw}"
        nodes, edges, sites, mutations = [], [], [], []
        for i in range(SITES):
            young, old = 2 * i, 2 * i + 1
            below = (i % 20) * 400.0 + draw * 50
            nodes += [(young, below), (old, below + 1500.0 + 10 * (i % 7))]
            edges.append((0.0, 1000.0, old, young))
            sites.append((i, float(10 + i if i < 31 else 11 + i)))
            mutations.append((i, i, young))
        tables = {
            "nodes": (nodes, "node_id BIGINT, time DOUBLE"),
            "edges": (edges, "`left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT"),
            "sites": (sites, "site_id BIGINT, position DOUBLE"),
            "mutations": (mutations, "mutation_id BIGINT, site_id BIGINT, node_id BIGINT"),
        }
        for name, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(folder / name))
    (root / "offsets.txt").write_text("# two chromosomes\nchr1 0 40\nchr2 41 900\n")
    # positions 10..40 lie on chr1, 42..70 on chr2; 41 is a gap base
    targets = [("chr1", p) for p in range(10, 40, 4)]
    (root / "te.txt").write_text("".join(f"{c}\t{p}  # te\n" for c, p in targets))
    native = lambda p: ("chr1", p) if p <= 40 else ("chr2", p - 41)
    pool = [native(p) for p in range(10, 71) if p != 41]
    (root / "pool.txt").write_text("".join(f"{c} {p}\n" for c, p in pool))
    header = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    header += "\t".join(f"s{i}" for i in range(20)) + "\n"
    records = []
    for index, (chrom, pos) in enumerate(pool):
        k = 1 + index % 19
        calls = "\t".join("1" if i < k else "0" for i in range(20))
        records.append(f"{chrom}\t{pos}\t.\tA\tG\t.\t.\t.\tGT\t{calls}\n")
    with gzip.open(root / "calls.vcf.gz", "wt") as handle:
        handle.write(header + "".join(records))
    return root


def test_workflow(spark, workspace):
    at = lambda name: str(workspace / name)
    run = lambda *args: main(list(args), spark)
    run("build-store", "--trees", at("draw*"), "--chromosomes", at("offsets.txt"), "--output", at("store"))
    store = bundles.open_bundle(spark, at("store"), bundles.INTERVAL_STORE, deep=True)
    assert store.metadata["draws"] == DRAWS
    assert store.table("sites").count() == SITES
    assert store.table("intervals").count() == SITES * DRAWS
    assert set(store.table("intervals").columns) == {
        c.split()[0] for c in layout.INTERVALS.split(", ")
    }
    run("validate", "--store", at("store"), "--deep")
    with pytest.raises(FileExistsError):
        run("build-store", "--trees", at("draw*"), "--chromosomes", at("offsets.txt"), "--output", at("store"))

    run("build-dense-store", "--store", at("store"), "--output", at("dense"), "--bin-width", "500")
    dense = bundles.open_bundle(spark, at("dense"), bundles.DENSE_STORE)
    assert dense.table("codes").count() == SITES * dense.metadata["bins"]
    assert dense.digest("codes") == dense.digest("codes_by_bin")

    common = ("--replicates", "50", "--quantile", "0.9", "--bin-width", "500", "--seed", "3")
    run("target", "--store", at("store"), "--positions", at("te.txt"), "--output", at("target"), *common)
    target = bundles.open_bundle(spark, at("target"), bundles.TARGET)
    assert target.metadata["size"] == 8

    run(
        "sample", "--store", at("store"), "--target", at("target"), "--output", at("controls"),
        "--candidates", at("pool.txt"), "--chains", "2", "--sets", "2", "--search-bin-width", "1000",
        "--work", at("work"), "--seed", "5",
    )
    controls = bundles.open_bundle(spark, at("controls"), bundles.CONTROLS)
    assert controls.table("members").count() == 2 * 2 * 8
    assert controls.table("sets").where(f"wasserstein > {target.metadata['threshold']}").count() == 0

    # a resumed run finds every step written and reaches the same members
    run(
        "sample", "--store", at("store"), "--target", at("target"), "--output", at("controls-again"),
        "--candidates", at("pool.txt"), "--chains", "2", "--sets", "2", "--search-bin-width", "1000",
        "--work", at("work"), "--seed", "5", "--resume",
    )
    with pytest.raises(ValueError, match="different run"):
        run(
            "sample", "--store", at("store"), "--target", at("target"), "--output", at("controls-other"),
            "--candidates", at("pool.txt"), "--chains", "2", "--sets", "2", "--search-bin-width", "1000",
            "--work", at("work"), "--seed", "6", "--resume",
        )
    again = bundles.open_bundle(spark, at("controls-again"), bundles.CONTROLS)
    assert again.digest("members") == controls.digest("members")

    run(
        "reject", "--store", at("store"), "--target", at("target"), "--output", at("rejected"),
        "--candidates", at("pool.txt"), "--sets", "1", "--max-proposals", "64", "--seed", "2",
    )
    assert bundles.open_bundle(spark, at("rejected")).table("members").count() == 8

    run("target", "--store", at("dense"), "--positions", at("te.txt"), "--output", at("dense-target"), *common[:4])
    run(
        "reject", "--store", at("dense"), "--target", at("dense-target"), "--output", at("dense-rejected"),
        "--candidates", at("pool.txt"), "--sets", "1", "--max-proposals", "64", "--seed", "2",
    )
    run("export", "--bundle", at("dense-rejected"), "--table", "members", "--output", at("csv"))
    assert spark.read.option("header", True).csv(at("csv")).count() == 8
    with pytest.raises(ValueError, match="different store"):
        run("reject", "--store", at("store"), "--target", at("dense-target"), "--output", at("never"), "--sets", "1")

    run(
        "match", "--store", at("store"), "--target", at("target"), "--seed-sets", at("controls"),
        "--candidates", at("pool.txt"), "--output", at("matched"), "--replicates", "2",
        "--search-bin-width", "1000", "--min-epochs", "1", "--max-epochs", "3", "--patience", "1",
    )
    matched = bundles.open_bundle(spark, at("matched"), bundles.REPLICATES)
    assert matched.table("members").count() == 2 * 8
    assert matched.table("restarts").count() == 2 * 3

    for name in ("controls", "matched"):
        run(
            "phi", "--target", at("target"), "--matches", at(name), "--vcf", at("calls.vcf.gz"),
            "--output", at(f"phi-{name}"),
        )
        scores = bundles.open_bundle(spark, at(f"phi-{name}"), bundles.SPECTRA).table("replicates")
        assert scores.where("phi_sfs < 0 OR phi_sfs > 1").count() == 0
        assert scores.where("input_sites <> 8").count() == 0

    # candidates by row number and by mask, one source at a time
    sites = store.table("sites")
    allowed = sites.where("eligible").select("row_id")
    allowed.write.parquet(at("rows.parquet"))
    sites.select("row_id", F.col("eligible").alias("selected")).write.parquet(at("mask.parquet"))
    few = ("--sets", "1", "--max-proposals", "64", "--seed", "2")
    for kind, name in (("rows", "by-rows"), ("mask", "by-mask")):
        run("reject", "--store", at("store"), "--target", at("target"), "--output", at(name), f"--candidate-{kind}", at(f"{kind}.parquet"), *few)
    rows, mask = (bundles.open_bundle(spark, at(name), bundles.CONTROLS) for name in ("by-rows", "by-mask"))
    assert rows.digest("members") == mask.digest("members") and rows.table("excluded_candidates").count() == 0
    allowed.unionAll(allowed.limit(1)).write.parquet(at("twice.parquet"))
    for bad, said in ((("--candidate-rows", at("twice.parquet")), "candidates"), (("--candidate-rows", at("rows.parquet"), "--candidates", at("pool.txt")), "one source")):
        with pytest.raises(ValueError, match=said):
            run("reject", "--store", at("store"), "--target", at("target"), "--output", at("never"), *bad, *few)

    # positions that the store lacks are listed in what is published
    (workspace / "more.txt").write_text((workspace / "te.txt").read_text() + "chr2 899\n")
    run("target", "--store", at("store"), "--positions", at("more.txt"), "--output", at("audited"), "--policy", "drop", *common)
    audited = bundles.open_bundle(spark, at("audited"), bundles.TARGET)
    assert [tuple(r) for r in audited.table("excluded").select("chrom", "native", "reason").collect()] == [("chr2", 899, "unresolved")]
    assert target.table("excluded").count() == 0

    # runs side by side: one finds its target made, one is broken, one is new
    (workspace / "runs.tsv").write_text(
        "label\tpositions\ttarget\toutput\tseed\n"
        f"one\t{at('te.txt')}\t{at('target')}\t{at('from-manifest')}\t3\n"
        f"broken\t{at('nowhere.txt')}\t{at('broken-target')}\t{at('broken-out')}\t4\n"
        f"two\t{at('te.txt')}\t{at('second-target')}\t{at('second-out')}\t8\n"
    )
    manifest = (
        "run-manifest", "--manifest", at("runs.tsv"), "--store", at("store"), "--chains", "1",
        "--sets", "1", "--search-bin-width", "1000", "--policy", "error", "--parallel", "3", *common[:-2],
    )
    with pytest.raises(RuntimeError, match="1 of 3 runs failed.*broken"):
        run(*manifest)
    first = {name: bundles.open_bundle(spark, at(name)) for name in ("target", "from-manifest", "second-target", "second-out")}
    assert not (workspace / "broken-out").exists()
    (workspace / "nowhere.txt").write_text((workspace / "te.txt").read_text())
    run(*manifest)
    again = {name: bundles.open_bundle(spark, at(name)) for name in first}
    assert all(again[n].metadata == first[n].metadata for n in first)

    # an output that was made from other inputs or settings is refused, not taken for this run's
    for changed in (("--quantile", "0.8"), ("--chains", "2")):
        with pytest.raises(RuntimeError, match="other inputs, settings or software"):
            run(*manifest, *changed)
    (workspace / "te.txt").write_text("".join((workspace / "te.txt").read_text().splitlines(True)[1:]))
    with pytest.raises(RuntimeError, match="other inputs, settings or software"):
        run(*manifest)


def test_runs_of_a_manifest_overlap(spark, tmp_path, monkeypatch):
    """Two runs that each wait for the other to have begun."""
    (tmp_path / "m.tsv").write_text("label\tpositions\ttarget\toutput\tseed\na\tp\tt1\to1\t1\nb\tp\tt2\to2\t2\n")
    together, pools = threading.Barrier(2, timeout=60), {}

    def one(session, args, row):
        together.wait()
        pools[row["label"]] = session.sparkContext.getLocalProperty("spark.scheduler.pool")
        session.range(10).count()
        together.wait()
        return "complete"

    monkeypatch.setattr(cli, "_manifest_run", one)
    assert main(["run-manifest", "--manifest", str(tmp_path / "m.tsv"), "--store", "s", "--parallel", "2"], spark) is None
    assert set(pools) == {"a", "b"}


def test_steps_are_known_by_content(spark, workspace):
    args = cli.parser().parse_args(["build-store", "--trees", str(workspace / "draw*"), "--chromosomes", str(workspace / "offsets.txt"), "--output", "x"])
    key = cli.step_key(spark, args)
    args.output, args.work = "y", "z"
    assert cli.step_key(spark, args) == key
    args.min_usable_fraction = 0.2
    assert cli.step_key(spark, args) != key
    args.min_usable_fraction = 0.1
    (workspace / "offsets.txt").write_text("# the same chromosomes\nchr1 0 40\nchr2 41 901\n")
    assert cli.step_key(spark, args) != key


def test_distribution(spark, workspace):
    (workspace / "where.txt").write_text("10\n12 # twelve\n")
    main(
        [
            "distribution", "--trees", str(workspace / "draw*"), "--positions", str(workspace / "where.txt"),
            "--output", str(workspace / "dist"), "--bin-width", "500",
        ],
        spark,
    )
    rows = bundles.open_bundle(spark, str(workspace / "dist")).table("distribution")
    sums = {r["position"]: r["s"] for r in rows.groupBy("position").agg({"probability": "sum"}).withColumnRenamed("sum(probability)", "s").collect()}
    assert sums == pytest.approx({10.0: 1.0, 12.0: 1.0})
    made = bundles.open_bundle(spark, str(workspace / "dist"))
    assert made.table("intervals").groupBy("position").count().where(f"count = {DRAWS}").count() == 2
    both = ["distribution", "--trees", str(workspace / "draw*"), "--at", "10", "12", "--output", str(workspace / "dist-at"), "--bin-width", "500"]
    main(both, spark)
    assert bundles.open_bundle(spark, str(workspace / "dist-at")).digest("distribution") == made.digest("distribution")
    (workspace / "where.txt").write_text("10\nnan\nx\n")
    with pytest.raises(ValueError, match="2 values are not finite"):
        main(["distribution", "--trees", str(workspace / "draw*"), "--positions", str(workspace / "where.txt"), "--output", str(workspace / "never"), "--bin-width", "500"], spark)


def test_replicate_bundles_are_checked_on_load(spark):
    from dataclasses import dataclass

    from coeval.plans.controls import check_replicates

    tables = {
        "counts": spark.createDataFrame([(0, 0, 2), (1, 0, 1), (1, 1, 1)], "replicate INT, target_idx BIGINT, times BIGINT"),
        "members": spark.createDataFrame([(0, 5), (0, 6), (1, 5), (1, 7)], "replicate INT, row_id BIGINT"),
        "restarts": spark.createDataFrame([(0, 0, 3.0), (0, 1, 2.0), (1, 0, 1.0)], "replicate INT, restart INT, match_bootstrap DOUBLE"),
    }
    tables["replicates"] = tables["restarts"].where("replicate = 1 OR restart = 1")

    @dataclass
    class Made:
        tables: dict

        def table(self, name):
            return self.tables[name]

    check_replicates(Made(tables), 2)
    broken = {
        "counts": tables["counts"].where("target_idx = 0"), "members": tables["members"].where("row_id < 7"),
        "replicates": tables["restarts"].where("restart = 0"),
    }
    for name, table in broken.items():
        with pytest.raises(ValueError, match="of replicates"):
            check_replicates(Made({**tables, name: table}), 2)
