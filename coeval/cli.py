"""Command line: one subcommand per job.

    python -m coeval build-store --trees 'draws/*' --chromosomes offsets.txt --output store
    python -m coeval target --store store --positions te.txt --output target
    python -m coeval sample --store store --target target --output controls --seed 1
    python -m coeval phi --target target --matches controls --vcf calls.vcf.gz --output phi
"""

from __future__ import annotations

import argparse
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators import cdf, coordinates, density, parents, resolution
from coeval.plans import controls, matcher, phi, rejection, stores, swap
from coeval.plans.blocks import BlockConfig
from coeval.plans.distribution import estimate_distributions
from coeval.plans.target import TargetConfig, build_target, target_from_changes
from coeval.plans.validation import bad_distances, bad_members, require_none
from coeval.session import RunFolder, build_session
from coeval.sinks.publish import publish, software, table_digest
from coeval.sources import bundles, text_inputs, vcf
from coeval.sources.tree_tables import load_draws


def resolve_native(spark: SparkSession, store: bundles.Bundle, path: str, policy: str) -> tuple[DataFrame, DataFrame]:
    """Of a native position list, the included (row_id, chrom, native) and the excluded (chrom, native, position, reason)."""
    listed = text_inputs.load_native_positions(spark, path)
    placed = coordinates.native_to_global(listed, store.table("chromosomes"))
    require_none(placed.where("problem IS NOT NULL").select("chrom", "native", "problem"), path)
    resolved = resolution.resolve(placed.drop("problem"), store.table("sites"))
    included = resolution.enforce_policy(resolved, policy).select("row_id", "chrom", "native")
    return included, resolution.view(resolved, "excluded").select("chrom", "native", "position", "reason")


def _candidates(spark, store, args, targets: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Candidate rows from one source at most, and the audit of positions it excluded, if it has any.

    Rows by number and masks are Parquet tables: (row_id), each row once and
    eligible, and (row_id, selected), every row of the store once.
    """
    sites = store.table("sites")
    given = [k for k in ("candidates", "candidate_rows", "candidate_mask") if getattr(args, k, None)]
    if len(given) > 1:
        raise ValueError(f"candidates come from one source, not from {given}")
    declared, audit = None, {}
    if given == ["candidates"]:
        included, excluded = resolve_native(spark, store, args.candidates, args.policy)
        declared, audit = included.select("row_id"), {"excluded_candidates": excluded}
    elif given:
        listed = spark.read.parquet(getattr(args, given[0]))
        kinds = dict(listed.dtypes)
        if kinds.get("row_id") not in ("bigint", "int", "smallint", "tinyint") or (given == ["candidate_mask"] and kinds.get("selected") != "boolean"):
            raise ValueError(f"{getattr(args, given[0])}: needs a column row_id of whole numbers, and a mask one selected of booleans")
        declared = listed.select(F.col("row_id").cast("bigint")) if given == ["candidate_rows"] else resolution.candidates_marked(sites, listed.select(F.col("row_id").cast("bigint"), "selected"))
        problems = resolution.candidate_problems(sites, declared)
        if args.policy == "error" or given == ["candidate_rows"]:
            # Only ineligible rows may be dropped; repeats and rows out of range are errors either way.
            require_none(problems if args.policy == "error" else problems.where("problem <> 'ineligible'"), "candidates")
        audit = {"excluded_candidates": problems}
    return resolution.candidate_universe(sites, targets, declared), audit


#: Settings that say where and how a step runs, not what it makes.
PLACES = ("resume", "work", "run", "output", "command", "step", "manifest", "parallel")
BUNDLES, FILES, TABLES = ("store", "target", "seed_sets", "matches"), ("positions", "candidates", "chromosomes"), ("candidate_rows", "candidate_mask")


def step_identity(spark, args) -> dict:
    """What decides a step's result: its settings, the contents of its inputs, the software.

    Bundles count by their tables' digests, text files by their lines, tree
    tables by their files' names, lengths and times.
    """
    identity: dict = {"software": software()}
    for name, value in sorted(vars(args).items()):
        if name in PLACES or callable(value):
            continue
        if value and name in BUNDLES:
            value = bundles.content_identity(bundles.open_bundle(spark, value))
        elif value and name in FILES:
            value = table_digest(spark.read.text(value))
        elif value and name in TABLES:
            value = table_digest(spark.read.parquet(value))
        elif value and name == "trees":
            value = text_inputs.listing_digest(spark, text_inputs.expand(spark, value))
        elif value and name == "vcf":
            value = vcf.file_digest(spark, value)
        identity[name] = value
    return identity


def step_key(spark, args) -> str:
    """Hash of a step's identity; published with its output."""
    return hashlib.sha256(json.dumps(step_identity(spark, args), sort_keys=True, default=str).encode("utf-8")).hexdigest()


def _run(spark, args, name: str) -> RunFolder:
    if not args.work:
        return RunFolder(spark)
    return RunFolder(spark, f"{args.work}/{name}", {"step": step_key(spark, args)}, args.resume)


def build_store(spark, args) -> None:
    trees = load_draws(spark, args.trees)
    table = text_inputs.load_offsets(spark, args.chromosomes)
    stores.build_interval_store(
        spark, trees, table, args.output, args.min_usable_fraction, args.missing, args.root,
        args.single_precision, _run(spark, args, "store"),
    )


def build_dense(spark, args) -> None:
    store = bundles.open_bundle(spark, args.store, bundles.INTERVAL_STORE)
    stores.build_dense_store(spark, store, args.bin_width, args.output, not args.omit_transpose)


def validate(spark, args) -> None:
    bundle = bundles.open_bundle(spark, args.store, deep=args.deep)
    if bundle.version == bundles.INTERVAL_STORE:
        stores.validate_interval_store(bundle, args.deep)
    elif bundle.version == bundles.DENSE_STORE:
        stores.validate_dense_store(bundle, args.deep)


def export(spark, args) -> None:
    """One bundle table as CSV with a header."""
    table = bundles.open_bundle(spark, args.bundle).table(args.table)
    table.write.mode("errorifexists").option("header", True).csv(args.output)


def distribution(spark, args) -> None:
    trees = load_draws(spark, args.trees)
    wanted = text_inputs.load_numeric_positions(spark, args.positions, args.at)
    placed = trees.mutations.join(trees.sites, ["draw_id", "site_id"]).join(wanted, "position", "left_semi")
    aged = parents.with_ages(parents.mutation_parents(placed, trees.edges), trees.nodes)
    run = RunFolder(spark)
    aged = run.table("aged", aged.select("position", "draw_id", "below", "above"))
    if args.root == "error":
        require_none(aged.where("above IS NULL").select("position", "draw_id"), "root mutations")
    oldest = aged.agg(F.max("above")).first()[0]
    result = estimate_distributions(aged, Grid.spanning(oldest, args.bin_width), trees.draws)
    if args.missing == "error":
        require_none(result.where("missing_draws > 0").select("position"), "positions absent from some draw")
    publish(
        spark, args.output, bundles.DISTRIBUTION,
        {"distribution": result, "intervals": aged.where("above IS NOT NULL").orderBy("position", "draw_id", "below")},
        {"bin_width": args.bin_width, "draws": trees.draws},
    )


def target(spark, args) -> None:
    store = bundles.open_bundle(spark, args.store, bundles.INTERVAL_STORE, bundles.DENSE_STORE)
    run = _run(spark, args, "target")
    included, excluded = resolve_native(spark, store, args.positions, args.policy)
    rows = run.table("resolved", included)
    if store.version == bundles.DENSE_STORE:
        grid = Grid(store.metadata["bin_width"], store.metadata["bins"])
        config = TargetConfig(grid.width, args.replicates, args.quantile, args.seed, args.distance)
        own = store.table("codes").join(rows.select("row_id"), "row_id", "left_semi")
        made = target_from_changes(density.code_changes(own), rows, grid, config, run)
    else:
        config = TargetConfig(args.bin_width, args.replicates, args.quantile, args.seed, args.distance)
        made = build_target(store.table("intervals"), rows, store.metadata["maximum_above"], config, run)
    publish(
        spark, args.output, bundles.TARGET,
        {
            "rows": made.rows.join(rows, "row_id"), "changes": made.changes, "cdf": made.cdf,
            "distances": made.distances, "strata": made.strata, "excluded": excluded,
        },
        {
            **asdict(config), "step": step_key(spark, args), "bins": made.grid.bins, "size": made.size, "threshold": made.threshold,
            "source": bundles.source_identity(store),
        },
    )


def _matching_inputs(spark, args, *versions):
    store = bundles.open_bundle(spark, args.store, *(versions or (bundles.INTERVAL_STORE,)))
    bundle = bundles.open_bundle(spark, args.target, bundles.TARGET)
    bundles.require_same_source(store, bundle)
    made = controls.load_target(bundle)
    identity = {"rows": bundle.digest("rows"), "cdf": bundle.digest("cdf"), "threshold": made.threshold}
    return store, made, identity


def sample(spark, args) -> None:
    store, made, identity = _matching_inputs(spark, args)
    run = _run(spark, args, "chains")
    pool, audit = _candidates(spark, store, args, made.rows)
    config = swap.SwapConfig(
        args.chains, args.sets, swap.Construction(args.search_bin_width, args.construction_epochs, args.plateau_epochs),
        swap.Walk(args.burnin_sweeps, args.sample_sweeps, args.max_proposals), BlockConfig(args.block_slots),
    )
    made_chains = swap.run_chains(
        store.table("intervals"), pool, made, store.metadata["maximum_above"], args.seed, config, run
    )
    controls.certify(made_chains, store.table("sites"), store.table("intervals"), made, pool)
    controls.publish_controls(
        spark, args.output, made_chains, store, made, identity, args.seed, asdict(config), step_key(spark, args), audit
    )


def reject(spark, args) -> None:
    store, made, identity = _matching_inputs(spark, args, bundles.INTERVAL_STORE, bundles.DENSE_STORE)
    run = _run(spark, args, "rejection")
    pool, audit = _candidates(spark, store, args, made.rows)
    pool = run.table("pool", pool)
    if store.version == bundles.DENSE_STORE:
        facts = store.table("codes").join(pool, "row_id", "left_semi")
        weights = rejection.dense_weights(facts, pool, made.strata)
        changes = run.table("changes", density.code_changes(facts))
    else:
        facts = store.table("intervals").join(pool, "row_id", "left_semi")
        weights = rejection.candidate_weights(facts, pool, made.strata)
        changes = run.table("changes", cdf.row_changes(facts, made.grid))
    result = rejection.generate_matches(
        weights, made.strata, changes, made.cdf, made.grid, made.threshold,
        args.sets, args.max_proposals, args.seed, run,
    )
    drawn = run.table("accepted", result.members)
    require_none(bad_members(drawn, store.table("sites"), made.rows, ["proposal_id"], made.size, pool), "drawn sets")
    scores = cdf.wasserstein(cdf.set_cdf(drawn, changes, made.grid, ["proposal_id"]), made.cdf, made.grid, ["proposal_id"])
    require_none(bad_distances(result.proposals.where("accepted").select("proposal_id", "wasserstein"), scores, ["proposal_id"], made.threshold), "accepted distances")
    members = controls.native_members(
        drawn.withColumn("set_id", F.col("proposal_id")).drop("proposal_id"), store
    )
    publish(
        spark, args.output, bundles.CONTROLS,
        {"members": members, "proposals": result.proposals, **audit},
        {
            "step": step_key(spark, args), "attempts": result.attempts, "rejected": result.rejected, "threshold": made.threshold,
            "seed": args.seed, "set_size": made.size, "target": identity,
            "source": bundles.source_identity(store),
        },
    )


def _sets_of(bundle: bundles.Bundle) -> DataFrame:
    """Members of a control bundle under one ``set_id``."""
    members = bundle.table("members")
    if "set_id" in members.columns:
        return members
    if "replicate" in members.columns:
        return members.withColumnRenamed("replicate", "set_id")
    per_chain = bundle.metadata["config"]["sets_per_chain"]
    return members.withColumn("set_id", F.col("chain_index") * per_chain + F.col("sample_index"))


def match(spark, args) -> None:
    store, made, identity = _matching_inputs(spark, args)
    seeds = bundles.open_bundle(spark, args.seed_sets, bundles.CONTROLS)
    bundles.require_same_source(store, seeds)
    if seeds.metadata["set_size"] != made.size:
        raise ValueError(f"{args.seed_sets}: sets of {seeds.metadata['set_size']} rows cannot seed matches of {made.size}")
    run = _run(spark, args, "matcher")
    config = matcher.OptimizerConfig(
        args.replicates, args.search_bin_width, matcher.Seeds(args.closest, args.diverse),
        matcher.Stopping(args.min_epochs, args.max_epochs, args.patience, args.material_ratio),
        matcher.Tolerance(args.absolute_tolerance, args.relative_tolerance), matcher.Quality(args.max_ratio, args.max_distance),
    )
    pool, audit = _candidates(spark, store, args, made.rows)
    found = matcher.match_replicates(
        store.table("intervals"), pool, made,
        _sets_of(seeds).select("set_id", "row_id"), store.metadata["maximum_above"], args.seed, config, run,
    )
    require_none(
        bad_members(found.members, store.table("sites"), made.rows, ["replicate"], made.size, pool),
        "matched members",
    )
    publish(
        spark, args.output, bundles.REPLICATES,
        {
            "replicates": found.replicates, "restarts": found.restarts, "traces": found.traces,
            "counts": found.counts, "members": controls.native_members(found.members, store), **audit,
        },
        {
            "step": step_key(spark, args), "config": asdict(config), "seed": args.seed, "threshold": made.threshold, "target": identity,
            "source": bundles.source_identity(store),
        },
    )


def phi_sfs(spark, args) -> None:
    goal = bundles.open_bundle(spark, args.target, bundles.TARGET)
    matches = bundles.open_bundle(spark, args.matches, bundles.CONTROLS, bundles.REPLICATES)
    if matches.metadata["target"]["rows"] != goal.digest("rows") or (
        matches.metadata["source"] != goal.metadata["source"]
    ):
        raise ValueError("the matches were made for a different target or store")
    if matches.version == bundles.REPLICATES:
        controls.check_replicates(matches, goal.metadata["size"])
    coordinate = [F.col("chrom"), F.col("native").alias("pos")]
    result = phi.calculate(
        vcf.read_lines(spark, args.vcf),
        goal.table("rows").select(*coordinate),
        _sets_of(matches).select("set_id", *coordinate),
        _run(spark, args, "phi"), args.ancestral, args.ancestral_key, args.heterozygous,
    )
    publish(
        spark, args.output, bundles.SPECTRA,
        {"replicates": result.replicates, "bins": result.bins, "site_counts": result.counts},
        {
            "vcf_digest": vcf.file_digest(spark, args.vcf),
            "target": matches.metadata["target"], "source": matches.metadata["source"],
        },
    )


def _manifest_run(spark, args, row: dict[str, str]) -> str:
    """Target, then chains, of one run of a manifest; finished outputs made by the same steps are left alone."""
    context = spark.sparkContext
    context.setLocalProperty("spark.scheduler.pool", row["label"])
    context.setJobDescription(f"run {row['label']}")
    shared = {**vars(args), "seed": int(row["seed"]), "candidates": None, "candidate_rows": None, "candidate_mask": None, "work": args.work and f"{args.work}/{row['label']}"}
    first = argparse.Namespace(**{k: v for k, v in shared.items() if k in TARGET_SETTINGS}, positions=row["positions"], output=row["target"])
    made = 0
    if not bundles.is_complete(spark, row["target"], bundles.TARGET, step_key(spark, first)):
        target(spark, first)
        made += 1
    second = argparse.Namespace(**{k: v for k, v in shared.items() if k in CHAIN_SETTINGS}, target=row["target"], output=row["output"])
    if not bundles.is_complete(spark, row["output"], bundles.CONTROLS, step_key(spark, second)):
        sample(spark, second)
        made += 1
    return "complete" if made else "complete before"


#: What the two steps of a run take from the command line.
TARGET_SETTINGS = ("store", "policy", "seed", "work", "resume", "bin_width", "replicates", "quantile", "distance")
CHAIN_SETTINGS = ("store", "policy", "seed", "work", "resume", "candidates", "candidate_rows", "candidate_mask", "chains", "sets", "search_bin_width", "construction_epochs", "plateau_epochs", "burnin_sweeps", "sample_sweeps", "max_proposals", "block_slots")


def run_manifest(spark, args) -> dict[str, str]:
    """Several runs at a time, each in a scheduler pool of its own; one that fails leaves the others alone.

    Prints what became of every run, and fails at the end if one did.
    """
    rows = text_inputs.load_manifest(spark, args.manifest)

    def attempt(row: dict[str, str]) -> str:
        try:
            return _manifest_run(spark, args, row)
        except Exception as error:  # noqa: BLE001
            return f"failed: {type(error).__name__}: {error}"

    with ThreadPoolExecutor(max(1, args.parallel)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(attempt), row) for row in rows]
        report = {row["label"]: job.result() for row, job in zip(rows, started)}
    for label, state in report.items():
        print(f"{label}\t{state}")
    failed = {label: state for label, state in report.items() if state.startswith("failed")}
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(report)} runs failed: {failed}")
    return report


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="coeval")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *inputs):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for option in inputs:
            command.add_argument(f"--{option}", required=True)
        command.add_argument("--work", help="folder for resumable steps")
        command.add_argument("--resume", action="store_true")
        return command

    def policies(command):
        command.add_argument("--missing", choices=("skip", "error"), default="skip")
        command.add_argument("--root", choices=("skip", "error"), default="skip")

    def pool(command):
        command.add_argument("--candidates", help="native position list of allowed controls")
        command.add_argument("--candidate-rows", help="Parquet table of allowed row_id")
        command.add_argument("--candidate-mask", help="Parquet table of every row_id and whether it is selected")
        command.add_argument("--policy", choices=("error", "drop"), default="error")

    def target_options(command):
        command.add_argument("--bin-width", type=float, default=1000.0)
        command.add_argument("--replicates", type=int, default=10_000)
        command.add_argument("--quantile", type=float, default=0.5)
        command.add_argument("--distance", type=float)

    def chain_options(command):
        command.add_argument("--chains", type=int, default=10)
        command.add_argument("--sets", type=int, default=10)
        build, walk = swap.Construction(), swap.Walk()
        command.add_argument("--search-bin-width", type=int, default=build.bin_width)
        command.add_argument("--construction-epochs", type=int, default=build.epochs)
        command.add_argument("--plateau-epochs", type=int, default=build.plateau)
        command.add_argument("--burnin-sweeps", type=float, default=walk.burnin)
        command.add_argument("--sample-sweeps", type=float, default=walk.between)
        command.add_argument("--max-proposals", type=int, default=walk.proposals, help="of a chain's walk")
        command.add_argument("--block-slots", type=int, default=1024)

    c = add("build-store", build_store, "chromosomes", "output")
    c.add_argument("--trees", nargs="+", required=True)
    c.add_argument("--min-usable-fraction", type=float, default=0.1)
    c.add_argument("--single-precision", action="store_true")
    policies(c)
    c = add("build-dense-store", build_dense, "store", "output")
    c.add_argument("--bin-width", type=float, default=1000.0)
    c.add_argument("--omit-transpose", action="store_true")
    c = add("validate", validate, "store")
    c.add_argument("--deep", action="store_true")
    add("export", export, "bundle", "table", "output")
    c = add("distribution", distribution, "output")
    c.add_argument("--positions", help="list of positions")
    c.add_argument("--at", type=float, nargs="+", help="positions")
    c.add_argument("--trees", nargs="+", required=True)
    c.add_argument("--bin-width", type=float, default=1000.0)
    policies(c)
    c = add("target", target, "store", "positions", "output")
    c.add_argument("--policy", choices=("error", "drop"), default="error")
    c.add_argument("--seed", type=int, default=0)
    target_options(c)
    c = add("sample", sample, "store", "target", "output")
    c.add_argument("--seed", type=int, default=0)
    pool(c)
    chain_options(c)
    c = add("reject", reject, "store", "target", "output")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--sets", type=int, default=100)
    c.add_argument("--max-proposals", type=int, default=100_000)
    pool(c)
    c = add("match", match, "store", "target", "seed-sets", "output")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--replicates", type=int, default=100)
    base = matcher.OptimizerConfig()
    for option, default in (
        ("search-bin-width", base.bin_width), ("closest", base.seeds.closest), ("diverse", base.seeds.diverse),
        ("min-epochs", base.stopping.least), ("max-epochs", base.stopping.most), ("patience", base.stopping.patience),
        ("material-ratio", base.stopping.material), ("absolute-tolerance", base.tolerance.absolute),
        ("relative-tolerance", base.tolerance.relative), ("max-ratio", base.quality.ratio), ("max-distance", base.quality.distance),
    ):
        c.add_argument(f"--{option}", type=type(default), default=default)
    pool(c)
    c = add("phi", phi_sfs, "target", "matches", "vcf", "output")
    c.add_argument("--ancestral", choices=("ref", "info"), default="ref")
    c.add_argument("--ancestral-key", default="AA")
    c.add_argument("--heterozygous", choices=("error", "missing"), default="error")
    c = add("run-manifest", run_manifest, "manifest", "store")
    c.add_argument("--parallel", type=int, default=4, help="runs at a time")
    c.add_argument("--policy", choices=("error", "drop"), default="error")
    target_options(c)
    chain_options(c)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or build_session(extra={"spark.scheduler.mode": "FAIR"}), args)
