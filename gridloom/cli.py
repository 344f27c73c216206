"""Command lines for the whole flows: ``python -m gridloom COMMAND ...``.

align: move a cohort to a template by its headers. register: warp sources to
targets by external programs. segment: fuse warped
sources. evaluate: overlap with the truth. clean: replace labels by their
neighbours'. labels: the structure and tissue tables of a cohort. Folders hold
a folder for each subject; subjects come in natural order.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cohort, evaluation, labels
from gridloom.plans import register as registration
from gridloom.plans import segment as flow
from gridloom.session import drop_written, local_session, tables_written
from gridloom.sources import files, volumes
from gridloom.sources.adapters import Programs


def _paths(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _print(df: DataFrame, *order: str) -> None:
    """All rows, in order, a few at a time."""
    print("\t".join(df.columns))
    for row in df.orderBy(*order).toLocalIterator() if order else df.toLocalIterator():
        print("\t".join(str(x) for x in row))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Dice of each subject and label; writes score.csv into out and prints what has no truth, means and the summary."""
    subjects = files.local_dirs(args.pred_dir)
    rows = [(s, os.path.join(args.pred_dir, s, args.prediction_name), os.path.join(args.gt_dir, s, args.gt_name)) for s in subjects]
    rows = [r for r in rows if os.path.isfile(r[1])]
    if not rows:
        raise SystemExit(f"no {args.prediction_name} below {args.pred_dir}")
    for s, _, t in rows:
        if not os.path.isfile(t):
            print(f"{s}: no ground truth, skipped")
    pairs = _paths(spark, [r for r in rows if os.path.isfile(r[2])], "subject string, pred string, truth string")
    bad = [r["subject"] for r in volumes.incompatible(pairs, "pred", "truth").collect()]
    if bad:
        raise SystemExit("prediction and truth differ in shape or affine: " + ", ".join(sorted(bad)))
    read = lambda c: volumes.voxels(pairs.select("subject", F.col(c).alias("path")), "label", labels=True)
    scores, means, total = flow.evaluate(read("pred"), read("truth"), args.exclude_background)
    scores = scores.orderBy("subject", "label").cache()
    files.write_csv(scores.coalesce(1), os.path.join(args.out, "score.csv"))
    _print(evaluation.subject_means(scores), "subject")
    _print(evaluation.summary(scores))
    return scores


def chosen(spark: SparkSession, subjects: list[str], args: argparse.Namespace) -> list[str]:
    """The subjects that a run takes: the one at --task-id, the first --limit, or all."""
    if args.task_id is not None:
        names = spark.createDataFrame([(s,) for s in subjects], "name string")
        return [r["name"] for r in cohort.at_positions(names, [args.task_id]).collect()]
    return subjects[: args.limit]


def register(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, str]]:
    """Warp every atlas to every target, but no subject to itself and none that is left out. Returns the pairs done."""
    out = set(args.leave_out or ())
    atlases = [a for a in files.local_dirs(args.atlas_root) if os.path.isfile(os.path.join(args.atlas_root, a, args.labels_name))]
    root = args.targets or args.atlas_root
    targets = [s for s in files.local_dirs(root) if os.path.isfile(os.path.join(root, s, args.image_name)) and (not out or s in out)]
    names = lambda x, c: spark.createDataFrame([(n,) for n in x], f"{c} string")
    pairs = cohort.every_source(names(chosen(spark, targets, args), "target"), names([a for a in atlases if a not in out], "name"))
    if args.skip_existing:
        done = [(t, a) for t in targets for a in atlases if os.path.isfile(os.path.join(args.warped, t, a, "labels.nii.gz"))]
        pairs = cohort.unfinished(pairs, spark.createDataFrame(done, "target string, name string"), ["target", "name"])
    mask = lambda folder, s: p if os.path.isfile(p := os.path.join(folder, s, args.mask_name)) else None
    of_target = _paths(spark, [(s, os.path.join(root, s, args.image_name), mask(root, s)) for s in targets], "target string, target_image string, target_mask string")
    of_source = _paths(spark, [(a, os.path.join(args.atlas_root, a, args.image_name), os.path.join(args.atlas_root, a, args.labels_name), mask(args.atlas_root, a)) for a in atlases], "name string, source_image string, source_labels string, source_mask string")
    programs = Programs(registration_dir=args.programs, threads=args.threads)
    found = registration.register(pairs.join(of_target, "target").join(of_source, "name"), args.warped, programs)
    return sorted((r["target"], r["name"]) for r in found.select("target", "name").collect())


def align(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Align a cohort to a template by rewriting headers, into out/S. Returns the subjects done."""
    subjects = [s for s in files.local_dirs(args.root) if os.path.isfile(os.path.join(args.root, s, args.image_name)) and os.path.isfile(os.path.join(args.root, s, args.labels_name))]
    rows = [(s, os.path.join(args.root, s, args.image_name), os.path.join(args.root, s, args.labels_name)) for s in chosen(spark, subjects, args)]
    programs = Programs(registration_dir=args.programs, threads=args.threads)
    found = registration.prealign(_paths(spark, rows, "name string, image string, labels string"), args.template, args.out, programs)
    return sorted((r["name"] for r in found.collect()), key=subjects.index)


def segment(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Segment subjects from warped sources: targets/S/image, warped/S/A/image and labels. Returns the subjects done.

    All subjects are one run. With --batch so many at a time, so that a run that
    is stopped keeps what is done; --skip-existing takes it up again.
    """
    subjects = chosen(spark, [s for s in files.local_dirs(args.targets) if os.path.isdir(os.path.join(args.warped, s))], args)
    target = lambda s: os.path.join(s, "parcellation.nii.gz")
    todo = [s for s in subjects if not (args.skip_existing and os.path.exists(os.path.join(args.results, target(s))))]
    left_out, done = set(args.leave_out or ()), []
    structures, tissues = files.read_structures(spark, args.structures), files.read_tissues(spark, args.tissues)
    # a batch's stencils share one spacing
    images = volumes.headers(_paths(spark, [(s, os.path.join(args.targets, s, args.image_name)) for s in todo], "subject string, path string"))
    by_spacing: dict[tuple, list[str]] = {}
    for r in images.select("subject", "spacing").collect():
        by_spacing.setdefault(tuple(r["spacing"]), []).append(r["subject"])
    runs = [(spacing, own[a : a + args.batch]) for spacing, own in by_spacing.items() for own in [sorted(own, key=todo.index)] for a in range(0, len(own), args.batch)]
    for spacing, batch in runs:
        before = tables_written()
        one = lambda n: [(s, p) for s in batch if os.path.exists(p := os.path.join(args.targets, s, n))]  # noqa: B023, E731
        sources = [(s, a) for s in batch for a in files.local_dirs(os.path.join(args.warped, s)) if a != s and a not in left_out]
        warped = lambda n: _paths(spark, [(s, a, os.path.join(args.warped, s, a, n)) for s, a in sources], "subject string, source string, path string")  # noqa: B023, E731
        targets = volumes.voxels(_paths(spark, one(args.image_name), "subject string, path string"), "intensity")
        masks = volumes.voxels(_paths(spark, one(args.mask_name), "subject string, path string"), "mask", labels=True)
        targets = targets.join(masks.select(*flow.KEYS, "mask"), flow.KEYS, "left").withColumn("mask", F.coalesce("mask", F.lit(1)))
        keys = [*flow.KEYS, "source"]
        both = volumes.voxels(warped(args.image_name), "intensity").select(*keys, "intensity").join(volumes.voxels(warped(args.labels_name), "label", labels=True).select(*keys, "label"), keys)
        result = flow.segment(targets, both, structures, tissues, spacing)
        names = _paths(spark, [(s, target(s)) for s in batch], "subject string, path string")
        headers = images.where(F.col("subject").isin(batch)).drop("path").join(names, "subject")
        done += sorted((r["subject"] for r in volumes.write_volumes(result.parcellation, headers, args.results).collect()), key=batch.index)
        drop_written(spark, before)
    return done


def clean(spark: SparkSession, args: argparse.Namespace) -> int:
    """Replace labels by the commonest one around, in root/S/labels; writes *_cleaned.nii.gz beside and returns the voxels changed."""
    subjects = [s for s in files.local_dirs(args.root) if os.path.isfile(os.path.join(args.root, s, args.labels_name))]
    rows = _paths(spark, [(s, os.path.join(args.root, s, args.labels_name)) for s in subjects], "subject string, path string")
    before = volumes.voxels(rows, "label", labels=True).select(*flow.KEYS, "label")
    after = flow.clean(before, args.replace)
    out = args.labels_name.removesuffix(".gz").removesuffix(".nii") + "_cleaned.nii.gz"
    names = _paths(spark, [(s, os.path.join(s, out)) for s in subjects], "subject string, path string")
    volumes.write_volumes(after, volumes.headers(rows).drop("path").join(names, "subject"), args.root).collect()
    changed = labels.changed_count(before, after, flow.KEYS).first()["n_changed"]
    print(f"changed voxels: {changed}")
    return changed


def label_tables(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """structures_info.csv and tissues_info.csv of a cohort from its label lists (XML) and a reference list with classes."""
    tissues, reference = files.read_label_xml(spark, args.reference)
    reference = reference.select(F.col("original").alias("pos"), "name", "tissues")
    items = files.read_named_labels(spark, args.names).select(F.lit("all").alias("source"), F.col("label").alias("pos"), "label", "name")
    subjects = [s for s in files.local_dirs(args.root) if os.path.isfile(os.path.join(args.root, s, args.labels_name))]
    volumes_ = _paths(spark, [(s, os.path.join(args.root, s, args.labels_name)) for s in subjects], "subject string, path string")
    present = labels.distinct_labels(volumes.voxels(volumes_, "label", labels=True)).select(F.lit("all").alias("source"), "label")
    structures = labels.assign_tissues(items, reference, present).orderBy("label").cache()
    files.write_csv(structures.coalesce(1), os.path.join(args.out, "structures_info.csv"))
    files.write_csv(tissues.orderBy("label").coalesce(1), os.path.join(args.out, "tissues_info.csv"), quote=False)
    return structures


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, required: tuple[str, ...], **defaults: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=run.__doc__.splitlines()[0])
        c.set_defaults(run=run)
        for x in required:
            c.add_argument(x, required=True)
        for x, value in defaults.items():
            c.add_argument("--" + x.replace("_", "-"), default=value)
        return c

    def cohort_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--limit", type=int)
        c.add_argument("--task-id", type=int, help="take only the subject at this position, from 0")
        c.add_argument("--leave-out", nargs="+", metavar="NAME")
        c.add_argument("--skip-existing", action="store_true")

    names = {"image_name": "image.nii.gz", "mask_name": "mask.nii.gz", "labels_name": "labels.nii.gz"}
    e = command("evaluate", evaluate, ("--pred-dir", "--gt-dir"), prediction_name="parcellation.nii.gz", gt_name="labels.nii.gz", out=".")
    e.add_argument("--exclude-background", action="store_true")
    r = command("register", register, ("--atlas-root", "--warped"), **names, programs="/usr/local/bin")
    r.add_argument("--targets", help="folder of targets; without, the atlases are targets of each other")
    r.add_argument("--threads", type=int, default=8)
    cohort_options(r)
    a = command("align", align, ("--root", "--template", "--out"), image_name="image.nii.gz", labels_name="labels.nii.gz", programs="/usr/local/bin")
    a.add_argument("--threads", type=int, default=8)
    a.add_argument("--limit", type=int)
    a.add_argument("--task-id", type=int)
    s = command("segment", segment, ("--targets", "--warped", "--results", "--structures", "--tissues"), **names)
    s.add_argument("--batch", type=int, default=16)
    cohort_options(s)
    c = command("clean", clean, ("--root",), labels_name="labels.nii.gz")
    c.add_argument("--replace", type=int, nargs="+", required=True)
    command("labels", label_tables, ("--root", "--names", "--reference"), labels_name="labels.nii.gz", out=".")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    return args.run(spark, args)
