"""Registration by external programs: of sources to targets, and of a cohort to a template.

Sources to targets: affine, non-linear, then both resamplings. A pair is one
task: its steps need each other's files. What comes out is the layout that the
segmentation flow reads: out/target/name/image.nii.gz and labels.nii.gz.

A cohort to a template: a coarse affine registration, after which the headers of
images and labels are rewritten; their voxels stay.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import resample
from gridloom.session import let_workers_import
from gridloom.sources import files, nifti, volumes
from gridloom.sources.adapters import Commands, Programs, require_success

_WORK = "target string, name string, position int, step string, command array<string>"


def steps(programs: Programs, target: str, source_image: str, source_labels: str, out: str, target_mask: str | None = None, source_mask: str | None = None) -> list[tuple[str, list[str]]]:
    """The commands of one pair in their order; out: the pair's folder, which the first makes."""
    at = lambda name: os.path.join(out, name)
    affine, grid = at("affine.txt"), at("cpp.nii.gz")
    return [
        ("folder", ["mkdir", "-p", out]),
        ("affine", programs.affine(target, source_image, at("affine_image.nii.gz"), affine, target_mask, source_mask)),
        ("nonlinear", programs.nonlinear(target, source_image, affine, at("cubic_image.nii.gz"), grid, target_mask, source_mask)),
        ("image", programs.resample(target, source_image, grid, at("image.nii.gz"), linear=True)),
        ("labels", programs.resample(target, source_labels, grid, at("labels.nii.gz"), linear=False)),
    ]


def registration_work(pairs: DataFrame, out: str, programs: Programs = Programs()) -> DataFrame:
    """The work list of pairs (target, name, target_image, target_mask, source_image, source_labels, source_mask; masks may be null)."""
    let_workers_import(pairs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                folder = os.path.join(out, r.target, r.name)
                rows += [(r.target, r.name, i, step, command) for i, (step, command) in enumerate(steps(programs, r.target_image, r.source_image, r.source_labels, folder, r.target_mask, r.source_mask))]
            yield pd.DataFrame(rows, columns=["target", "name", "position", "step", "command"])

    text = [F.col(c).cast("string").alias(c) for c in ("target", "name", "target_image", "target_mask", "source_image", "source_labels", "source_mask")]
    return pairs.select(*text).mapInPandas(run, _WORK)


def register(pairs: DataFrame, out: str, programs: Programs = Programs(), commands: Commands | None = None) -> DataFrame:
    """Run all steps of all pairs; a failed step is an error that names its pair. Returns target, name, image, labels."""
    results = require_success((commands or Commands(threads=programs.threads)).run(registration_work(pairs, out, programs)))
    done = results.groupBy("target", "name").agg(F.max("exit_code").alias("code")).where("code = 0")
    at = lambda file: F.concat_ws("/", F.lit(out), "target", "name", F.lit(file))
    return done.select("target", "name", at("image.nii.gz").alias("image"), at("labels.nii.gz").alias("labels"))


def prealign(images: DataFrame, template: str, out: str, programs: Programs = Programs(), commands: Commands | None = None) -> DataFrame:
    """Align images and their labels to a template by their headers alone; name, image, labels of the aligned copies.

    images: name, image, labels. Registered copies and affines go to out/name.
    """
    spark = images.sparkSession
    let_workers_import(spark)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                folder = os.path.join(out, r.name)
                command = programs.prealign(template, r.image, os.path.join(folder, "resampled.nii.gz"), os.path.join(folder, "affine.txt"))
                rows += [("template", r.name, 0, "folder", ["mkdir", "-p", folder]), ("template", r.name, 1, "prealign", command)]
            yield pd.DataFrame(rows, columns=["target", "name", "position", "step", "command"])

    work = images.select("name", "image").mapInPandas(plan, _WORK)
    done = {r["name"] for r in require_success((commands or Commands(threads=programs.threads)).run(work)).select("name").distinct().collect()}
    affines = files.matrices(files.read_matrix(spark, os.path.join(out, "*", "affine.txt"))).select(F.element_at(F.split("path", "/"), -2).alias("name"), F.col("matrix").alias("affine"))
    sforms = volumes.headers(images.where(F.col("name").isin(list(done))), "image").select("name", "image", "labels", F.col("affine").alias("sform"))
    aligned = resample.registered_sforms(sforms.join(affines, "name"))

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                affine = np.array([list(x) for x in r.registered], float)
                rows.append((r.name, *(nifti.rewrite_sform(p, affine, os.path.join(out, r.name)) for p in (r.image, r.labels))))
            yield pd.DataFrame(rows, columns=["name", "image", "labels"])

    return aligned.select("name", "image", "labels", "registered").mapInPandas(rewrite, "name string, image string, labels string")
