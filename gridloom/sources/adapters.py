"""External registration and segmentation programs behind one interface.

By default warped volumes are expected as input (Prewarped). The command
adapters build the programs' command lines, run one task for each pair of
target and source, and report exit codes as rows instead of ignoring them.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import let_workers_import

_RESULT = "target string, name string, step string, command string, exit_code int, error string"


@dataclass(frozen=True)
class Programs:
    """Where the programs are and their parameters; the values are the defaults of the workflow."""

    registration_dir: str = "/usr/local/bin"
    segmentation_dir: str = "/usr/local/bin"
    threads: int = 8
    affine_levels: int = 2
    jacobian: float = 0.0001
    bending: float = 0.005
    max_iterations: int = 250
    levels: int = 4
    run_levels: int = 3
    spacing: float = -5.0
    lncc: float = 5.0
    interpolation: int = 1
    extra: tuple[str, ...] = field(default=())

    def affine(self, target: str, source: str, warped: str, matrix: str, target_mask: str | None = None, source_mask: str | None = None) -> list[str]:
        masks = [*(["-rmask", target_mask] if target_mask else []), *(["-fmask", source_mask] if source_mask else [])]
        return [f"{self.registration_dir}/reg_aladin", "-ref", target, "-flo", source, "-res", warped, "-aff", matrix, "-omp", str(self.threads), "-lp", str(self.affine_levels), "-voff", *masks, *self.extra]

    def prealign(self, target: str, source: str, warped: str, matrix: str) -> list[str]:
        return [f"{self.registration_dir}/reg_aladin", "-ref", target, "-flo", source, "-res", warped, "-aff", matrix, "-maxit", "5", "-ln", "3", "-lp", "2", "-speeeeed", "-voff"]

    def nonlinear(self, target: str, source: str, matrix: str, warped: str, grid: str, target_mask: str | None = None, source_mask: str | None = None) -> list[str]:
        options = {"-jl": self.jacobian, "-be": self.bending, "-maxit": self.max_iterations, "-ln": self.levels, "-lp": self.run_levels, "-sx": self.spacing, "--lncc": self.lncc, "--interp": self.interpolation}
        masks = [*(["-rmask", target_mask] if target_mask else []), *(["-fmask", source_mask] if source_mask else [])]
        return [f"{self.registration_dir}/reg_f3d", "-ref", target, "-flo", source, "-aff", matrix, *(str(x) for kv in options.items() for x in kv), "-omp", str(self.threads), "-res", warped, "-cpp", grid, "-voff", *masks]

    def resample(self, target: str, source: str, transform: str, out: str, linear: bool) -> list[str]:
        return [f"{self.registration_dir}/reg_resample", "-ref", target, "-flo", source, "-trans", transform, "-res", out, "-inter", "1" if linear else "0", "-omp", str(self.threads), "-voff"]

    def em(self, image: str, out: str, priors: str, mask: str | None = None) -> list[str]:
        fixed = ["-v", "0", "-max_iter", "30", "-min_iter", "3", "-bc_order", "4", "-bc_thresh", "0.05", "-mrf_beta", "0.1"]
        return [f"{self.segmentation_dir}/seg_EM", "-in", image, "-out", out, "-priors4D", priors, *fixed, *(["-mask", mask] if mask else [])]


class Prewarped:
    """The default: every pair's volumes are warped already."""

    def run(self, work: DataFrame) -> DataFrame:
        return work.select("target", "name", F.lit("prewarped").alias("step"), F.lit(None).cast("string").alias("command"), F.lit(0).alias("exit_code"), F.lit(None).cast("string").alias("error"))


#: Exit code of a step that wasn't run, as one before it failed.
SKIPPED = -2


class Commands:
    """Runs a work list (target, name, step, command array<string>, and position where steps depend on others).

    All steps of a target and name run in one task, by position; after a step
    that failed the others are reported as skipped. threads: cores that a
    command uses; a cluster that schedules by stage gives a task as many.
    """

    def __init__(self, timeout: int = 6 * 3600, threads: int | None = None):
        self.timeout, self.threads = timeout, threads

    def run(self, work: DataFrame) -> DataFrame:
        let_workers_import(work.sparkSession)
        timeout = self.timeout

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            failed = None
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    if failed == (r.target, r.name):
                        out.append((r.target, r.name, r.step, " ".join(r.command), SKIPPED, "an earlier step failed"))
                        continue
                    try:
                        done = subprocess.run(list(r.command), capture_output=True, text=True, timeout=timeout)
                        code, error = done.returncode, done.stderr[-2000:] if done.returncode else None
                    except (OSError, subprocess.TimeoutExpired) as e:
                        code, error = -1, str(e)
                    if code and "position" in frame.columns:
                        failed = (r.target, r.name)
                    out.append((r.target, r.name, r.step, " ".join(r.command), code, error))
                yield pd.DataFrame(out, columns=["target", "name", "step", "command", "exit_code", "error"])

        group = ["target", "name"] if "position" in work.columns else ["target", "name", "step"]
        n = max(1, work.select(*group).distinct().count())
        dealt = work.repartition(n, *group).sortWithinPartitions(*group, *(["position"] if "position" in work.columns else []))
        profile = None
        if self.threads and not work.sparkSession.sparkContext.master.startswith("local"):
            profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(self.threads)).build
        return dealt.mapInPandas(each, _RESULT, profile=profile)


def require_success(results: DataFrame) -> DataFrame:
    """The results, raising where a command failed."""
    message = F.concat(F.col("step"), F.lit(" failed for "), F.col("target"), F.lit(" and "), F.col("name"), F.lit(": "), F.coalesce("error", F.lit("")))
    return results.withColumn("exit_code", F.when(F.col("exit_code") == 0, F.col("exit_code")).otherwise(F.raise_error(message)))
