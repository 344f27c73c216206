"""Whole flows made of the operators: segmenting a cohort and evaluating it.

segment() takes tables of warped sources (by default volumes come warped; the
adapters in sources.adapters can make them) and gives every intermediate result
that the flow has. evaluate() compares predicted with true label maps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import distance_to_weight
from gridloom.operators import em, evaluation, fusion, labels, stencil, validation
from gridloom.session import written

KEYS = ["subject", "x", "y", "z"]
GRID = ["nx", "ny", "nz"]


@dataclass(frozen=True)
class Options:
    """Parameters of the flow; defaults are those of the method."""

    temperature: float = 0.15
    lncc_sigma: float = -2.5
    prior_threshold: float = 0.01
    mask_hard: bool = False
    em_iterations: int = 30
    mrf_beta: float = 0.1
    bias_order: int = 4
    block: int = 32


@dataclass
class Segmentation:
    weights: DataFrame
    proba: DataFrame
    label_map: DataFrame
    prior: DataFrame
    tissues: DataFrame
    parcellation: DataFrame


def check_metadata(sources: DataFrame, structures: DataFrame, tissues: DataFrame) -> DataFrame:
    """Labels need a structure row, structures' classes a tissue row, class ids run from 0."""
    links = fusion.bridge(structures).select("tissue").distinct()
    ids = tissues.select(F.col("label").alias("tissue"))
    return validation.all_of(
        [validation.refers("labels have a structure", sources, structures, "label"), validation.refers("classes have a name", links, ids, "tissue"), validation.dense_from_zero("classes are 0..n-1", ids, "tissue")]
    )


def source_weights(targets: DataFrame, sources: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), options: Options = Options()) -> DataFrame:
    """subject, source, x, y, z, weight from local correlation of the source's image with the target's.

    targets: subject, x, y, z, nx, ny, nz, intensity, mask (may be null);
    sources: subject, source, x, y, z, intensity (null or NaN outside), label.
    """
    images = sources.select(*KEYS, "source", F.col("intensity").alias("_source"))
    both = targets.join(images, KEYS)
    sigma = (options.lncc_sigma,) * 3
    d = stencil.lncc_blocks(both.withColumn("_source", F.coalesce("_source", F.lit(float("nan")))), ["subject", "source"], "intensity", "_source", "mask", sigma, spacing, options.block)
    return d.select("subject", "source", "x", "y", "z", distance_to_weight(F.col("distance"), options.temperature).alias("weight"))


def segment(targets: DataFrame, sources: DataFrame, structures: DataFrame, tissues: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), options: Options = Options()) -> Segmentation:
    """Weights, vote, label map, prior, class map and parcellation of all subjects in one go, each with an EM model of its own."""
    validation.require(check_metadata(sources, structures, tissues))
    weights, _ = written(source_weights(targets, sources, spacing, options), "weights")
    votes = sources.select(*KEYS, "source", "label").join(weights, [*KEYS, "source"])
    proba, _ = written(fusion.weighted_vote(votes, KEYS), "proba")
    label_map = fusion.top_label(proba, KEYS)
    masked = proba.join(targets.select(*KEYS, "mask"), KEYS)
    prior, _ = written(fusion.tissue_prior(masked, structures, KEYS, "mask", options.prior_threshold, mask_hard=options.mask_hard), "prior")
    posterior = em.tissue_em(targets.select(*KEYS, "intensity", "mask"), prior, KEYS, options.em_iterations, mrf_beta=options.mrf_beta, bias_order=options.bias_order, coords=("x", "y", "z"), mask="mask")
    border = fusion.on_border(*(F.col(c) for c in ("x", "y", "z", *GRID)))
    classes = fusion.tissue_map(posterior.join(targets.select(*KEYS, *GRID), KEYS), KEYS, border)
    parcellation = fusion.constrained_top(proba, classes, structures, KEYS)
    return Segmentation(weights, proba, label_map, prior, classes, parcellation)


def clean(parcellation: DataFrame, replace: list[int]) -> DataFrame:
    return labels.clean_labels(parcellation, replace, ["subject"])


def evaluate(predicted: DataFrame, truth: DataFrame, exclude_background: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores by subject and label, means by subject, summary) of label maps (subject, x, y, z, label)."""
    pairs = predicted.select(*KEYS, F.col("label").alias("pred")).join(truth.select(*KEYS, F.col("label").alias("truth")), KEYS)
    scores = evaluation.dice_scores(pairs, ["subject"], exclude_background=exclude_background)
    return scores, evaluation.subject_means(scores), evaluation.summary(scores)
