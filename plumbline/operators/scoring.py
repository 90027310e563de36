"""Scores from site tables: profiles, log chances, masked marginals, means by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import GateError
from .metrics import spearman_by


def log_softmax(logits: DataFrame, site: list[str], logit: str = "logit") -> DataFrame:
    """``logits`` with logp: each site's logits less the logarithm of the sum of their exponentials."""
    top = logits.groupBy(*site).agg(F.max(logit).alias("_max"))
    shifted = logits.join(top, site).withColumn("_e", F.exp(F.col(logit) - F.col("_max")))
    norm = shifted.groupBy(*site).agg(F.first("_max").alias("_m"), F.log(F.sum("_e")).alias("_log"))
    return logits.join(norm, site).withColumn("logp", F.col(logit) - F.col("_m") - F.col("_log")).drop("_m", "_log")


def site_profile(observed: DataFrame, site: list[str], token: str, tokens: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """site, token, n, logp from counts with a pseudocount, over every token of ``tokens`` (one column, few rows)."""
    counts = observed.groupBy(*site, token).agg(F.count("*").alias("n"))
    full = observed.select(*site).distinct().crossJoin(F.broadcast(tokens.select(token).distinct()))
    n_tokens = tokens.select(token).distinct().count()
    sums = observed.groupBy(*site).agg(F.count("*").alias("_all"))
    out = full.join(counts, [*site, token], "left").join(sums, site).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("logp", F.log((F.col("n") + pseudo) / (F.col("_all") + pseudo * n_tokens))).drop("_all")


def masked_marginals(variants: DataFrame, site_logp: DataFrame, variant: str, assay: str) -> DataFrame:
    """variant, assay, score: the sum over substitutions of logp(mut) - logp(wt) at their sites.

    ``variants`` has subs array<struct(pos, wt, mut)>. Sites are read once a distinct position, as a map of tokens.
    A variant without substitutions, or with a site or token that the table lacks, is an error.
    """
    flat = variants.select(variant, assay, F.explode_outer("subs").alias("s")).select(variant, assay, F.col("s.pos").alias("position"), "s.wt", "s.mut")
    maps = site_logp.groupBy(assay, "position").agg(F.map_from_entries(F.collect_list(F.struct("token", "logp"))).alias("_logp"))
    gain = F.element_at("_logp", F.col("mut")) - F.element_at("_logp", F.col("wt"))
    scored = flat.join(maps, [assay, "position"], "left").withColumn("_gain", gain)
    sums = scored.groupBy(variant, assay).agg(F.sum("_gain").alias("score"), F.count_if(F.col("_gain").isNull()).alias("_lack"))
    return sums.select(variant, assay, F.when(F.col("_lack") > 0, F.raise_error(F.lit("a variant has no site, or no substitution"))).otherwise(F.col("score")).alias("score"))


def position_means(train: DataFrame, test: DataFrame, by: list[str], position: str, score: str) -> DataFrame:
    """``test`` with predicted: the mean training score at its position, null where none was trained on."""
    means = train.groupBy(*by, position).agg(F.avg(score).alias("predicted"))
    return test.join(means, [*by, position], "left")


def zero_shot(scored: DataFrame, roles: DataFrame, key: str, by: list[str], score: str, truth: str) -> DataFrame:
    """by, n, spearman of scores on test rows only; without a test row it is an error."""
    test = scored.join(roles.where(F.col("role") == "test"), key)
    if not test.take(1):
        raise GateError("there is no test row")
    return spearman_by(test, by, score, truth)


def additivity_residuals(scores: DataFrame, assay: str) -> DataFrame:
    """variant, residual: the score of a variant less the sum of its single substitutions' scores; null if one is missing.

    ``scores`` has variant (parts joined by ``:``), score.
    """
    parts = scores.where(F.col("variant").contains(":")).select(assay, "variant", "score", F.explode(F.split("variant", ":")).alias("part"))
    singles = scores.where(~F.col("variant").contains(":")).select(assay, F.col("variant").alias("part"), F.col("score").alias("_single"))
    sums = parts.join(singles, [assay, "part"], "left").groupBy(assay, "variant", "score").agg(F.sum("_single").alias("_sum"), F.count_if(F.col("_single").isNull()).alias("_lack"))
    return sums.select(assay, "variant", F.when(F.col("_lack") == 0, F.col("score") - F.col("_sum")).alias("residual"))


def singles_to_multiples(variants: DataFrame) -> DataFrame:
    """``variants`` (with subs) with role: one substitution trains, more test."""
    return variants.withColumn("role", F.when(F.size("subs") == 1, "train").otherwise("test"))
