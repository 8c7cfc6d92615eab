"""Statistics of skills: monthly sums, filters by score, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S

_DEFAULT = Config()
USER = ["repo", "author"]
STAT = [*USER, "lang", "ym", "model", "skill"]
# The kinds of models whose statistics are filtered.
KINDS = ("c2s", "i2s", "life_of_py")


def skill_months(scores: DataFrame) -> DataFrame:
    """The ten values of every author, language, month, model and skill, in one aggregation."""
    return scores.groupBy(*STAT).agg(
        F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.sum("score").alias("sum_score"),
        F.max("sm_score").alias("max_sm"), F.min("sm_score").alias("min_sm"), F.sum("sm_score").alias("sum_sm"),
        F.count(F.lit(1)).alias("snippets"), F.sum("line_count").cast("bigint").alias("code_lines"), F.sum("doc_lines").cast("bigint").alias("doc_lines"), F.max("is_labeled").alias("is_labeled"),
    )


def skill_totals(scores: DataFrame) -> DataFrame:
    """Lines by skill; each skill of a chunk gets all the chunk's lines. Only code-to-skill models count."""
    return scores.filter(S.model_type("model") == "c2s").groupBy(*USER, "skill").agg(F.sum("line_count").cast("bigint").alias("code_lines"))


def filter_skills(stats: DataFrame, totals: DataFrame, min_scores: dict[str, float] | None = None, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Statistics and totals without weak, unsupported and curated-away skills.

    Rows whose best score isn't above their kind's minimum go, and their lines with them (a total stays at 0
    or more). Of the rest, rows of skills without a total or in ``manual`` (skill) go, but for quality models. A
    total goes if its skill was seen and is in ``manual`` or no row of a code-to-skill model is left for it.
    """
    limit = F.lit(0.0)
    for kind, least in (min_scores or {}).items():
        limit = F.when(F.col("_kind") == kind, F.lit(least)).otherwise(limit)
    rows = stats.withColumn("_kind", S.model_type("model")).withColumn("_known", F.col("_kind").isin(*KINDS)).withColumn("_weak", F.col("_known") & (F.col("max_score") <= limit))
    named = totals.select(*USER, "skill").withColumn("_total", F.lit(True))
    curated = (totals.select("skill").limit(0) if manual is None else manual.select("skill").distinct()).withColumn("_manual", F.lit(True))
    rows = rows.join(named, [*USER, "skill"], "left").join(curated, "skill", "left").withColumns({"_total": F.coalesce("_total", F.lit(False)), "_manual": F.coalesce("_manual", F.lit(False))})
    gone = F.col("_known") & (F.col("_weak") | ((F.col("_kind") != "life_of_py") & (~F.col("_total") | F.col("_manual"))))
    facts = rows.filter("_known").groupBy(*USER, "skill").agg(
        F.sum(F.when(F.col("_weak"), F.col("code_lines")).otherwise(0)).alias("_less"),
        F.max(~gone & (F.col("_kind") == "c2s")).alias("_good"), F.max("_manual").alias("_curated"),
    )
    left = totals.join(facts, [*USER, "skill"], "left").filter(F.col("_good").isNull() | (F.col("_good") & ~F.col("_curated")))
    left = left.withColumn("code_lines", F.greatest(F.lit(0), F.col("code_lines") - F.coalesce("_less", F.lit(0))).cast("bigint"))
    return rows.filter(~gone).select(*stats.columns), left.select(*totals.columns)


def default_choices(totals: DataFrame, config: Config = _DEFAULT, saved: DataFrame | None = None) -> DataFrame:
    """skill, lines, choice: skills of less than a fifth of the mean go, those above two fifths are relevant.

    Where choices (skill, choice) were saved before, these stand instead, for the skills they have and no others.
    """
    sums = totals.groupBy("skill").agg(F.sum("code_lines").cast("bigint").alias("lines"))
    mean = sums.agg(F.try_divide(F.sum("lines").cast("double"), F.count(F.lit(1))).alias("mean"))
    out = sums.crossJoin(F.broadcast(mean))  # one row
    choice = F.when(F.col("lines") > config.relevant_above_mean * F.col("mean"), "Relevant").otherwise("Not Relevant")
    out = out.filter(F.col("lines") >= config.drop_below_mean * F.col("mean")).select("skill", "lines", choice.alias("choice"))
    return out if saved is None else saved.select("skill", "choice").join(out.drop("choice"), "skill", "left").select("skill", "lines", "choice")


def weak_skills(totals: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """The skills that :func:`default_choices` leaves out."""
    return totals.select("skill").distinct().join(default_choices(totals, config).select("skill"), "skill", "left_anti")


def either(a: DataFrame, b: DataFrame, key: str = "skill") -> DataFrame:
    """The keys of both tables, each once: what is hidden by choice or for lack of lines."""
    return a.select(key).union(b.select(key)).distinct()


def missing(a: DataFrame, b: DataFrame, key: str = "skill") -> DataFrame:
    """The keys of the first table that the second hasn't, each once: the skills of which nothing good is left."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def apply_choices(stats: DataFrame, totals: DataFrame, choices: DataFrame, weak: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics and totals without top-secret and weak skills, and the skills to keep out of reports."""
    manual = either(choices.filter("choice = 'Top Secret'"), weak)
    stats, totals = filter_skills(stats, totals, {}, manual)
    return stats, totals, choices.filter("choice = 'Not Relevant'").select("skill")


def update_choices(choices: DataFrame, numbers: dict[int, str]) -> DataFrame:
    """Sets choices by position in the list by lines, from 1, as a person picks them; skills are distinct.

    No more of the list is looked at than the largest position picked.
    """
    most = max((n for n in numbers if n > 0), default=0)
    shown = [r["skill"] for r in choices.orderBy(F.desc("lines"), "skill").limit(most).collect()] if most else []
    new = F.col("choice")
    for no, choice in numbers.items():
        if 0 < no <= len(shown):
            new = F.when(F.col("skill").eqNullSafe(F.lit(shown[no - 1])), F.lit(choice)).otherwise(new)
    return choices.withColumn("choice", new)


def months_as_arrays(stats: DataFrame) -> DataFrame:
    """Per skill and model the months in order with their best scores, as two arrays."""
    pairs = F.array_sort(F.collect_list(F.struct("ym", "max_score")))
    out = stats.groupBy(*USER, "lang", "model", "skill").agg(pairs.alias("p"))
    return out.withColumns({"months": F.transform("p", lambda x: x["ym"]), "scores": F.transform("p", lambda x: x["max_score"])}).drop("p")
