"""Rule sets: routing of languages to rule folders, inventories, and what counts as security."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def routes(spark: SparkSession, configs: dict[str, list[str]]) -> DataFrame:
    """Rows (language, folder) of a configuration."""
    return spark.createDataFrame([(k, f) for k, fs in sorted(configs.items()) for f in fs], "language string, folder string")


def folders_for(languages: DataFrame, configs: DataFrame) -> DataFrame:
    """Distinct rule folders of the languages (…, language), by the columns beside it.

    ``configs`` is a configuration, a few rows for each language, and so goes to every task."""
    return languages.join(F.broadcast(configs), "language").drop("language").distinct()


def unrouted(languages: DataFrame, configs: DataFrame) -> DataFrame:
    """Languages without a rule folder, and folders that lead outside the rule root."""
    lone = languages.select("language").distinct().join(configs, "language", "left_anti").select(F.lit("NO_RULE_FOLDER").alias("rule_id"), F.col("language").alias("key"), F.lit("").alias("detail"))
    bad = configs.filter(~T.is_safe_path(F.col("folder"))).select(F.lit("UNSAFE_FOLDER").alias("rule_id"), F.col("language").alias("key"), F.col("folder").alias("detail"))
    return lone.unionByName(bad)


def snapshot_configs(snapshots: DataFrame, detected: DataFrame, configs: DataFrame, overrides: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows (repo_url, commit, folder): folders of a snapshot's languages.

    ``snapshots`` may name its languages (array, aliases allowed), which then
    stand instead of the ``detected`` (repo_url, commit, language) ones and
    use ``overrides`` if given.
    """
    names = F.create_map(*[F.lit(x) for pair in (aliases or {}).items() for x in pair]) if aliases else None
    named = snapshots.filter(F.size(F.coalesce("languages", F.array())) > 0).select("repo_url", "commit", F.explode("languages").alias("l"))
    low = F.lower(F.trim("l"))
    named = named.select("repo_url", "commit", (F.coalesce(F.try_element_at(names, low), low) if names is not None else low).alias("language"))
    rest = detected.join(named.select("repo_url", "commit"), ["repo_url", "commit"], "left_anti")
    return folders_for(named, overrides if overrides is not None else configs).unionByName(folders_for(rest, configs)).distinct()


def assembled_inventory(languages: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (rule_id, files): the rules that the languages (language) of all
    snapshots call for, over rule files (folder, file, line, rule_id)."""
    folders = folders_for(languages.select("language").distinct(), configs)
    return files.join(folders, "folder", "left_semi").groupBy("rule_id").agg(F.array_sort(F.collect_set("file")).alias("files"))


def inventory(ids: DataFrame) -> DataFrame:
    """One row of counts over (file, line, rule_id)."""
    n = ids.groupBy("rule_id").agg(F.count("*").alias("n"))
    totals = n.agg(F.sum("n").alias("rule_id_occurrences"), F.count("*").alias("unique_rule_ids"), F.count_if(F.col("n") > 1).alias("duplicate_rule_ids"))
    return ids.agg(F.count_distinct("file").alias("config_files")).crossJoin(totals)  # one row each


def duplicate_rules(ids: DataFrame) -> DataFrame:
    """Rows (rule_id, occurrences) of ids that stand in more than one place."""
    return ids.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("occurrences")).filter(F.size("occurrences") > 1)


def security_files(categories: DataFrame, category: str = "security") -> DataFrame:
    """Rows (folder, file, rules, verdict) over (file, rule_id, category): files whose
    rules are all of the category are SELECTED, none SKIPPED, some MIXED."""
    own = F.coalesce(T.fold(F.trim("category")) == category, F.lit(False))
    g = categories.groupBy("file").agg(F.count("*").alias("rules"), F.bool_and(own).alias("every"), F.bool_or(own).alias("some"))
    verdict = F.when(F.col("every"), "SELECTED").when(F.col("some"), "MIXED").otherwise("SKIPPED")
    folder = F.when(F.contains("file", F.lit("/")), F.substring_index("file", "/", 1)).otherwise("")
    return g.select(folder.alias("folder"), "file", "rules", verdict.alias("verdict"))


def selection_counts(files: DataFrame) -> DataFrame:
    """Rows (folder, selected, skipped, mixed) of ``security_files``."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return files.groupBy("folder").agg(n("SELECTED").alias("selected"), n("SKIPPED").alias("skipped"), n("MIXED").alias("mixed"))
