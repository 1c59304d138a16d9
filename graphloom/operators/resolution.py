"""Resolving names at call sites to symbols, in order of nearness, with a confidence label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize


def resolve_names(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per site and candidate: site_id, dst_id, confidence.

    sites: site_id, group_id (project), file_id, scope (the qualified name of the calling symbol, may be null), name.
    symbols: id, group_id, file_id, name, qualified_name.
    A dotted name is looked up as qualified name in the file. Another one in the scopes of its file, the innermost first,
    then at the file's top level. What the file lacks is looked up in the project by name or qualified name. The first of
    these places with a candidate decides: in the file it is `resolved_local`, in the project `unique_in_project`; several
    candidates there are `ambiguous`, one row each; none gives `name:<name>`, `unresolved`. Sites without a name have no
    row. Distinct lookups are resolved, so a name called everywhere is looked up once per scope and file.
    """
    asked_of = ["group_id", "file_id", "scope", "name"]
    # a lookup is named by a digest of what is asked, so all joins are by one plain key
    sites = sites.where("name is not null").withColumn("look", F.md5(F.to_json(F.struct(*asked_of))))
    asked = materialize(sites.groupBy("look").agg(F.any_value(F.struct(*asked_of)).alias("_a")).select("look", "_a.*"))
    parts = F.split(F.coalesce("scope", F.lit("")), r"\.")
    depth = F.when(F.coalesce("scope", F.lit("")) == "", 0).otherwise(F.size(parts))
    dotted = F.col("name").contains(".")
    steps = F.when(dotted, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), depth))
    tried = asked.withColumn("up", F.explode(steps))
    prefix = F.array_join(F.slice(parts, 1, depth - F.col("up")), ".")
    full = F.when(dotted | (F.col("up") == depth), F.col("name")).otherwise(F.concat(prefix, F.lit("."), "name"))
    tried = tried.select("look", "file_id", "up", full.alias("qualified_name"))
    own = symbols.select("file_id", "qualified_name", F.col("id").alias("dst_id")).distinct()
    local = materialize(tried.join(own, ["file_id", "qualified_name"]).select("look", "up", "dst_id"))
    # of a lookup's places the nearest, with the number of candidates there
    near = local.groupBy("look", "up").agg(F.count("*").alias("n")).groupBy("look").agg(F.min(F.struct("up", "n")).alias("_b")).select("look", "_b.*")
    home = local.join(near, ["look", "up"]).select("look", "dst_id", "n", F.lit("resolved_local").alias("place"))
    rest = asked.join(near, "look", "left_anti").select("look", "group_id", "name")
    names = symbols.select("group_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"), F.col("id").alias("dst_id")).where("name is not null").distinct()
    # project-wide a name is asked once, whatever the files and scopes it is asked from
    wanted = materialize(names.join(rest.select("group_id", "name").distinct(), ["group_id", "name"], "left_semi"))
    several = wanted.groupBy("group_id", "name").agg(F.count("*").alias("n"))
    away = rest.join(several, ["group_id", "name"], "left").join(wanted, ["group_id", "name"], "left")
    away = away.select("look", F.coalesce("dst_id", F.concat(F.lit("name:"), "name")).alias("dst_id"), F.coalesce("n", F.lit(0)).alias("n"), F.lit("unique_in_project").alias("place"))
    confidence = F.when(F.col("n") == 0, "unresolved").when(F.col("n") > 1, "ambiguous").otherwise(F.col("place"))
    found = home.unionByName(away).select("look", "dst_id", confidence.alias("confidence"))
    return sites.select("site_id", "look").join(found, "look").select("site_id", "dst_id", "confidence")


def affected_sites(sites: DataFrame, changed_files: DataFrame, affected_names: DataFrame) -> DataFrame:
    """The sites to be resolved anew: those in changed files (file_id), and those whose name (or its last part) is among
    affected_names (name), each once."""
    in_files = sites.join(changed_files.select("file_id").distinct(), "file_id", "left_semi")
    last = F.element_at(F.split("name", r"\."), -1)
    names = affected_names.select(F.col("name").alias("_name")).distinct()
    by_name = sites.where("name is not null").withColumn("_name", F.explode(F.array_distinct(F.array("name", last)))).join(names, "_name", "left_semi").drop("_name")
    return in_files.unionByName(by_name).distinct()


def resolved_again(sites: DataFrame, symbols: DataFrame, before: DataFrame, changed_files: DataFrame, affected_names: DataFrame) -> DataFrame:
    """What resolve_names gives for all sites, computed from an earlier result (before: site_id, dst_id, confidence) and the
    affected sites only. Sites that are gone are dropped."""
    again = affected_sites(sites, changed_files, affected_names)
    kept = before.join(again.select("site_id").distinct(), "site_id", "left_anti").join(sites.select("site_id").distinct(), "site_id", "left_semi")
    return kept.unionByName(resolve_names(again, symbols))
