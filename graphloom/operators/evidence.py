"""Operators on record graphs: integrity, containment matches, impact and retirement over tables that refer to each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import peeled
from graphloom.session import hinted, materialize, weight


@dataclass(frozen=True)
class Reference:
    """A field of a table that names records of another: one id, or an array of ids if many."""

    table: str
    field: str
    target: str
    many: bool = False


def references(tables: dict[str, DataFrame], rules: list[Reference]) -> DataFrame:
    """All references as rows: table, id, field, target, ref_id. Null references and nulls in arrays are none."""
    parts = []
    for r in rules:
        value = F.explode(F.col(r.field)) if r.many else F.col(r.field)
        parts.append(tables[r.table].select(F.lit(r.table).alias("table"), "id", F.lit(r.field).alias("field"), F.lit(r.target).alias("target"), value.alias("ref_id")).where("ref_id is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(tables: dict[str, DataFrame], rules: list[Reference], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """Broken rules together: table, id, field, rule, value. `missing`: a reference to no record; `repeated`: the same id
    twice in an array; `duplicate`: two records with the same id or the same value of a field listed in unique."""
    refs = references(tables, rules)
    targets = None
    for name in sorted({r.target for r in rules}):
        part = tables[name].select(F.lit(name).alias("target"), F.col("id").alias("ref_id"))
        targets = part if targets is None else targets.unionByName(part)
    keys = refs.select("target", "ref_id").distinct().join(targets, ["target", "ref_id"], "left_anti")
    missing = refs.join(keys, ["target", "ref_id"], "left_semi").select("table", "id", "field", F.lit("missing").alias("rule"), F.col("ref_id").alias("value"))
    twice = refs.groupBy("table", "id", "field", "ref_id").agg(F.count("*").alias("n")).where("n > 1").select("table", "id", "field", F.lit("repeated").alias("rule"), F.col("ref_id").alias("value"))
    out = missing.unionByName(twice)
    for name, df in tables.items():
        for field in ["id", *(unique or {}).get(name, [])]:
            dup = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
            out = out.unionByName(dup.select(F.lit(name).alias("table"), "id", F.lit(field).alias("field"), F.lit("duplicate").alias("rule"), "value"))
    return out


def circular(links: DataFrame) -> bool:
    """Whether links (src, dst) have a circle, self-links included."""
    return not links.where("src = dst").isEmpty() or not peeled(links).isEmpty()


def matched_by_range(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer_id and inner_id of records (source_id, kind, name, id, start_line, end_line) of equal source, kind and name
    where the outer one begins at or before and ends at or after the inner one's start, the match being the only one for
    either side."""
    a = outer.select("source_id", "kind", "name", F.col("id").alias("outer_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    hits = a.join(inner.select("source_id", "kind", "name", F.col("id").alias("inner_id"), "start_line"), ["source_id", "kind", "name"]).where((F.col("s") <= F.col("start_line")) & (F.col("start_line") <= F.col("e")))
    hits = materialize(hits.select("outer_id", "inner_id").distinct())
    one = lambda c, other: hits.groupBy(c).agg(F.count("*").alias("n"), F.min(other).alias(other)).where("n = 1").select("outer_id", "inner_id")
    return one("outer_id", "inner_id").intersect(one("inner_id", "outer_id"))


def reached(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ids that links (src, dst) lead to from seeds (id), seeds included. Rounds go on until none is new."""
    frontier = materialize(seeds.where("id is not null").select("id").distinct(), measured=True)
    seen = frontier
    while weight(frontier)[0]:
        side = hinted(frontier).withColumnRenamed("id", "src")
        step = links.join(side, "src", "left_semi").select(F.col("dst").alias("id")).where("id is not null").distinct()
        frontier = materialize(step.join(seen, "id", "left_anti"), measured=True)
        seen = materialize(seen.unionByName(frontier))
    return seen


def impact_links(relations: DataFrame, derivations: DataFrame | None = None) -> DataFrame:
    """Which record a change of src reaches: relations (kind, from_id, to_id) of kind call, reference, inherit and
    implements lead from what is used to what uses it, data, control, event, read and write with the flow; derivations
    (src, dst) lead from a value to what is made of it."""
    back = relations.where(F.col("kind").isin("call", "reference", "inherit", "implements")).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    on = relations.where(F.col("kind").isin("data", "control", "event", "read", "write")).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    out = back.unionByName(on)
    return out if derivations is None else out.unionByName(derivations.select("src", "dst"))


def retired(tables: dict[str, DataFrame], gone: DataFrame, any_of: list[Reference], all_of: list[Reference]) -> DataFrame:
    """(table, id) of the records that cannot stay when those in gone (table, id) are removed: one that lost a reference
    of any_of, or all references of a field of all_of (of which it had some). Rounds go on until no more follow."""
    loses_one = references(tables, any_of) if any_of else None
    loses_all = materialize(references(tables, all_of)) if all_of else None
    out = materialize(gone.select("table", "id").distinct())
    n = out.count()
    while True:
        dead = out.select(F.col("table").alias("target"), F.col("id").alias("ref_id"))
        new = out
        if loses_one is not None:
            new = new.unionByName(loses_one.join(dead, ["target", "ref_id"], "left_semi").select("table", "id"))
        if loses_all is not None:
            left = loses_all.join(dead, ["target", "ref_id"], "left_anti").select("table", "id", "field").distinct()
            new = new.unionByName(loses_all.select("table", "id", "field").distinct().join(left, ["table", "id", "field"], "left_anti").select("table", "id"))
        out = materialize(new.distinct())
        if (m := out.count()) == n:
            return out
        n = m


def import_candidates(sites: DataFrame, files: DataFrame) -> DataFrame:
    """site_id, file_id, reason: the files (group_id, id, path) that Python import sites (site_id, group_id, path, text) may
    mean. A dotted module is looked for as a file and as a package, relative ones from the importing file's folder."""
    text = F.trim("text")
    relative = F.regexp_extract(text, r"^from\s+(\.+)", 1)
    module = F.when(text.rlike(r"^from\s"), F.regexp_extract(text, r"^from\s+\.*([\w.]*)", 1)).otherwise(F.regexp_extract(text, r"^import\s+([\w.]+)", 1))
    names = F.filter(F.split(F.regexp_replace(F.regexp_extract(text, r"\bimport\s+\(?([\w\s,*]+)", 1), r"\s+as\s+\w+", ""), r"[\s,]+"), lambda x: (x != "") & (x != "*"))
    folders = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    kept = F.size(folders) - F.length(relative) + 1
    base = F.when(F.length(relative) > 0, F.array_join(F.slice(folders, 1, F.greatest(kept, F.lit(0))), "/")).otherwise(F.lit(""))
    inner = F.replace(module, F.lit("."), F.lit("/"))
    stem = F.regexp_replace(F.concat_ws("/", base, inner), r"^/+|/+$", "")
    direct = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    below = F.transform(F.when(text.rlike(r"^from\s"), names).otherwise(F.array().cast("array<string>")), lambda x: F.concat(F.when(stem != "", F.concat(stem, F.lit("/"))).otherwise(F.lit("")), x, F.lit(".py")))
    tried = sites.select("site_id", "group_id", F.posexplode(F.concat(direct, below)).alias("_k", "path"))
    reason = F.when(F.col("_k") == 0, "module").when(F.col("_k") == 1, "package").otherwise("member")
    return tried.withColumn("reason", reason).join(files.select("group_id", "path", F.col("id").alias("file_id")), ["group_id", "path"]).select("site_id", "file_id", "reason").distinct()


def records(table: DataFrame, ids: list[str] | None = None, offset: int = 0, limit: int = 100, **equal: object) -> DataFrame:
    """Records by id and by fields: a field equals the given value or, if it is an array, contains it. Ordered by id."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must be at least 0 and limit from 1 to 500")
    kinds = dict(table.dtypes)
    for field, value in equal.items():
        if field not in kinds:
            raise ValueError(f"no field {field}")
        table = table.where(F.array_contains(field, value) if kinds[field].startswith("array") else F.col(field).eqNullSafe(F.lit(value)))
    if ids is not None:
        table = table.where(F.col("id").isin(ids))
    return table.orderBy("id").offset(offset).limit(limit)
