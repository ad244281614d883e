"""Validation and profiles: constraints, field coverage, type buckets, diagnostics, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Rule:
    """A constraint: rows for which `holds` is false break it; null counts as holding unless required."""

    code: str
    field: str
    holds: Column


def violations(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, field, code), one row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(True)), F.struct(F.lit(r.field).alias("field"), F.lit(r.code).alias("code"))) for r in rules]))
    return rows.select(key, F.explode(found).alias("v")).select(key, "v.field", "v.code")


def required(field: str) -> Rule:
    return Rule("missing", field, F.col(field).isNotNull())


def within(field: str, low, high) -> Rule:
    return Rule("out_of_range", field, F.col(field).between(low, high))


def matches(field: str, pattern: str) -> Rule:
    return Rule("malformed", field, F.col(field).rlike(pattern))


def one_of(field: str, *values: str) -> Rule:
    return Rule("not_allowed", field, F.col(field).isin(*values))


def sized(field: str, low: int, high: int) -> Rule:
    return Rule("bad_length", field, F.length(F.trim(field)).between(low, high))


def field_coverage(rows: DataFrame, key: str, group: str, fields: list[str], examples: int = 5) -> DataFrame:
    """(group, field, count, coverage, examples): rows of each group in which a field isn't empty, their share, and the first keys."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")
    flat = rows.select(group, key, each).select(group, key, "f.field", (F.col("f.value").isNotNull() & (F.col("f.value") != "")).alias("has"))
    counts = flat.groupBy(group, "field").agg(F.count(F.when(F.col("has"), 1)).alias("count"), F.count("*").alias("__rows"))
    # the filter on the rank limits each partition's rows before they are shuffled
    first = flat.where("has").withColumn("__r", F.row_number().over(Window.partitionBy(group, "field").orderBy(key))).where(F.col("__r") <= examples)
    lists = first.groupBy(group, "field").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    out = counts.where(F.col("count") > 0).join(lists, [group, "field"])
    return out.select(group, "field", "count", F.round(F.col("count") / F.col("__rows"), 4).alias("coverage"), "examples")


#: Fields that a search can tell.
SEARCHABLE = ("doi", "isbn", "journal", "publisher", "year")


def _diagnostic(id_: Column, pass_: str, severity: Column | str, status: Column, action: Column, location: Column) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [F.col("path"), id_.alias("id"), F.lit(pass_).alias("pass"), severity.alias("severity"), status.alias("status"), action.alias("action"), location.alias("location")]


def header_diagnostics(found: DataFrame) -> DataFrame:
    """(path, id, pass, severity, status, action, location) of header violations (path, field, code).

    A field that is missing and can be searched for needs evidence, all else a person. Violations of the whole
    header have no location.
    """
    whole = F.col("code").isin("no_frontmatter", "deprecated_type", "unknown_type")
    field = F.when(~whole, F.regexp_extract("field", "^([^.]*)", 1))
    searched = (F.col("code") == "missing") & F.coalesce(field.isin(*SEARCHABLE), F.lit(False))
    status = F.when(searched, "needs_external_evidence").otherwise("human_review")
    action = F.when(searched, "run_quasi_search").otherwise("human_review")
    return found.select(_diagnostic(F.concat(F.lit("frontmatter."), F.coalesce(field, F.lit("document")), F.lit("."), "code"), "frontmatter_schema", "error", status, action, field))


def body_diagnostics(found: DataFrame) -> DataFrame:
    """(path, id, pass, severity, status, action, location) of body violations (path, fault, h2, expected, detected)."""
    fault = F.col("fault")
    reshape = (fault == "block_kind_mismatch") & F.col("h2").eqNullSafe(F.lit("关键概念")) & (F.col("expected") == "table") & F.col("detected").isin("definition-list", "paragraph")
    level = fault.isin("heading_level_drift", "global_heading_level_drift", "h2_alias")
    missing = fault == "missing_required_h2"
    status = F.when(reshape | missing | level, "agent_fixable").otherwise("human_review")
    action = F.when(reshape, "rewrite_section_shape_preserving_content").when(missing, "insert_required_stub").when(level, "normalize_heading_level").otherwise("human_review")
    severity = F.when(reshape | missing, "error").otherwise("warning")
    # an alias and a fault of the whole body have no section of their own
    h2 = F.when(~fault.isin("h2_alias", "global_heading_level_drift"), F.col("h2"))
    return found.select(_diagnostic(F.concat(F.lit("body."), F.coalesce(h2, F.lit("document")), F.lit("."), fault), "body_schema", severity, status, action, h2))


def merged_diagnostics(*found: DataFrame) -> DataFrame:
    """All diagnostics of several passes, with the number of the pass they came in as `nth`."""
    out = [d.withColumn("nth", F.lit(i)) for i, d in enumerate(found)]
    total = out[0]
    for d in out[1:]:
        total = total.unionByName(d, allowMissingColumns=True)
    return total


def summary(diagnostics: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of diagnostics, of all or by a column: all, files, by status, and dirty unless all were fixed."""
    is_ = lambda v: F.count_if(F.col("status") == v)
    counts = [F.count("*").alias("n"), F.countDistinct("path").alias("files"), *[is_(v).alias(v) for v in ("auto_fixed", "agent_fixable", "needs_external_evidence", "human_review")]]
    out = (diagnostics.groupBy(by) if by else diagnostics.groupBy()).agg(*counts)
    return out.withColumn("overall", F.when(F.col("n") == F.col("auto_fixed"), "clean").otherwise("dirty"))


def disagreements(existing: DataFrame, built: DataFrame) -> DataFrame:
    """(n): entries (k, v) that another map (k, v) has with another value; key 0 doesn't count, nor keys that the other lacks."""
    b = built.select(F.col("k").alias("__k"), F.col("v").alias("__v"))
    return existing.where("k <> 0").join(b, F.col("k") == F.col("__k")).where("v <> __v").agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, value, n, share, rank): the k most frequent values of each group, by value on ties."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), value))
    return counts.withColumns({"share": F.round(F.col("n") / total, 4), "rank": rank}).where(F.col("rank") <= k)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of `child` whose key no row of `parent` has; a null key is an orphan."""
    return child.join(parent.select(F.col(parent_key).alias("__parent")), child[key] == F.col("__parent"), "left_anti")


def all_or_nothing(rows: DataFrame, key: str, good: Column) -> DataFrame:
    """The rows of keys of which every row is good."""
    ok = F.bool_and(F.coalesce(good, F.lit(False))).over(Window.partitionBy(key))
    return rows.withColumn("__ok", ok).where("__ok").drop("__ok")


def chapter_inventory(chapters: DataFrame, book: str = "book") -> DataFrame:
    """(book, chapters, valid): whether slots, file names and slugs are all there and unique, and page pairs make sense."""
    pages = (F.col("start").isNull() & F.col("end").isNull()) | ((F.col("start") >= 1) & (F.col("start") <= F.col("end")))
    # a book's values are few; counting distinct ones by Spark's means would send each row once a column
    unique = lambda c: F.count(c) == F.size(F.collect_set(c))
    full = [F.count(c) == F.count("*") for c in ("slot", "filename", "slug")]
    ok = F.bool_and(F.coalesce(pages, F.lit(False))) & unique("slot") & unique("filename") & unique("slug") & full[0] & full[1] & full[2]
    return chapters.repartition(book).groupBy(book).agg(F.count("*").alias("chapters"), ok.alias("valid"))
