"""Constraints as queries: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StructType

from galleria.functions.vectors import faults

#: Keys of a vector's payload, exactly.
PAYLOAD = ("sampleId", "photoId", "personId", "active", "modelVersion")
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Parts of column names that would be personal data.
PERSONAL = ("first_name", "last_name", "display_name", "national_id", "full_name", "email", "phone")
#: Allowed states by table.
STATES = {
    "photo": ("staged", "active", "failed", "deleted"),
    "request": ("pending", "completed", "failed"),
    "result": ("known", "unknown"),
    "process": ("pending", "queued", "running", "completed", "completed_with_warnings", "failed", "cancel_requested", "cancelled"),
}


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, and in how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def out_of_step(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, and which."""
    x, y = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return x.join(y, key, "full_outer").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("r").isNull(), "left only").otherwise("right only").alias("side"))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that gives null isn't broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()], F.lit(None).cast("string")))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break."""
    return rows.withColumn("broken", broken_rules(rules)).where(F.size("broken") > 0)


def observed(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """All rows with the names of the rules they break, and their counts: rows, broken and one for each rule.

    The counts are taken while the rows are written, by the same scan; reading them waits for the first action.
    """
    marked, counts = rows.withColumn("broken", broken_rules(rules)), Observation()
    each = [F.count_if(F.array_contains("broken", name)).alias(name) for name in rules]
    return marked.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") > 0).alias("broken"), *each), counts


def payload_faults(payload: Column, point_id: Column, vector: Column, dim: int) -> Column:
    """Why a vector point can't be stored. payload: map of texts."""
    keys = F.map_keys(payload)
    allowed = F.array(*map(F.lit, PAYLOAD))
    ids = [F.when(~F.coalesce(payload[k], F.lit("")).rlike(UUID), F.lit(f"{k} is no UUID")) for k in PAYLOAD[:3]]
    reasons = [
        F.when(F.size(F.array_except(keys, allowed)) > 0, F.lit("other key")),
        F.when(F.size(F.array_except(allowed, keys)) > 0, F.lit("missing key")),
        F.when(~point_id.eqNullSafe(payload["sampleId"]), F.lit("id differs")),
        *ids,
        F.when(~F.coalesce(payload["active"], F.lit("")).isin("true", "false"), F.lit("active is no boolean")),
        F.when(F.coalesce(F.trim(payload["modelVersion"]), F.lit("")) == "", F.lit("no model version")),
    ]
    return F.concat(F.array_compact(F.array(*reasons)), faults(vector, dim))


#: All that payload_faults can find.
POINT_FAULTS = ("other key", "missing key", "id differs", *(f"{k} is no UUID" for k in PAYLOAD[:3]), "active is no boolean", "no model version", "null", "dimension", "not finite", "zero")


def point_rules(dim: int, payload: str = "payload", point_id: str = "point_id", vector: str = "embedding") -> dict[str, Column]:
    """The rules of a vector point, for tables of points that are checked as they are written."""
    found = payload_faults(F.col(payload), F.col(point_id), F.col(vector), dim)
    return {name: ~F.array_contains(found, name) for name in POINT_FAULTS}


def personal_columns(schema: StructType) -> list[str]:
    """Columns, nested ones too, whose names say that they hold personal data."""
    found = []
    for field in schema.fields:
        if any(p in field.name.lower() for p in PERSONAL):
            found.append(field.name)
        kind = field.dataType
        kind = getattr(kind, "elementType", kind)
        if isinstance(kind, StructType):
            found += [f"{field.name}.{x}" for x in personal_columns(kind)]
    return found


def schema_differences(have: StructType, want: StructType) -> list[str]:
    """Columns that are missing, too many or of another type."""
    x, y = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (have, want))
    return sorted([f"missing {c}" for c in y if c not in x] + [f"unknown {c}" for c in x if c not in y] + [f"{c} is {x[c]}, not {y[c]}" for c in x if c in y and x[c] != y[c]])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_tables(spark, names: list[str]) -> list[str]:
    """Required tables that the catalog doesn't have."""
    return [n for n in names if not spark.catalog.tableExists(n)]
