"""Applying a declared state to a table on plain files: stage, validate, publish by manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespec.operators.constraints import check_rules, domain_rules, enum_rules, fk_report, not_null_rules, reconcile, row_rules, union_all, unique_report
from tablespec.operators.diffs import table_diff
from tablespec.operators.project import conform
from tablespec.plans.jobs import blocked, plan_table
from tablespec.sources.scan import publish_folder, snapshot_load, snapshot_save, snapshot_versions, write_partitioned
from tablespec.spec import TableSpec


class NotApplied(Exception):
    """A gate or a constraint stopped the apply; the version before stays the readable one."""


def apply_table(df: DataFrame, spec: TableSpec, root: str, plan: DataFrame | None = None, allow_destructive: bool = False, allow_manual: bool = False, parents: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """Conforms rows to a spec and publishes them as the next version under root.

    Every declared rule is checked on the conformed rows, foreign keys against ``parents`` by table
    name (the table itself is its own parent as conformed); a parent that is not given is an error.
    A plan with changes that the gates do not allow, or rows that break a rule, stop it before the
    manifest is written. If nothing differs from the published version, nothing is written."""
    spark = df.sparkSession
    if plan is not None and not (stopped := blocked(plan, allow_destructive, allow_manual)).isEmpty():
        raise NotApplied(f"the plan holds changes that are not allowed: {[r.op for r in stopped.limit(5).collect()]}")
    staged = conform(df, spec)
    rules = not_null_rules(spec) + check_rules(spec.checks) + domain_rules(spec.domains) + enum_rules(staged, spec.enums)
    reports = ([row_rules(staged, spec.name, rules)] if rules else []) + [unique_report(staged, spec.name, u) for u in spec.uniques]
    known = {spec.name: staged, **parents}
    if absent := sorted({f.parent for f in spec.foreign_keys} - set(known)):
        raise ValueError(f"the foreign keys of {spec.name} need {', '.join(absent)} among the parents")
    reports += [fk_report(staged, known[f.parent], spec.name, f) for f in spec.foreign_keys]
    if reports:
        broken = union_all(reports).where("violations > 0")
        if not broken.isEmpty():
            raise NotApplied(f"staged rows break {sorted(r.constraint_name for r in broken.limit(20).collect())}")
    last = snapshot_versions(spark, root, spec.name).agg(F.max("version")).first()[0]
    key = next((list(u.columns) for u in spec.uniques if u.primary), None)
    if last is not None:
        now = snapshot_load(spark, root, spec.name, staged.schema)
        same = table_diff(staged, now, key).isEmpty() if key else staged.exceptAll(now).isEmpty() and now.exceptAll(staged).isEmpty()
        if same:
            return now
    snapshot_save(staged, root, spec.name, (last or 0) + 1)
    return snapshot_load(spark, root, spec.name, staged.schema)


def migrate_table(df: DataFrame, old: TableSpec, new: TableSpec, root: str, parents: dict[str, DataFrame] = {}, allow_destructive: bool = False, allow_manual: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(the rows as the new spec has them, published; the plan that led there)."""
    plan = plan_table(df, old, new, parents)
    return apply_table(df, new, root, plan, allow_destructive, allow_manual, parents), plan


def rebuild_partitions(df: DataFrame, spec: TableSpec, root: str) -> tuple[DataFrame, DataFrame]:
    """(the rows under the spec's partition tree, the reconciliation with the rows before).

    Rows are routed and written to a new folder, compared with the source, and only then published
    as the next version under root; a row without a partition or a difference stops it before that."""
    last = snapshot_versions(df.sparkSession, root, spec.name).agg(F.max("version")).first()[0]
    folder = f"{spec.name}/v{(last or 0) + 1}-{uuid.uuid4().hex}"
    rebuilt = write_partitioned(df, spec, f"{root}/{folder}")
    report = reconcile(df, rebuilt.select(*df.columns))
    found = report.first()
    if not found["same"]:
        raise NotApplied(f"rebuilt rows differ: {found.asDict()}")
    publish_folder(df.sparkSession, root, spec.name, (last or 0) + 1, folder, found["new_rows"])
    return rebuilt, report
