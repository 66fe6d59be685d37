"""Data-change verification as Spark jobs: DataFrames in, DataFrames of evidence out."""

from dataproof.operators.artifacts import (
    alter_classes,
    classify,
    match_globs,
    query_advisories,
    query_shape_flags,
)
from dataproof.operators.changes import (
    blast_radius,
    cast_probe,
    change_class,
    column_expr_probe,
    correctness_status,
    dry_run_change,
    full_rewrite_bound,
    modify_column_probe,
    no_rewrite,
    predicate_match,
    safe_expression,
    update_expr_probe,
)
from dataproof.operators.profile import (
    catalog_spec,
    column_profile,
    largest_partitions,
    partition_stats,
    parts_summary,
    table_profile,
)
from dataproof.operators.pruning import (
    Range,
    full_scan,
    layout_hint,
    missing_key_pruning,
    missing_partition_pruning,
    no_scan_evidence,
    part_stats,
    scan_findings,
    ScanFilter,
    scan_ratio,
    scan_ratios,
)
from dataproof.operators.planreads import reads_of
from dataproof.operators.readpath import proof_rows, read_path_check, uniqueness_audit
from dataproof.operators.rowdiff import (
    compare,
    compare_shape,
    diff_counts,
    diff_sample,
    renamed_columns,
    verify_equivalent,
)
from dataproof.operators.slices import choose_partition, slice_budget, slice_proof
from dataproof.operators.stability import stability_gate
from dataproof.operators.uniqueness import (
    dedup_eligibility,
    dup_cross_partition,
    dup_global,
    dup_sample,
    dup_within_partition,
    duplicate_proof,
    latest_per_key,
    scan_guard,
    scope_partition,
)
from dataproof.operators.workload import (
    discover_workload,
    flag_versioned_tables,
    log_filter,
    rank_workload,
    user_table_filter,
    with_shape,
    workload_summary,
)
from dataproof.plans.findings import (
    aggregate_verdict,
    dedup_finding,
    diagnosis_finding,
    equivalence_finding,
    exit_code,
    gate_status,
    migration_finding,
    read_path_finding,
    report_rows,
    to_runs,
)
from dataproof.plans.suite import (
    Check,
    change_check,
    dedup_check,
    equivalence_check,
    read_path_checks,
    scan_checks,
    text_checks,
    verify_sql_pair,
    verify_suite,
)
from dataproof.sources.runlog import append_run_log, read_run_log
from dataproof.sources.slices import extract_slice, slice_catalog, write_manifest
from dataproof.spec import ChangeSpec, TableSpec

__all__ = [name for name in dir() if not name.startswith("_")]
