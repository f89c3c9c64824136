"""Error texts to support codes, action severities and legacy action names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern, code, message and action, tried in this order.
ERROR_PATTERNS = (
    ("duplicate key", "DB001", "A record with this ID already exists", "Download failed rows to review duplicates"),
    ("unique constraint", "DB002", "This value must be unique but already exists", "Check for duplicate entries in your CSV"),
    ("violates unique", "DB002", "A duplicate value was found", "Review your data for duplicate key values"),
    ("foreign key constraint", "DB003", "Referenced record does not exist", "Ensure parent records are uploaded first"),
    ("violates foreign key", "DB003", "Referenced record does not exist", "Ensure parent records are uploaded first"),
    ("connection refused", "DB004", "Unable to connect to database", "Please try again in a few moments"),
    ("connection reset", "DB005", "Database connection was interrupted", "Please try again"),
    ("timeout", "DB006", "Operation timed out", "Try uploading a smaller file or try again later"),
    ("deadlock", "DB007", "Database was busy with conflicting operations", "Please try again"),
    ("invalid date", "VAL001", "Invalid date format detected", "Use YYYY-MM-DD, MM/DD/YYYY, or Jan 15, 2024"),
    ("invalid number", "VAL002", "Invalid number format detected", "Remove currency symbols and use standard decimal format"),
    ("required field", "VAL003", "Required field is empty", "Ensure all required columns have values"),
    ("missing required column", "VAL004", "Required column is missing from CSV", "Check that all required columns are present in your file"),
    ("column not found", "VAL005", "Expected column not found in CSV", "Verify column headers match the template exactly"),
    ("invalid enum", "VAL006", "Value is not in the allowed list", "Check the allowed values for this field"),
    ("file too large", "FILE001", "File exceeds maximum size limit (100MB)", "Split the file into smaller chunks"),
    ("invalid csv", "FILE002", "File is not a valid CSV", "Ensure file is comma-separated with consistent columns"),
    ("encoding error", "FILE003", "File contains invalid characters", "Save file as UTF-8 encoding"),
    ("no file provided", "FILE004", "No file was selected", "Please select a CSV file to upload"),
    ("empty file", "FILE005", "The uploaded file is empty", "Please upload a CSV file with data rows"),
    ("upload cancelled", "UPL001", "Upload was cancelled", "Start a new upload when ready"),
    ("too many uploads", "UPL002", "System is busy processing other uploads", "Please wait a moment and try again"),
    ("upload not found", "UPL003", "Upload session not found", "The upload may have expired. Please start a new upload"),
    ("context canceled", "UPL004", "Request was cancelled", "Please try again"),
    ("context deadline exceeded", "UPL005", "Request timed out", "Try uploading a smaller file or check your connection"),
    ("table not found", "TBL001", "Table not found", "Verify the table name is correct"),
    ("unknown table", "TBL002", "Unknown table type", "This table type is not configured"),
    ("rate limit", "RATE001", "Too many requests", "Please wait a moment before trying again"),
)
# Fixed value: used when nothing matches.
UNKNOWN_ERROR = ("ERR000", "An unexpected error occurred", "Please try again or contact support")

# Actions by severity; any other action is medium.
SEVERITIES = {
    "high": ("upload", "upload_rollback", "bulk_edit", "row_delete"),
    "critical": ("table_reset",),
    "low": ("template_create", "template_update", "template_delete"),
}
ACTIONS = (
    "upload", "upload_rollback", "cell_edit", "bulk_edit", "row_delete", "row_restore", "table_reset",
    "template_create", "template_update", "template_delete",
)
SEVERITY_LEVELS = ("low", "medium", "high", "critical")
UPLOAD_STATUSES = ("active", "rolled_back")

# Legacy history action, audit action, severity.
LEGACY_ACTIONS = (("edit", "cell_edit", "medium"), ("delete", "row_delete", "high"), ("restore", "row_restore", "medium"))


def _first_match(reason: Column, part: int) -> Column:
    low = F.lower(reason)
    picked = F.when(reason.isNull(), F.lit(None).cast("string"))
    for entry in ERROR_PATTERNS:
        picked = picked.when(low.contains(entry[0]), entry[part + 1])
    return picked.otherwise(UNKNOWN_ERROR[part])


def error_code(reason: Column) -> Column:
    return _first_match(reason, 0)


def error_message(reason: Column) -> Column:
    return _first_match(reason, 1)


def error_action(reason: Column) -> Column:
    return _first_match(reason, 2)


def error_text(reason: Column) -> Column:
    """``Message (Code: XXX). Action``; empty for no error."""
    text = F.format_string("%s (Code: %s). %s", error_message(reason), error_code(reason), error_action(reason))
    return F.when(reason.isNull(), "").otherwise(text)


def is_known_error(reason: Column) -> Column:
    return F.coalesce(error_code(reason) != UNKNOWN_ERROR[0], F.lit(False))


def severity(action: Column) -> Column:
    level = F.lit("medium")
    for name, actions in SEVERITIES.items():
        level = F.when(action.isin(*actions), name).otherwise(level)
    return level


def _legacy(action: Column, part: int) -> Column:
    picked = F.when(F.lit(False), F.lit(None).cast("string"))
    for entry in LEGACY_ACTIONS:
        picked = picked.when(action == entry[0], entry[part])
    return picked


def legacy_action(action: Column) -> Column:
    return _legacy(action, 1)


def normalized_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[_\s]+", "")
