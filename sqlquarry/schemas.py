"""Schemas of the relations."""

FINDING = "severity string, line int, column_name string, operator string, value string, snippet string, in_comment string, start_offset int, end_offset int"
TABLE_USE = "schema string, table string, line int"
COLUMN_USE = "schema string, table string, column string, line int"
FUNCTION_CALL = "function string, parameters string, line int"
EDGE = "line int, table_a_schema string, table_a string, table_b_schema string, table_b string, join_type string, predicate string"
IDENTITY = "line int, has_cte boolean, has_subquery boolean, has_union boolean, facts array<string>, columns array<string>, tables array<string>, join_types array<string>, chunk int"
BAD = "category string, item string, message string"


def _nested(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in ddl.split(", ")))


SCANNED = (
    f"bad struct<{_nested(BAD)}>, findings array<struct<{_nested(FINDING)}>>, names array<string>, tables array<struct<{_nested(TABLE_USE)}>>, "
    f"columns array<struct<{_nested(COLUMN_USE)}>>, functions array<struct<{_nested(FUNCTION_CALL)}>>, edges array<struct<{_nested(EDGE)}>>, "
    f"identities array<struct<{_nested(IDENTITY)}>>, blocks array<string>, n_chunks int, n_tokens int, n_partial int"
)
TOKENS = "tokens array<struct<type: string, text: string, hidden: boolean, line: int, start: int, stop: int>>, errors array<struct<line: int, start: int, text: string>>"
BAD_FILES = "path string, category string, item string, message string, quarantined_file string"
SPLIT_MANIFEST = "original_file string, split_file string, block_number string, total_blocks string"
