"""Options of a scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

GRANULARITIES = ("table", "structure", "filtered", "strict")
NO_SCHEMA, NO_TABLE = "(no-schema)", "(no-table)"


@dataclass(frozen=True)
class ScanOptions:
    """What to look for, and how. ScanOptions.metadata() turns all references on."""

    sensitive_columns: tuple[str, ...] = ("ACCT_ID", "CTRT_NO", "ACCT_NM", "ACCT_NAME")
    stopwords: frozenset[str] = frozenset()
    known_names: frozenset[str] = frozenset()
    extensions: tuple[str, ...] = ("sql", "txt")
    extract_table_refs: bool = False
    extract_column_refs: bool = False
    extract_relations: bool = False
    extract_functions: bool = False
    extract_query_identity: bool = False
    identity_granularity: str = "structure"
    query_similarity: bool = False
    split_selects: bool = False
    max_chunk_iterations: int = 200_000
    detect_insert_values: bool = False
    #: Statements with CASE in a select list yield no references from that list and no GROUP BY facts.
    compat_fragments: bool = True

    def __post_init__(self) -> None:
        if self.identity_granularity not in GRANULARITIES:
            raise ValueError(f"identity_granularity is one of {', '.join(GRANULARITIES)}")
        if self.query_similarity and not self.extract_query_identity:
            raise ValueError("query_similarity needs extract_query_identity")

    @classmethod
    def metadata(cls, **overrides) -> ScanOptions:
        on = dict.fromkeys(("extract_table_refs", "extract_column_refs", "extract_relations", "extract_functions", "extract_query_identity"), True)
        return cls(**(on | overrides))

    def with_(self, **overrides) -> ScanOptions:
        return replace(self, **overrides)

    @property
    def suffixes(self) -> tuple[str, ...]:
        return tuple("." + e.lower().lstrip(".") for e in self.extensions)
