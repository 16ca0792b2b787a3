"""All facts of one text: what the scan stage computes for each file or row."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

from ..options import NO_SCHEMA, NO_TABLE, ScanOptions
from .lex import LITERALS, Token, chunks, comment_text, lex, quality
from .parse import Node, Predicate, read, window_literal
from .scope import Scopes, has_set_operator, name_of

_NAME = re.compile("""['"]([가-힣]{2,4})['"]""")
#: Python calls inside one another at most.
FRAMES = 20_000
_JOINTYPE = {"JOIN": "INNER", "INNER": "INNER", "COMMA": "INNER"}


def snippet(lines: list[str], line: int) -> str:
    s = lines[line - 1].strip() if 0 < line <= len(lines) else ""
    return s if len(s) <= 160 else s[:160] + "..."


def _blank(value: str) -> bool:
    return value[:1] in "'\"" and len(value) >= 2 and not value[1:-1].strip()


class _Statement:
    def __init__(self, tokens: list[Token], text: str, options: ScanOptions):
        self.text, self.options = text, options
        self.t = [x for x in tokens if not x.hidden]
        self.scopes = Scopes(self.t)
        self.parsed = read(self.t, self.scopes, options.max_chunk_iterations)

    def source(self, node: Node) -> str:
        return self.text[self.t[node.lo].start : self.t[node.hi - 1].stop + 1]

    def at(self, node: Node) -> int:
        return self.t[node.lo].start

    def kept(self, lo: int) -> bool:
        """Not inside a select list that counts as unread."""
        if not self.parsed.fragments:
            return True
        return not (self.options.compat_fragments and any(a <= lo < b for a, b in self.parsed.fragments))

    def column(self, node: Node, with_cte: bool = True) -> tuple[str, str]:
        return self.scopes.resolve(self.at(node), node.qualifier, with_cte)

    def signature(self, node: Node, deep: bool = True) -> str | None:
        """TABLE.COLUMN, COLUMN, or FN(columns); nothing for literals and expressions."""
        if node.kind == "column":
            table = self.column(node)[1]
            return node.name if table == NO_TABLE else f"{table}.{node.name}"
        if node.kind == "call" and deep:
            inner = [self.signature(a, False) for a in node.args]
            return f"{node.name}({', '.join(x for x in inner if x)})"
        return None

    def findings(self, columns: frozenset[str]) -> list[tuple[str, str, int, int, int]]:
        """(column, operator, line, start, stop) of literals that sensitive columns meet."""
        out, done = [], set()

        def hit(column: Node, op: str, literal: Node, line: int) -> None:
            for n in literal.args if literal.kind == "list" else [literal]:
                if n.kind == "literal":
                    lo, hi = n.lo, n.hi
                    while self.t[lo].type == "(":
                        lo, hi = lo + 1, hi - 1
                    out.append((column.name, op, line, self.t[lo].start, self.t[hi - 1].stop))
            done.update(range(column.lo, column.hi))

        sensitive = lambda n: n.kind == "column" and n.name in columns
        for p in self.parsed.predicates:
            left = p.subject
            line = self.t[left.lo].line
            if sensitive(left):
                done.update(range(left.lo, left.hi))
                if p.op not in ("IS NULL", "IS NOT NULL"):
                    for r in p.rest[:1] if p.op.endswith("LIKE") else p.rest:
                        hit(left, p.op, r, line)
            elif p.rest and sensitive(p.rest[0]):
                done.update(range(p.rest[0].lo, p.rest[0].hi))
                if left.kind == "literal" and not p.op[0].isalpha():
                    hit(p.rest[0], p.op, left, line)
        for left, right in self.parsed.assignments:
            if sensitive(left):
                hit(left, "=", right, self.t[left.lo].line)
        if self.options.detect_insert_values:
            for name, node in self.parsed.inserts:
                if name in columns:
                    out.append((name, "=", self.t[node.lo].line, self.at(node), self.t[node.hi - 1].stop))
        i = 0
        while i < len(self.t):
            x = self.t[i]
            if i not in done and name_of(x) in columns and x.type not in LITERALS:
                found = window_literal(self.t, i)
                if found:
                    op, k = found
                    out.append((name_of(x), op, x.line, self.t[k].start, self.t[k].stop))
                    i = k
            i += 1
        return out

    def edges(self) -> list[dict]:
        """Structural joins, then joins that a WHERE implies between pairs that have none."""
        out, pairs = [], set()
        for c in self.scopes.connectors():
            if c.join_type != "COMMA" and not c.left.is_cte and not c.right.is_cte:
                a, b = (c.left.schema, c.left.table), (c.right.schema, c.right.table)
                pairs.add(frozenset((a, b)))
                out.append({"line": c.left.line, "table_a_schema": a[0], "table_a": a[1], "table_b_schema": b[0], "table_b": b[1], "join_type": c.join_type, "predicate": c.predicate})
        for p in self.parsed.predicates:
            if self.compares(p) and self.kept(p.lo):
                a, b = self.column(p.subject, False), self.column(p.rest[0], False)
                if a != b and NO_TABLE not in (a[1], b[1]) and frozenset((a, b)) not in pairs:
                    line = self.t[p.subject.lo].line
                    text = f"{a[1]}.{p.subject.name} {p.op} {b[1]}.{p.rest[0].name}".upper()
                    out.append({"line": line, "table_a_schema": a[0], "table_a": a[1], "table_b_schema": b[0], "table_b": b[1], "join_type": "WHERE-IMPLICIT", "predicate": text})
        return out

    @staticmethod
    def compares(p: Predicate) -> bool:
        """A comparison of two qualified columns."""
        return not p.op[0].isalpha() and all(n.kind == "column" and n.qualifier for n in (p.subject, *p.rest))

    def calls(self) -> list[dict]:
        out = []
        for n in self.parsed.calls:
            if self.kept(n.lo):
                k = n.lo
                while self.t[k].type != "(":
                    k += 1
                depth, end = 0, k
                while end < n.hi:
                    depth += (self.t[end].type == "(") - (self.t[end].type == ")")
                    if depth == 0:
                        break
                    end += 1
                inner = self.text[self.t[k + 1].start : self.t[end - 1].stop + 1] if end > k + 1 else ""
                out.append((self.at(n), {"function": n.name, "parameters": inner, "line": self.t[n.lo].line}))
        for p in self.parsed.predicates:
            if self.kept(p.lo):
                params = ", ".join(self.source(n) for n in (p.subject, *p.rest))
                name = p.op.replace("IS NOT NULL", "IS NULL") if p.op.startswith("IS") else p.op
                out.append((self.at(p.subject) - 0.5, {"function": name if not p.op.startswith("IS") else p.op, "parameters": params, "line": self.t[p.lo].line}))
        return [r for _, r in sorted(out, key=lambda x: x[0])]

    def columns(self) -> list[dict]:
        out = []
        for n in self.parsed.columns:
            if self.kept(n.lo):
                schema, table = self.column(n, False)
                out.append({"schema": schema, "table": table, "column": n.name, "line": self.t[n.lo].line})
        return out

    def facts(self) -> list[str]:
        out = {f"TBL|{t.schema}|{t.table}" for t in self.scopes.tables()}
        kinds: dict[str, int] = {}
        for c in self.scopes.connectors():
            kind = _JOINTYPE.get(c.join_type, c.join_type)
            kinds[kind] = kinds.get(kind, 0) + 1
        out |= {f"JOINTYPE|{k}={n}" for k, n in kinds.items()}
        for p in self.parsed.predicates:
            if p.having or not self.kept(p.lo):
                continue
            if self.compares(p):
                a, b = self.column(p.subject), self.column(p.rest[0])
                if NO_TABLE not in (a[1], b[1]):
                    if a[1] != b[1]:
                        x, y = sorted((f"{a[1]}.{p.subject.name}", f"{b[1]}.{p.rest[0].name}"))
                        out.add(f"REL|{p.op}|{x}|{y}")
                    continue
            for n in (p.subject, *p.rest) if not p.op[0].isalpha() else (p.subject,):
                s = self.signature(n)
                if s:
                    out.add(f"PRED|{s}|{p.op}")
        if not (self.options.compat_fragments and self.parsed.fragments):
            for n in self.parsed.groups:
                s = self.signature(n)
                if s:
                    out.add(f"GROUPBY|{s}")
        out.add(f"SHAPE|BLOCKS={len(self.scopes.blocks)}")
        return sorted(out)

    def identity(self) -> dict:
        facts = self.facts()
        edges = sorted({c.join_type for c in self.scopes.connectors()})
        return {
            "line": self.t[0].line,
            "has_cte": bool(self.scopes.ctes),
            "has_subquery": self.parsed.has_subquery,
            "has_union": has_set_operator(self.t),
            "facts": facts,
            "columns": sorted({self.signature(n) for n in self.parsed.columns if self.kept(n.lo)} - {None}),
            "tables": sorted({f"{t.schema}.{t.table}" for t in self.scopes.tables()}),
            "join_types": edges,
        }


def _select_block(t: list[Token], scopes: Scopes) -> bool:
    """Whether the statement is a SELECT, or WITH ... SELECT."""
    if not t:
        return False
    if t[0].type == "SELECT":
        return True
    if t[0].type != "WITH":
        return False
    depth = 0
    for x in t:
        depth += (x.type == "(") - (x.type == ")")
        if depth == 0 and x.type in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"):
            return x.type == "SELECT"
    return False


def _comment_findings(tokens: list[Token], options: ScanOptions, columns: frozenset[str]) -> list[tuple]:
    """Findings in comments, and in comments inside them, with lines and offsets of the whole text."""
    out, todo = [], [(tokens, 0, 0)]
    while todo:
        own, line, at = todo.pop()
        for c in own:
            if c.type not in ("LINE_COMMENT", "SQL_COMMENT"):
                continue
            inner, down, by = comment_text(c), line + c.line - 1, at + c.start + 2
            deeper, _ = lex(inner)
            for part in chunks(deeper):
                if any(not x.hidden for x in part):
                    s = _Statement(part, inner, options)
                    out += [(n, op, row + down, a + by, b + by) for n, op, row, a, b in s.findings(columns)]
            todo.append((deeper, down, by))
    return out


def scan_text(text: str, options: ScanOptions) -> dict:
    """Rows of every relation for one text; bad is set, and the rest empty, if it is no usable SQL."""
    empty = {"bad": None, "findings": [], "names": [], "tables": [], "columns": [], "functions": [], "edges": [], "identities": [], "blocks": [], "n_chunks": 0, "n_tokens": 0, "n_partial": 0}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))  # subqueries inside one another
    try:
        tokens, errors = lex(text)
        bad = quality(tokens, errors)
        if bad:
            return empty | {"bad": {"category": bad[0], "item": bad[1], "message": bad[2]}, "n_chunks": len(chunks(tokens)), "n_tokens": len(tokens)}
        return empty | _scan(text, tokens, options)
    except Exception as e:  # noqa: BLE001  one text must not stop the rest
        return empty | {"bad": {"category": "crash", "item": type(e).__name__, "message": f"crashed while scanning: {type(e).__name__}: {e}"}}


def _scan(text: str, tokens: list[Token], options: ScanOptions) -> dict:
    out = {"tables": [], "columns": [], "functions": [], "edges": [], "identities": [], "blocks": []}
    columns = frozenset(c.upper() for c in options.sensitive_columns)
    hits, parts, partial = [], chunks(tokens), 0
    for n, part in enumerate(parts):
        if not any(not x.hidden for x in part):
            continue
        s = _Statement(part, text, options)
        hits += s.findings(columns)
        partial += s.parsed.partial
        if options.extract_table_refs:
            out["tables"] += [{"schema": t.schema, "table": t.table, "line": t.line} for t in s.scopes.tables()]
        if options.extract_column_refs:
            out["columns"] += s.columns()
        if options.extract_functions:
            out["functions"] += s.calls()
        if options.extract_relations:
            out["edges"] += s.edges()
        if options.extract_query_identity:
            row = s.identity()
            if len(row["facts"]) > 1:
                out["identities"].append(row | {"chunk": n})
        if _select_block(s.t, s.scopes):
            out["blocks"].append(text[part[0].start : part[-1].stop + 1].lstrip("\r\n \t"))
    spans = [(t.start, t.stop) for t in tokens if t.type in ("LINE_COMMENT", "SQL_COMMENT")]
    starts = [a for a, _ in spans]
    hits += _comment_findings(tokens, options, columns)
    lines = text.splitlines()

    def in_comment(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at <= spans[k][1]

    rows, seen = [], set()
    for name, op, line, a, b in hits:
        value = text[a : b + 1]
        if not _blank(value):
            seen.add((a, b))
            rows.append((line, name.upper(), op.strip().upper(), value, in_comment(a), a, b))
    names = []
    for m in _NAME.finditer(text):
        if (m.start(), m.end() - 1) not in seen:
            line = text.count("\n", 0, m.start()) + 1
            if m[1] in options.known_names:
                rows.append((line, "-", "-", f"'{m[1]}'", in_comment(m.start()), m.start(), m.end() - 1))
            elif m[1] not in options.stopwords:
                names.append(m[1])
    rows.sort(key=lambda r: (r[0], r[5]))
    out["findings"] = [{"severity": "FINDING", "line": r[0], "column_name": r[1], "operator": r[2], "value": r[3], "snippet": snippet(lines, r[0]), "in_comment": "Y" if r[4] else "N", "start_offset": r[5], "end_offset": r[6]} for r in rows]
    return out | {"names": names, "n_chunks": len(parts), "n_tokens": len(tokens), "n_partial": partial}
