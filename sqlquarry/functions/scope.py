"""Scopes, tables and joins of a statement, from its tokens alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..options import NO_SCHEMA, NO_TABLE
from .lex import LITERALS, Token

JOIN_WORDS = ("INNER", "LEFT", "RIGHT", "FULL", "CROSS")
_STOP = frozenset(("WHERE", "GROUP", "ORDER", "HAVING", "UNION", "INTERSECT", "EXCEPT", "SELECT", "FETCH", ";", ","))


@dataclass
class Table:
    schema: str
    table: str
    alias: str | None
    line: int
    is_cte: bool


@dataclass
class Connector:
    left: Table
    right: Table
    join_type: str
    predicate: str


@dataclass
class Scope:
    start: int
    stop: int = -1
    tables: list[Table] = field(default_factory=list)
    connectors: list[Connector] = field(default_factory=list)
    aliases: dict[str, Table] = field(default_factory=dict)

    def add(self, t: Table) -> None:
        if t.alias:
            self.aliases[t.alias] = t
        self.aliases.setdefault(t.table, t)
        self.tables.append(t)


def name_of(t: Token) -> str:
    return (t.text[1:-1] if t.type == "DOUBLE_QUOTE_ID" else t.text).upper()


def is_word(t: Token) -> bool:
    return t.text[:1].isalpha() or t.text[:1] == "_" or t.type == "DOUBLE_QUOTE_ID"


def starts_name(t: Token) -> bool:
    """Any word, keywords too, but those that end a table list."""
    return is_word(t) and t.type not in LITERALS and t.type not in ("WHERE", "ON", "USING", "AS", "JOIN", "SELECT", "LATERAL", "SET", "VALUES", *JOIN_WORDS)


def matching(t: list[Token], i: int) -> int:
    """Index behind the parenthesis that closes the one at i, or the end."""
    depth = 0
    while i < len(t):
        depth += (t[i].type == "(") - (t[i].type == ")")
        i += 1
        if depth == 0:
            return i
    return len(t)


def cte_names(t: list[Token]) -> dict[str, tuple[int, int]]:
    """Names of common table expressions, each with the indexes of its name and of its body's parenthesis."""
    out: dict[str, tuple[int, int]] = {}
    if not t or t[0].type != "WITH":
        return out
    i = 2 if len(t) > 1 and t[1].type == "RECURSIVE" else 1
    while i < len(t) and is_word(t[i]):
        name, at = name_of(t[i]), i
        i += 1
        if i < len(t) and t[i].type == "(":
            i = matching(t, i)
        if i >= len(t) or t[i].type != "AS" or i + 1 >= len(t) or t[i + 1].type != "(":
            out.setdefault(name, (at, i))
            break
        out[name] = (at, i + 1)
        i = matching(t, i + 1)
        if i >= len(t) or t[i].type != ",":
            break
        i += 1
    return out


def has_set_operator(t: list[Token]) -> bool:
    return any(x.type in ("UNION", "INTERSECT", "EXCEPT") for x in t)


def joined_text(t: list[Token]) -> str:
    """Tokens with single spaces, none around . ( ) , ;"""
    out = ""
    for k, x in enumerate(t):
        tight = k == 0 or x.text in (".", "(", ")", ",", ";") or t[k - 1].text in (".", "(", ")", ",", ";")
        out += x.text if tight else " " + x.text
    return out


class Scopes:
    """The query blocks of one statement (default-channel tokens), outermost first by start."""

    def __init__(self, t: list[Token]):
        self.t = t
        self.ctes = cte_names(t)
        self.blocks: list[Scope] = []
        self.consumed: set[int] = set()  # indexes of tokens that name tables and aliases
        self._discover()
        self.by_start = {b.start: b for b in self.blocks}
        self._fill(0, len(t))

    def _discover(self) -> None:
        depth, open_ = 0, []
        if not self.t:
            return

        def push(start: int) -> None:
            self.blocks.append(Scope(start))
            open_.append((self.blocks[-1], depth))

        if self.t[0].type != "SELECT":
            push(self.t[0].start)
        for x in self.t:
            if x.type == "SELECT":
                while open_ and open_[-1][1] >= depth:
                    open_.pop()[0].stop = x.start
                push(x.start)
            elif x.type == "(":
                depth += 1
            elif x.type == ")":
                depth = max(0, depth - 1)
                while open_ and open_[-1][1] > depth:
                    open_.pop()[0].stop = x.start
        for b, _ in open_:
            b.stop = self.t[-1].stop + 1

    def _table_ref(self, i: int) -> tuple[Table | None, int]:
        """The reference at i, and the index behind it; None for a derived table."""
        t = self.t
        if i < len(t) and t[i].type == "LATERAL":
            i += 1
        if i < len(t) and t[i].type == "(":
            end = matching(t, i)
            self._fill(i + 1, end - 1)
            end = self._alias(end)[1]
            return None, end
        if i >= len(t) or not starts_name(t[i]) or t[i].type == "XMLTABLE" and i + 1 < len(t) and t[i + 1].type == "(":
            return None, i
        parts, at = [t[i]], i
        i += 1
        while i + 1 < len(t) and t[i].type == "." and is_word(t[i + 1]) and len(parts) < 3:
            parts.append(t[i + 1])
            i += 2
        if i < len(t) and t[i].type == "(" and (at == 0 or t[at - 1].type != "INTO"):  # a table function
            i = matching(t, i)
            self._alias(i)
            return None, self._alias(i)[1]
        self.consumed.update(range(at, i))
        names = [name_of(p) for p in parts]
        alias, i = self._alias(i)
        cte = len(names) == 1 and names[0] in self.ctes
        return Table(names[-2] if len(names) > 1 else NO_SCHEMA, names[-1], alias, parts[0].line, cte), i

    def _alias(self, i: int) -> tuple[str | None, int]:
        t = self.t
        if i + 1 < len(t) and t[i].type == "AS" and is_word(t[i + 1]):
            self.consumed.update((i, i + 1))
            return name_of(t[i + 1]), i + 2
        if i < len(t) and t[i].type in ("ID", "DOUBLE_QUOTE_ID"):
            self.consumed.add(i)
            return name_of(t[i]), i + 1
        return None, i

    def _join(self, i: int) -> tuple[str, int] | None:
        """The join that begins at i, and the index behind its words."""
        t = self.t
        if i < len(t) and t[i].type == "JOIN":
            return "JOIN", i + 1
        if i < len(t) and t[i].type in JOIN_WORDS:
            k = i + 1
            if k < len(t) and t[k].type == "OUTER":
                k += 1
            if k < len(t) and t[k].type == "JOIN":
                return t[i].type, k + 1
        return None

    def _list(self, i: int, end: int) -> tuple[list[Table | None], list[tuple[str, str, list[str]]], int]:
        t = self.t
        first, k = self._table_ref(i)
        if k == i:
            return [], [], i
        refs, links, i = [first], [], k
        while i < end:
            join = self._join(i)
            if t[i].type == ",":
                ref, k = self._table_ref(i + 1)
                if k == i + 1:
                    break
                refs.append(ref)
                links.append(("COMMA", "", []))
                i = k
            elif join:
                ref, i = self._table_ref(join[1])
                text, quals = "", []
                if i < end and t[i].type == "ON":
                    at, depth, i = i + 1, 0, i + 1
                    while i < end:
                        if depth == 0 and (t[i].type in _STOP or self._join(i)) or t[i].type == ")" and depth == 0:
                            break
                        if t[i].type == "(" and i + 1 < end and t[i + 1].type == "SELECT":
                            close = matching(t, i)
                            self._fill(i + 1, close - 1)
                            i = close
                            continue
                        depth += (t[i].type == "(") - (t[i].type == ")")
                        i += 1
                    text = joined_text(t[at:i])
                    quals = [name_of(t[x - 1]) for x in range(at + 1, i) if t[x].type == "."]
                elif i < end and t[i].type == "USING" and i + 1 < end and t[i + 1].type == "(":
                    at, i = i + 1, matching(t, i + 1)
                    self.consumed.update(range(at, i))
                    text = joined_text(t[at:i])
                refs.append(ref)
                links.append((join[0], text, quals))
            else:
                break
        return refs, links, i

    def _fill(self, lo: int, hi: int) -> None:
        """Gives each block in [lo, hi) its tables."""
        t, i = self.t, lo
        while i < hi:
            x = t[i]
            if x.type in ("FROM", "UPDATE", "INTO") and not self._phantom(i):
                block = self._owner(x.start)
                refs, links, k = self._list(i + 1, hi)
                if block is not None:
                    for r in refs:
                        if r is not None:
                            block.add(r)
                    for n, (kind, text, quals) in enumerate(links):
                        a, b = refs[n], refs[n + 1]
                        known = list({id(r): r for r in (block.aliases.get(q) for q in quals) if r is not None}.values())
                        if len(known) == 2:
                            a, b = known
                        if a is not None and b is not None:
                            block.connectors.append(Connector(a, b, kind, text))
                i = max(k, i + 1)
            else:
                i += 1

    def _phantom(self, i: int) -> bool:
        """FROM, UPDATE or INTO that no table follows: IS DISTINCT FROM, FOR UPDATE, EXTRACT(x FROM y), INTO :host."""
        t = self.t
        before = t[i - 1].type if i else ""
        if t[i].type == "FROM" and before == "DISTINCT" and i > 1 and t[i - 2].type in ("IS", "NOT"):
            return True
        if t[i].type == "UPDATE" and before == "FOR":
            return True
        if i + 1 < len(t) and t[i + 1].type == ":":
            return True
        if t[i].type == "FROM" and i >= 3 and t[i - 2].type == "(" and name_of(t[i - 3]) in ("EXTRACT", "TRIM"):
            return True
        return False

    def _owner(self, at: int) -> Scope | None:
        inside = [b for b in self.blocks if b.start <= at and (at < b.stop or b.stop < 0)]
        return max(inside, key=lambda b: b.start) if inside else None

    def resolve(self, at: int, qualifier: str | None, with_cte: bool = False) -> tuple[str, str]:
        """Schema and table that a qualifier at an offset stands for; placeholders if unknown, or a CTE unless with_cte."""
        if qualifier is None:
            return NO_SCHEMA, NO_TABLE
        inside = [b for b in self.blocks if b.start <= at <= b.stop]
        if inside:
            t = min(inside, key=lambda b: b.stop - b.start).aliases.get(qualifier)
            if t is not None and (with_cte or not t.is_cte):
                return t.schema, t.table
        return NO_SCHEMA, NO_TABLE

    def tables(self) -> list[Table]:
        return [t for b in self.blocks for t in b.tables if not t.is_cte]

    def connectors(self) -> list[Connector]:
        return [c for b in self.blocks for c in b.connectors]
