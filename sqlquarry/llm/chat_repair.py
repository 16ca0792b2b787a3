"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is accepted by an automaton: an optional system turn, then user and assistant turns in
alternation, ending with an assistant's. Each turn may be kept, relabelled, or merged into the turn before it, and empty
turns may be inserted; dynamic programming over the automaton's states finds the cheapest repair. One turn is a 4 x 4
cost matrix, so a long conversation is cut into segments whose (min, +) products are composed in order, and each segment is
then repaired between the states that the composition chose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, written

ROLES = ("system", "user", "assistant")
START, SYS, USER, ASST = range(4)
#: Legal turns: state -> role -> state.
LEGAL = {START: {0: SYS, 1: USER}, SYS: {1: USER}, USER: {2: ASST}, ASST: {1: USER}}
KEEP, MERGE_SAME, INSERT, RELABEL, MERGE_OTHER = 0, 1, 2, 3, 5
#: Conversations of more turns than this are repaired in segments.
SEGMENT = 512
HEADER, END = "<|{}|>\n", "<|end|>\n"
_FAR = 1 << 40


def _inserts() -> dict[int, dict[int, tuple[int, ...]]]:
    """Fewest empty turns that lead from a state to another."""
    out = {}
    for s in range(4):
        seen, todo = {s: ()}, [s]
        while todo:
            x = todo.pop(0)
            for role, to in sorted(LEGAL[x].items()):
                if to not in seen:
                    seen[to] = (*seen[x], role)
                    todo.append(to)
        out[s] = seen
    return out


_PATHS = _inserts()
_STATE_ROLE = {SYS: 0, USER: 1, ASST: 2}


def _steps() -> list[list[list[tuple[int, str, int, tuple[int, ...]] | None]]]:
    """For each role (3: any other) and states s, t: cost, action, new role and empty turns before, or None."""
    out = []
    for role in range(4):
        grid = [[None] * 4 for _ in range(4)]
        for s in range(4):
            options = []
            if s != START:
                same = _STATE_ROLE[s] == role
                options.append((s, (MERGE_SAME if same else MERGE_OTHER, "merge", _STATE_ROLE[s], ())))
            for mid, empty in _PATHS[s].items():
                for new, to in LEGAL[mid].items():
                    cost = INSERT * len(empty) + (KEEP if new == role else RELABEL)
                    options.append((to, (cost, "keep" if new == role else "relabel", new, empty)))
            for to, o in options:
                if grid[s][to] is None or (o[0], len(o[3])) < (grid[s][to][0], len(grid[s][to][3])):
                    grid[s][to] = o
        out.append(grid)
    return out


STEPS = _steps()
FINISH = [(0, ()), (2 * INSERT, (1, 2)), (INSERT, (2,)), (0, ())]


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else 3


def forward(roles: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Least cost of reaching each state after all turns, and for each turn the state before, by the state after."""
    cost = [_FAR] * 4
    cost[entry] = 0
    back = []
    for r in roles:
        grid, new, from_ = STEPS[r], [_FAR] * 4, [-1] * 4
        for s in range(4):
            if cost[s] < _FAR:
                row = grid[s]
                for t in range(4):
                    if row[t] is not None and cost[s] + row[t][0] < new[t]:
                        new[t], from_[t] = cost[s] + row[t][0], s
        cost = new
        back.append(from_)
    return cost, back


def repair(roles: list[int], entry: int = START, exit_: int | None = None) -> tuple[int, list[tuple[str, int, tuple[int, ...]]], tuple[int, ...]]:
    """Cost, (action, new role, empty turns before) of each turn, and the empty turns at the end. Without an exit state the
    conversation ends here; ties go to the lower state number."""
    cost, back = forward(roles, entry)
    last, state = (), exit_
    total = cost[exit_] if exit_ is not None else 0
    if exit_ is None:
        total, state = min((cost[s] + FINISH[s][0], s) for s in range(4))
        last = FINISH[state][1]
    out = []
    for r, from_ in zip(reversed(roles), reversed(back), strict=True):
        s = from_[state]
        _, action, new, empty = STEPS[r][s][state]
        out.append((action, new, empty))
        state = s
    return total, out[::-1], last


def pieces(texts: list[str | None], plan: list[tuple[str, int, tuple[int, ...]]], last: tuple[int, ...], opening: bool, closing: bool) -> list[str]:
    """What each turn adds to the rendered conversation; all pieces in order are the whole."""
    out, first = [], opening
    for text, (action, new, empty) in zip(texts, plan, strict=True):
        if action == "merge":
            out.append("\n" + (text or ""))
            continue
        head = "" if first else END
        head += "".join(HEADER.format(ROLES[e]) + END for e in empty)
        out.append(head + HEADER.format(ROLES[new]) + (text or ""))
        first = False
    if closing and out:
        out[-1] += END + "".join(HEADER.format(ROLES[e]) + END for e in last)
    return out


_OUT = "conv_id {kind}, turn long, role string, action string, new_role string, inserted_before string, inserted_after string, cost long, piece string"


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], limit: int | None) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys in sorted batches, cut at limit rows."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and (key != now or (limit and len(rows) >= limit)):
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _rows(group: list[dict], total: int | None, plan, last, parts) -> list[dict]:
    out = []
    for k, (row, (action, new, empty), piece) in enumerate(zip(group, plan, parts, strict=True)):
        after = last if k == len(group) - 1 else ()
        out.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "action": action, "new_role": ROLES[new], "inserted_before": ",".join(ROLES[e] for e in empty), "inserted_after": ",".join(ROLES[e] for e in after), "cost": total, "piece": piece})
    return out


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row for each turn: conv_id, turn, role, action (keep, relabel, merge), new_role, the roles of empty turns inserted
    before and after, the conversation's repair cost, and its piece of the rendered conversation.

    Turns are ordered by number (null first), then role and text, so ties and repeated rows have a fixed order; roles are
    compared trimmed and in lower case, and null or unknown roles cost a relabel or a merge; null text renders as empty;
    turns without a conversation id are one conversation; an empty table gives no rows; other columns are dropped.
    Conversations of over `segment` turns are sorted over all tasks and cut by row, so that neither a long one nor many equal
    turns have to fit into a task.
    """
    spark = turns.sparkSession
    kind = turns.schema[conv_col].dataType.simpleString()
    out_schema = _OUT.format(kind=kind)
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("_c", F.xxhash64("conv_id"))
    order = ["_c", "conv_id", "turn", "role", "text"]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out_schema))
    long = written(base.groupBy("_c").count().where(F.col("count") > segment).select("_c"))
    many = long.count()
    side = F.broadcast(long) if many <= 100_000 else long

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, group in _groups(batches, ("conv_id",), None):
            total, plan, last = repair([role_number(r["role"]) for r in group])
            out += _rows(group, total, plan, last, pieces([r["text"] for r in group], plan, last, True, True))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    short = base.join(side, "_c", "left_anti").repartition("_c").sortWithinPartitions(*order)
    result = short.mapInArrow(tidy(whole), out_schema)
    if not many:
        return result

    # long conversations: rows in order over all tasks, numbered, and cut into segments
    rows = written(base.join(side, "_c").withColumn("_tie", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // (8 * segment)))
    dealt = rows.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds _p (the task), _k (the segment in it) and _i (the row in the segment)."""
        from pyspark import TaskContext

        p, now, k, i = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            ks, is_ = [], []
            for c in batch.column("_c").to_pylist():
                if c != now or i == segment:
                    now, k, i = c, k + 1, 0
                ks.append(k)
                is_.append(i)
                i += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p] * len(ks), pa.int32()), pa.array(ks, pa.int32()), pa.array(is_, pa.int32())], names=[*batch.schema.names, "_p", "_k", "_i"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    cut = written(dealt.mapInArrow(tidy(numbered), f"{fields}, _p int, _k int, _i int").drop("_tie"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (c, p, k), group in _groups(batches, ("_c", "_p", "_k"), None):
            roles = [role_number(r["role"]) for r in group]
            found.append((c, p, k, [x for e in range(4) for x in forward(roles, e)[0]]))
        if found:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["_c", "_p", "_k", "m"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,), segs in _groups(batches, ("_c",), None):
            costs = [[0, _FAR, _FAR, _FAR]]
            for s in segs:
                m = s["m"]
                costs.append([min(min(costs[-1][e] + m[4 * e + t] for e in range(4)), _FAR) for t in range(4)])
            total, state = min((costs[-1][s] + FINISH[s][0], s) for s in range(4))
            ends = [state]
            for k in range(len(segs) - 1, -1, -1):
                m = segs[k]["m"]
                state = min((costs[k][e] + m[4 * e + state], e) for e in range(4))[1]
                ends.append(state)
            ends.reverse()
            n = len(segs)
            yield pa.RecordBatch.from_arrays([pa.array([s["_p"] for s in segs], pa.int32()), pa.array([s["_k"] for s in segs], pa.int32()), pa.array(ends[:-1], pa.int32()), pa.array(ends[1:], pa.int32()), pa.array([k == 0 for k in range(n)]), pa.array([k == n - 1 for k in range(n)]), pa.array([total] * n, pa.int64())], names=["_p", "_k", "entry", "exit", "opening", "closing", "total"])

    by_segment = cut.repartition("_p", "_k").sortWithinPartitions("_c", "_p", "_k", "_i")
    segs = by_segment.select("_c", "_p", "_k", "role").mapInArrow(tidy(matrices), "_c long, _p int, _k int, m array<long>").repartition("_c").sortWithinPartitions("_c", "_p", "_k")
    segs = written(segs.mapInArrow(tidy(chosen), "_p int, _k int, entry int, exit int, opening boolean, closing boolean, total long"))

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, ("_p", "_k"), None):
            s = group[0]
            _, plan, _ = repair([role_number(r["role"]) for r in group], s["entry"], s["exit"])
            last = FINISH[s["exit"]][1] if s["closing"] else ()
            yield pa.RecordBatch.from_pylist(_rows(group, s["total"], plan, last, pieces([r["text"] for r in group], plan, last, s["opening"], s["closing"])), arrow)

    ready = cut.join(segs, ["_p", "_k"]).repartition("_p", "_k").sortWithinPartitions("_c", "_p", "_k", "_i")
    return result.unionByName(ready.mapInArrow(tidy(segmented), out_schema))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
