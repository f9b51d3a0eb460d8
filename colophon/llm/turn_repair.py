"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The turns of a conversation, in order, become an optional system turn and then
pairs of a user and an assistant turn: the initials of the roles read
``(s?(ua)+)?``.  Keeping a turn costs 0, giving it the role user or assistant 3,
deleting it 4 (blank and duplicate turns must go), inserting an empty turn 3; a
truncated turn that stays costs 3 more.  Of equally dear repairs the one whose
audit (the initials of its edits) is least in ASCII counts.

A global range sort numbers the turns, so a conversation may lie in many
partitions.  Runs of at most ``SEGMENT`` turns of a conversation become one row
each, with one letter per turn; these rows are dealt by hash.  In every batch
DuckDB's recursive query advances one turn for all runs at once and keeps, per
run, first state and state, the least cost and its audit (``USING KEY``: no
earlier step stays in memory).  Runs of one conversation are then combined,
``FAN`` at a time, by the same recursion over their tables of states, in as many
rounds as the longest conversation needs; the choice goes back down the same way.
Two audits of one run, state and cost differ before either ends (further letters
would be inserts, which cost), so the least audit of the parts gives the least
audit of the whole.  No conversation is gathered in a row before its audit, which
is part of the result.

Edge cases: null roles and texts are one space; a role that begins with no letter
of s, u and a fits no place, nor does an empty one; turns go by number, nulls
first, then role, then text; rows with a null id are one conversation; repeated
rows are duplicates; an empty table gives an empty result; further columns are
left out of the result.  Within ``repaired_turns`` no task holds more than a run;
``digests`` streams a conversation through one task without holding it, because
SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.storage import drop_stored, named, partitions, ranked, stored

BLANK = " \t\n\x0b\x0c\r"
SEGMENT, FAN = 256, 16
#: Batches that DuckDB gets: so many runs, or so many letters of audits, at most.
RUNS, LETTERS = 2048, 1 << 22
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: (state, role's initial, state after it).
GRAMMAR = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))


def _inserted() -> list[tuple[int, int, int]]:
    """(state, state, inserts): a third insert before one turn would only come back to a state that was there."""
    after = {p: q for p, initial, q in GRAMMAR if initial in "ua"}
    return [(p, p, 0) for p in range(4)] + [(p, after[p], 1) for p in range(4)] + [(p, after[after[p]], 2) for p in range(4)]


def _edges() -> pa.Table:
    """What one turn can become: (code, a, b, cost, audit), code = initial, upper-case if truncated, x if it must go."""
    rows = []
    for code in "suaoSUAOx":
        initial, extra = code.lower(), TRUNCATED if code.isupper() else 0
        for p, q, n in _inserted():
            rows.append((code, p, q, n * INSERT + DELETE, "I" * n + "D"))
            if code != "x":
                rows += [(code, p, to, n * INSERT + KEEP + extra, "I" * n + "K") for at, role, to in GRAMMAR if (at, role) == (q, initial)]
                rows += [(code, p, to, n * INSERT + REROLE + extra, "I" * n + "R") for at, role, to in GRAMMAR if at == q and role in "ua"]
    return pa.Table.from_pylist([dict(zip(("code", "a", "b", "cost", "audit"), r)) for r in rows])


_TURNS_SQL = """
WITH RECURSIVE walk(item, a, b, done, cost, audit) USING KEY (item, a, b) AS (
    SELECT item, s, s, 0, 0::BIGINT, '' FROM run, (SELECT unnest([0, 1, 2, 3])::BIGINT AS s) WHERE s = 0 OR NOT opens
  UNION
    SELECT item, a, b, done, best.cost, best.audit FROM (
        SELECT w.item, w.a, e.b, w.done + 1 AS done, min({'cost': w.cost + e.cost, 'audit': w.audit || e.audit}) AS best
        FROM walk w JOIN run ON run.item = w.item JOIN edge e ON e.code = substr(run.codes, w.done + 1, 1) AND e.a = w.b
        WHERE w.done < length(run.codes) GROUP BY w.item, w.a, e.b, w.done)
)
SELECT item, a, b, cost, audit FROM walk JOIN run USING (item) WHERE done = length(codes)
"""
_RUNS_SQL = """
WITH RECURSIVE walk(item, a, b, done, cost, audit, path) USING KEY (item, a, b) AS (
    SELECT item, s, s, 0, 0::BIGINT, '', s::VARCHAR FROM run, (SELECT unnest([0, 1, 2, 3])::BIGINT AS s) WHERE s = 0 OR NOT opens
  UNION
    SELECT item, a, b, done, best.cost, best.audit, best.path FROM (
        SELECT w.item, w.a, e.b, w.done + 1 AS done, min({'cost': w.cost + e.cost, 'audit': w.audit || e.audit, 'path': w.path || e.b::VARCHAR}) AS best
        FROM walk w JOIN edge e ON e.item = w.item AND e.place = w.done AND e.a = w.b
        GROUP BY w.item, w.a, e.b, w.done)
)
SELECT item, a, b, cost, audit, path FROM walk JOIN run USING (item) WHERE done = parts
"""


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _answers(con, sql: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The query's rows, each beside the id and the place of the run that it is about."""
    found = con.sql(sql).to_arrow_table()
    of = batch.select(["id", "run", "runs"]).take(found["item"].combine_chunks())
    return pa.RecordBatch.from_arrays([*of.columns, *[found[c].combine_chunks() for c in found.column_names[1:]]], names=["id", "run", "runs", *found.column_names[1:]])


def _walk_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    con.register("edge", _edges())
    for whole in batches:
        for at in range(0, whole.num_rows, RUNS):
            batch = whole.slice(at, RUNS)
            con.register("run", pa.table({"item": pa.array(range(batch.num_rows), pa.int64()), "opens": pc.equal(batch.column("run"), 0), "codes": batch.column("codes")}))
            yield _answers(con, _TURNS_SQL, batch)
            con.unregister("run")


def _walk_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    for whole in batches:
        ends, letters = [0], 0
        for k, n in enumerate(whole.column("letters").to_pylist()):
            if k > ends[-1] and (letters + n > LETTERS or k - ends[-1] == RUNS):
                ends.append(k)
                letters = 0
            letters += n
        for at, end in zip(ends, [*ends[1:], whole.num_rows]):
            batch = whole.slice(at, end - at)
            steps = batch.column("steps")
            flat, item = steps.flatten(), pc.list_parent_indices(steps)
            con.register("edge", pa.table({"item": pc.cast(item, pa.int64()), **{c: flat.field(c) for c in ("place", "a", "b", "cost", "audit")}}))
            con.register("run", pa.table({"item": pa.array(range(batch.num_rows), pa.int64()), "opens": pc.equal(batch.column("run"), 0), "parts": batch.column("parts")}))
            yield _answers(con, _RUNS_SQL, batch)
            con.unregister("run")
            con.unregister("edge")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which null ids meet."""
    other = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return left.join(other, cond, how).drop(*[f"__{k}" for k in keys])


def ordered_turns(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(id, turn, role, text, blank, truncated, t1, t2, rank, segment): every turn with its place in the order of all turns; stored."""
    role, text = (F.coalesce(named(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    bare = F.btrim(F.col("text"), F.lit(BLANK))
    slim = rows.select(named(id_col).alias("id"), named(turn_col).alias("turn"), role.alias("role"), text.alias("text")).withColumns({
        "blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit(1), F.col("role"), F.col("text")),
        "tie": F.monotonically_increasing_id(),
    })
    # Equal turns may change places: the tie only lets a range boundary fall between them.
    placed = ranked(slim, [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")], label="turns")
    return placed.drop("tie").withColumn("segment", F.expr(f"rank div {segment}"))


def faulted(turns: DataFrame) -> DataFrame:
    """(id, segment, rank, initial, fault): each turn's first fault, blank, duplicate, truncated or none."""
    slim = turns.select("id", "segment", "rank", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "t1", "t2")
    twice = slim.groupBy("id", "t1", "t2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = _joined(slim, twice, ["id", "t1", "t2"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("rank") > F.col("first"), "d").when(F.col("truncated"), "t").otherwise("-")
    return seen.select("id", "segment", "rank", "initial", fault.alias("fault"))


def _strung(what: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", what.alias("x")))), lambda r: r["x"]), "")


def runs_of(turns: DataFrame) -> DataFrame:
    """One row per run: its place among the ``runs`` of its conversation, its turns' codes, and its counts; stored."""
    low = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(low)).otherwise(low)
    count = lambda f: F.count_if(F.col("fault") == f)
    run = faulted(turns).groupBy("id", "segment").agg(_strung(code).alias("codes"), _strung(low).alias("initials"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    pairs = F.when(F.length("initials") > 1, F.size(F.filter(F.sequence(F.lit(1), F.length("initials") - 1), lambda k: ~F.substr("initials", k, F.lit(2)).isin("su", "ua", "au")))).otherwise(0)
    run = stored(run.withColumn("illegal", pairs.cast("long")), "runs")
    # The pair of turns on both sides of a boundary, and the place of each run.
    last = run.select("id", (F.col("segment") + 1).alias("segment"), F.substring("initials", -1, 1).alias("before"))
    met = _joined(run, last, ["id", "segment"], "left")
    across = F.col("before").isNotNull() & ~F.concat("before", F.substring("initials", 1, 1)).isin("su", "ua", "au")
    spans = run.groupBy("id").agg(F.min("segment").alias("least"), F.count("*").alias("runs"))
    out = _joined(met.withColumn("illegal", F.col("illegal") + across.cast("long")), spans, ["id"]).withColumn("run", F.col("segment") - F.col("least")).drop("before", "initials")
    out = stored(out, "runs")
    drop_stored(run)
    return out


_STATES = "run long, runs long, a long, b long, cost long, audit string"


def walked(runs: DataFrame, kind: str, fan: int = FAN) -> list[DataFrame]:
    """Level by level, (id, run, runs, a, b, cost, audit, path): the cheapest way through each run of runs from state a to b; stored.

    A conversation ends at the level where it is one run.
    """
    dealt = runs.select("id", "run", "runs", "codes").repartition(partitions(runs.sparkSession), "id", "run")
    levels = [stored(dealt.mapInArrow(_walk_turns, f"id {kind}, {_STATES}").withColumn("path", F.lit(None).cast("string")), "walk")]
    longest = runs.agg(F.max("runs")).first()[0] or 0
    while longest > 1:
        more = levels[-1].where("runs > 1")
        step = F.struct((F.col("run") % fan).alias("place"), "a", "b", "cost", "audit")
        grouped = more.groupBy("id", F.expr(f"run div {fan}").alias("up"), "runs").agg(F.collect_list(step).alias("steps"), F.sum(F.length("audit")).alias("letters"), F.count_distinct("run").alias("parts"))
        grouped = grouped.select("id", F.col("up").alias("run"), F.expr(f"(runs + {fan - 1}) div {fan}").alias("runs"), "parts", "letters", "steps")
        levels.append(stored(grouped.mapInArrow(_walk_runs, f"id {kind}, {_STATES}, path string"), "walk"))
        longest = -(-longest // fan)
    return levels


def chosen(levels: list[DataFrame], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(id, cost, audit) of each conversation, and (id, run, a, audit) of each of its runs."""
    tail = F.when(F.col("b") == USER, "I").when(F.col("b") == SYSTEM, "II").otherwise("")
    best = []
    for level in levels:
        ends = level.where("runs = 1 AND a = 0").select("id", "b", (F.col("cost") + INSERT * F.length(tail)).alias("cost"), F.concat("audit", tail).alias("audit"))
        best.append(ends.groupBy("id").agg(F.min(F.struct("cost", "audit", "b")).alias("best")).select("id", "best.cost", "best.audit", "best.b"))
    whole = stored(reduce(DataFrame.unionByName, best), "audits")
    picked = None
    for k in range(len(levels) - 1, -1, -1):
        tops = _joined(levels[k].where("runs = 1 AND a = 0"), whole.select("id", "b"), ["id", "b"])
        here = tops if picked is None else tops.unionByName(_joined(levels[k], picked, ["id", "run", "a", "b"]))
        here = here.select("id", "run", "runs", "a", "b", "audit", "path")
        if k:
            each = here.select("id", "run", "path", F.posexplode(F.sequence(F.lit(1), F.length("path") - 1)).alias("place", "at"))
            state = lambda at: F.substr("path", at, F.lit(1)).cast("long")
            picked = each.select("id", (F.col("run") * fan + F.col("place")).alias("run"), state(F.col("at")).alias("a"), state(F.col("at") + 1).alias("b"))
        else:
            picked = here
    return whole, picked.select("id", "run", "runs", "a", "b", "audit")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's audit, then its turns: the repaired turns in order."""
    state, edits, place = START, iter(()), 0
    after = {(p, r): q for p, r, q in GRAMMAR}
    for batch in batches:
        out: list[tuple] = []
        index = []

        def emit(k, role, text, edit):
            nonlocal state, place
            state = after[state, role[0]]
            out.append((place, role, text, edit))
            index.append(k)
            place += 1

        due = lambda: "assistant" if state == USER else "user"
        ids = batch.column("id")
        rows = zip(*[batch.column(c).to_pylist() for c in ("audit", "a", "tail", "role", "text")])
        for k, (audit, a, tail, role, text) in enumerate(rows):
            if audit is not None:
                state, edits, place = a, iter(audit), 0
                continue
            for edit in edits:
                if edit == "I":
                    emit(k, due(), "", edit)
                    continue
                if edit != "D":
                    emit(k, role if edit == "K" else due(), text, edit)
                break
            for _ in range(tail or 0):
                emit(k, due(), "", "I")
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(index, pa.int64())), batch.column("segment").take(pa.array(index, pa.int64())), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["id", "segment", "place", "role", "text", "edit"]
        )


def _repaired(turns: DataFrame, runs: DataFrame, parts: DataFrame, kind: str) -> DataFrame:
    ends = _joined(parts, runs.select("id", "run", "segment", F.length("codes").alias("n")), ["id", "run"])
    tail = F.when(F.col("run") < F.col("runs") - 1, 0).when(F.col("b") == USER, 1).when(F.col("b") == SYSTEM, 2).otherwise(0)
    null = lambda t: F.lit(None).cast(t)
    head = ends.select("id", "segment", F.lit(-1).cast("long").alias("rank"), "audit", "a", null("int").alias("tail"), null("string").alias("role"), null("string").alias("text"))
    # What is inserted behind the last turn comes as a turn of its own that no edit is left for.
    foot = ends.where(tail > 0).select("id", "segment", F.lit((1 << 63) - 1).alias("rank"), null("string").alias("audit"), null("long").alias("a"), tail.cast("int").alias("tail"), null("string").alias("role"), null("string").alias("text"))
    body = turns.select("id", "segment", "rank", null("string").alias("audit"), null("long").alias("a"), null("int").alias("tail"), "role", "text")
    dealt = head.unionByName(body).unionByName(foot).repartition(partitions(turns.sparkSession), "id", "segment").sortWithinPartitions("id", "segment", "rank")
    return dealt.mapInArrow(_apply, f"id {kind}, segment long, place long, role string, text string, edit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines of each conversation, as its rows come by."""
    now, sha, kind = None, None, None
    for batch in batches:
        kind, done, ids = batch.schema.field("id").type, [], batch.column("id").to_pylist()
        for k, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            if sha is None or k != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = k, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["id", "sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()], pa.string())], names=["id", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(id, sha256) of each conversation that has turns."""
    kind = repaired.schema["id"].dataType.simpleString()
    return repaired.repartition(partitions(repaired.sparkSession), "id").sortWithinPartitions("id", "segment", "place").select("id", "role", "text").mapInArrow(_digest, f"id {kind}, sha256 string")


def repair(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(id, segment, place, role, text, edit) of every repaired turn, in order of segment and place; and per conversation
    (id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    kind = rows.schema[id_col].dataType.simpleString()
    turns = ordered_turns(rows, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col, segment=segment)
    runs = runs_of(turns)
    whole, parts = chosen(walked(runs, kind, fan), fan)
    gaps = turns.groupBy("id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = runs.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    audits = _joined(_joined(whole.select("id", "cost", "audit"), counts, ["id"]), gaps, ["id"])
    return _repaired(turns, runs, parts, kind), audits.select("id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair_report(rows: DataFrame, every: DataFrame, *, id_col: str = "conv_id", **parameters) -> DataFrame:
    """The audit of each conversation of ``every`` and the digest of its repaired turns; one without rows has zeros."""
    turns, audits = repair(rows, id_col=id_col, **parameters)
    ids = every.select(named(id_col).alias("id")).distinct()
    out = _joined(_joined(ids, audits, ["id"], "left"), digests(turns), ["id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias(id_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the contract's query repairs: rows lost, emptied, without their stops, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


#: The report of damaged conversations in DuckDB's SQL, over a table whose ids are not null.
REPORT_SQL = """
WITH RECURSIVE crc(t) AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) FROM range(256) r(n)
), marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(conv_id, ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
    FROM marked WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM hurt
), faulty AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
           CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM numbered
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), inserts(p, q, k, lines) AS (
    VALUES ('E', 'E', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('E', 'U', 1, concat('user:', chr(10))), ('S', 'U', 1, concat('user:', chr(10))), ('A', 'U', 1, concat('user:', chr(10))),
           ('U', 'A', 1, concat('assistant:', chr(10))), ('E', 'A', 2, concat('user:', chr(10), 'assistant:', chr(10))), ('S', 'A', 2, concat('user:', chr(10), 'assistant:', chr(10))),
           ('A', 'A', 2, concat('user:', chr(10), 'assistant:', chr(10))), ('U', 'U', 2, concat('assistant:', chr(10), 'user:', chr(10)))
), moves(q, role, r) AS (VALUES ('E', 'system', 'S'), ('E', 'user', 'U'), ('S', 'user', 'U'), ('U', 'assistant', 'A'), ('A', 'user', 'U')
), edits AS (
    SELECT f.conv_id, f.n, q, q AS r, 4 AS cost, 'D' AS letter, '' AS line FROM faulty f, (VALUES ('E'), ('S'), ('U'), ('A')) states(q)
    UNION ALL SELECT f.conv_id, f.n, q, r, CASE WHEN fault IS NULL THEN 0 ELSE 3 END, 'K', concat(f.role, ':', f.text, chr(10)) FROM faulty f, moves m WHERE initial = left(m.role, 1) AND (fault IS NULL OR fault = 'truncated')
    UNION ALL SELECT f.conv_id, f.n, q, r, CASE WHEN fault IS NULL THEN 3 ELSE 6 END, 'R', concat(m.role, ':', f.text, chr(10)) FROM faulty f, moves m WHERE m.role <> 'system' AND (fault IS NULL OR fault = 'truncated')
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, 'E' AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM counts
    UNION ALL
    SELECT w.conv_id, w.n + 1, e.r, min({'cost': w.best.cost + 3 * i.k + e.cost, 'audit': concat(w.best.audit, repeat('I', i.k), e.letter), 'lines': concat(w.best.lines, i.lines, e.line)})
    FROM walk w JOIN inserts i ON i.p = w.state JOIN edits e ON e.conv_id = w.conv_id AND e.n = w.n + 1 AND e.q = i.q GROUP BY w.conv_id, w.n, e.r
), ends AS (
    SELECT conv_id, min({'cost': w.best.cost + 3 * i.k, 'audit': concat(w.best.audit, repeat('I', i.k)), 'lines': concat(w.best.lines, i.lines)}) AS best
    FROM walk w JOIN counts USING (conv_id, n) JOIN inserts i ON i.p = w.state AND i.q IN ('E', 'A') GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines[1:length(best.lines) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id)
"""
