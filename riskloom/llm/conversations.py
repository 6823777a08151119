"""Repair of conversations whose turns are blank, repeated, cut off or out of order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import Key, ordered_slots, slot_offsets
from riskloom.llm import alignment
from riskloom.llm.worker import kept
from riskloom.session import materialize

#: Conversations of more rows or bytes are aligned in stretches of ``LONG`` rows.
LONG, LONG_BYTES = 1_000, 16 << 20
#: Rows of a long conversation that one task sorts.
SLOT_ROWS = 250_000
#: Alignments of which a worker keeps the result.
REMEMBERED = 200_000
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
ROLES = {"u": "user", "a": "assistant"}

TURNS = "turns array<struct<role:string,text:string>>"
SCHEMA = f"conv_id long, part long, parts long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, {TURNS}"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(col: str, name: str | None = None) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(col).cast("string"), F.lit(" ")).alias(name or col)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a hash of ``conv_id:turn`` decides.

    Of 20 cases one drops the row, one empties its text, one removes its ``.!?``, one repeats it and one
    makes its role user. Null roles and texts become one space first, null ids and turns count as one space in the hash.
    """
    case = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text, role = plain("text"), plain("role")
    hurt = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), case.alias("case"))
    times = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hurt.filter("case <> 0").withColumn("time", F.explode(times)).drop("case", "time")


def code(role: str) -> int:
    return "uas".find(role[0]) % 4 if role else alignment.OTHER


def aligned(codes: list[int], cut: list[int], gone: list[bool]) -> tuple[int, str]:
    """``alignment.align``, remembered by the worker."""
    done = kept("alignments", dict)
    key = bytes([c + 4 * s + 8 * g for c, s, g in zip(codes, cut, gone)])
    if key not in done:
        if len(done) > REMEMBERED:
            done.clear()
        done[key] = alignment.align(codes, cut, gone)
    return done[key]


def repaired(audit: str, rows: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The turns that the edits leave."""
    begins = audit.lstrip("D")[:1] == "K" and rows[len(audit) - len(audit.lstrip("D"))][0][:1] == "s"
    out, at = [], 0
    for edit, initial in zip(audit, alignment.symbols(audit, begins, 0)):
        if edit == "I":
            out.append({"role": ROLES[initial], "text": ""})
            continue
        if edit != "D":
            out.append({"role": ROLES[initial] if edit == "R" else rows[at][0], "text": rows[at][1]})
        at += 1
    return out


def whole(conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The one part of a conversation, from its rows in order."""
    seen, gone, cut, blank, duplicate = set(), [], [], 0, 0
    for row in rows:
        text = row[1].rstrip(BLANKS)
        first = not text or row not in seen
        seen.add(row)
        blank += not text
        duplicate += not first
        gone.append(not text or not first)
        cut.append(int(not gone[-1] and text[-1] not in ".!?"))
    codes = [code(role) for role, _ in rows]
    illegal = sum(pair not in ((2, 0), (0, 1), (1, 0)) for pair in zip(codes, codes[1:]))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = aligned(codes, cut, gone)
    return conv_id, 0, 1, gaps, blank, duplicate, sum(cut), illegal, cost, audit, repaired(audit, rows)


def short_conversations(rows: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per conversation: the rows stream past in order, one conversation is held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, turns, held, size = [], None, [], [], 0

        def send():
            columns = list(zip(*done)) if done else [[]] * 11
            kinds = [pa.int64()] * 9 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            names = ["conv_id", "part", "parts", *COUNTS, "audit", "turns"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != conv:
                    done.append(whole(conv, turns, held))
                    turns, held = [], []
                    if size > 4 << 20 or len(done) > 5_000:
                        yield send()
                        done, size = [], 0
                conv = row[0]
                turns.append(row[1])
                held.append(row[2:])
                size += len(row[3])
        if held:
            done.append(whole(conv, turns, held))
        yield send()

    near = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return near.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, SCHEMA)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``, their place in their conversation from 0, however long that is."""
    slotted, slots = ordered_slots(rows, ["conv_key"], [Key("turn"), Key("role"), Key("text")], SLOT_ROWS)
    place = F.row_number().over(Window.partitionBy("conv_key", *slots).orderBy("turn", "role", "text")) - 1
    if not slots:
        return materialize(slotted.withColumn("part", place.cast("long")), "long-turns")
    offsets = slot_offsets(slotted, ["conv_key"], slots).drop("_slot_rows")
    placed = slotted.join(offsets, ["conv_key", *slots]).withColumn("part", place + F.col("_before"))
    return materialize(placed.drop("_before", *slots), "long-turns")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_key, part, code, cut, gone, blank, duplicate, illegal) of the rows of ``numbered``."""
    body = F.rtrim("text", F.lit(BLANKS))
    light = rows.select(
        "conv_key", "part", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        F.when(F.col("role") != "", (F.position(F.substring("role", 1, 1), F.lit("uas")) + 3) % 4).otherwise(3).alias("code"))
    firsts = light.groupBy("conv_key", "same").agg(F.min("part").alias("part")).select("conv_key", "part", F.lit(False).alias("again"))
    before = light.select("conv_key", (F.col("part") + 1).alias("part"), F.col("code").alias("last"))
    both = light.join(firsts, ["conv_key", "part"], "left").join(before, ["conv_key", "part"], "left")
    duplicate = ~F.col("blank") & F.col("again").isNull()
    gone = F.col("blank") | duplicate
    follows = (F.col("last") * 4 + F.col("code")).isin(8, 1, 4)
    return materialize(both.select(
        "conv_key", "part", "code", (F.col("open") & ~gone).cast("int").alias("cut"), gone.alias("gone"), "blank",
        duplicate.alias("duplicate"), (F.col("last").isNotNull() & ~follows).alias("illegal")), "long-marks")


def long_conversations(rows: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per row of the conversations; counts and audits add up over the parts.

    Rows are numbered in slots, each stretch of ``LONG`` rows is aligned by itself between all states
    of the grammar, and the ways through the stretches, twelve at most of each, are chained per conversation.
    """
    placed = numbered(rows.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    marks = marked(placed)
    lengths = marks.groupBy("conv_key").agg(F.max("part").alias("end"))
    cuts = marks.join(lengths, "conv_key").withColumn("stretch", F.floor(F.col("part") / LONG))

    def ways(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        col = {c: table.column(c).to_pylist() for c in ("part", "code", "cut", "gone")}
        stretch, end = col["part"][0] // LONG, table.column("end")[0].as_py()
        turns = alignment.Turns.of(col["code"], col["cut"], col["gone"])
        found = alignment.stretches(turns, stretch == 0, col["part"][-1] == end)
        state, goal, cost, audit = zip(*found)
        key = [table.column("conv_key")[0].as_py()] * len(found)
        return pa.table({"conv_key": key, "stretch": [stretch] * len(found), "state": state, "goal": goal, "cost": cost, "audit": audit},
                        schema=pa.schema([("conv_key", pa.string())] + [(c, pa.int64()) for c in ("stretch", "state", "goal", "cost")] + [("audit", pa.string())]))

    through = materialize(cuts.select("conv_key", "stretch", "part", "code", "cut", "gone", "end").groupBy("conv_key", "stretch").applyInArrow(
        ways, "conv_key string, stretch long, state long, goal long, cost long, audit string"), "long-ways")
    # the order of the audits is all that the chain needs of them
    order = F.row_number().over(Window.partitionBy("conv_key", "stretch", "state").orderBy("audit"))
    ranked = through.withColumn("rank", order)

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("stretch")
        rows = list(zip(*(table.column(c).to_pylist() for c in ("stretch", "state", "goal", "cost", "rank"))))
        stretches: list[list] = [[] for _ in range(rows[-1][0] + 1)]
        for stretch, state, goal, cost, rank in rows:
            stretches[stretch].append((state, goal, cost, rank))
        _, places = alignment.chain(stretches)
        picked = [ways[p][:2] for ways, p in zip(stretches, places)]
        return pa.table({"conv_key": [table.column("conv_key")[0].as_py()] * len(picked), "stretch": list(range(len(picked))),
                         "state": [s for s, _ in picked], "goal": [g for _, g in picked]})

    chosen = ranked.select("conv_key", "stretch", "state", "goal", "cost", "rank").groupBy("conv_key").applyInArrow(
        chained, "conv_key string, stretch long, state long, goal long")
    taken = through.join(chosen, ["conv_key", "stretch", "state", "goal"]).join(
        marks.filter("code = 2").withColumn("stretch", F.floor(F.col("part") / LONG)).groupBy("conv_key", "stretch").agg(
            F.sort_array(F.collect_list("part")).alias("systems")), ["conv_key", "stretch"], "left")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, stretch, state, audit, systems in zip(*(c.to_pylist() for c in batch.columns)):
                lead = len(audit) - len(audit.lstrip("D"))
                begins = state == alignment.START and audit[lead:lead + 1] == "K" and stretch * LONG + lead in set(systems or ())
                parts = alignment.by_turn(audit)
                initials, at, marks = alignment.symbols(audit, begins, int(state == alignment.ASSISTANT)), 0, []
                for part in parts:
                    marks.append(initials[at:at + len(part)])
                    at += len(part)
                places = [stretch * LONG + i for i in range(len(parts))]
                yield pa.RecordBatch.from_pydict({"conv_key": [key] * len(parts), "part": places, "audit": parts, "initials": marks})

    done = taken.select("conv_key", "stretch", "state", "audit", "systems").mapInArrow(
        edits, "conv_key string, part long, audit string, initials string")
    spans = placed.groupBy("conv_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.count(F.lit(1)).alias("parts"))
    edit = lambda i: F.substring("audit", i, F.lit(1))
    initial = lambda i: F.when(F.substring("initials", i, F.lit(1)) == "u", "user").otherwise("assistant")
    steps = F.filter(F.sequence(F.lit(1), F.length("audit")), lambda i: edit(i) != "D")
    own = lambda i: edit(i).isin("K", "R")
    turns = F.transform(steps, lambda i: F.struct(
        F.when(edit(i) == "K", F.col("role")).otherwise(initial(i)).alias("role"),
        F.when(own(i), F.col("text")).otherwise("").alias("text")))
    count = lambda letter: F.length("audit") - F.length(F.translate("audit", letter, ""))
    cost = (alignment.DELETE * count("D") + alignment.CHANGE * count("R") + alignment.INSERT * count("I")
            + F.when(count("D") == 0, F.col("cut")).otherwise(0))
    found = done.join(marks, ["conv_key", "part"]).join(placed, ["conv_key", "part"]).join(spans, "conv_key")
    return found.select(
        "conv_id", "part", "parts", F.when(F.col("part") == 0, F.col("gaps")).otherwise(0).alias("gaps"),
        *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate")], F.col("cut").cast("long").alias("truncated"),
        F.col("illegal").cast("long").alias("illegal"), cost.cast("long").alias("cost"), "audit", turns.alias("turns"))


def repair(rows: DataFrame) -> DataFrame:
    """Give every conversation the form ``(s?(ua)+)?`` by the cheapest edits.

    ``rows`` has conv_id, turn, role and text, and may have more columns. A conversation's rows go by turn, nulls first, then
    role and text; a null id is a conversation too. Null roles and texts are one space. A blank row, or one whose role and text
    came before, must go; a text that ends without ``.!?`` is truncated. An empty role has no initial: it can be
    renamed, not kept. Repeated rows are duplicates. No rows give no rows.

    The result has a row of ``SCHEMA`` per part: conversations of up to ``LONG`` rows and ``LONG_BYTES`` are one part, longer ones
    have a part per row. Counts, costs, audits and turns of the parts, by ``part``, make up the conversation's. All its rows
    pass one task only where it is short.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    large = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    large = large.filter((F.col("n") > LONG) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("_long"))
    large = materialize(large, "long-conversations")
    if large.isEmpty():
        return short_conversations(rows)
    same = rows["conv_id"].eqNullSafe(large["_long"])
    return short_conversations(rows.join(large, same, "left_anti")).unionByName(
        long_conversations(rows.join(large, same, "left_semi")))


def digests(repairs: DataFrame) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) per conversation, the digest over ``role:text`` joined by line feeds.

    Conversations in several parts stream past a task in order; only the hash and the audit are held.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = repairs.filter("parts = 1").select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def send():
            sums, audit, digest, _ = state
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), **{c: [s] for c, s in zip(COUNTS, sums)},
                                               "audit": [b"".join(audit).decode()], "repaired_sha256": [digest.hexdigest()]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[0] != conv:
                    if state:
                        yield send()
                    conv, state = row[0], [[0] * len(COUNTS), [], hashlib.sha256(), False]
                state[0] = [a + b for a, b in zip(state[0], row[2:8])]
                state[1].append(row[8].encode())
                if row[10]:
                    state[2].update((("\n" if state[3] else "") + row[9]).encode())
                    state[3] = True
        if state:
            yield send()

    several = repairs.filter("parts > 1").select("conv_id", "part", *COUNTS, "audit", lines.alias("lines"), (F.size("turns") > 0).alias("any"))
    several = several.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(work, schema)
    return single.unionByName(several)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = materialize(digests(repair(damage(rows))), "repaired")
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(done, ids["id"].eqNullSafe(done["conv_id"]), "left")
    return found.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": (op11_conversation_repair, None)}
