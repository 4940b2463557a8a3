"""Repair of conversation structure at least cost (operator 13).

The roles of a repaired conversation read ``(s?(ua)+)?``: nothing, or an optional system turn
and then user and assistant in turns. Rows are kept, given another role or deleted, and turns
without text are inserted; the cheapest edits are found by a dynamic programme over the
grammar's states.

1. Rows are numbered over ranges of turns, faults are marked by partial aggregates, and every
   conversation is cut into segments of ``SEGMENT`` rows, so one of any length is many groups.
2. Segments are dealt by hash into batches of about ``BATCH_ROWS`` rows. In a batch a recursive
   query of DuckDB advances all segments by one turn in each recursion, keeping the least cost
   and audit for each state; a segment that isn't the first starts from every state.
3. Segments of long conversations are joined in pairs, round by round, on the state between
   them. Equal costs after equal rows imply that no audit is the beginning of another, so the
   least of the parts gives the least of the whole.
4. Chosen edits go back to the rows of their segment; segments' texts are hashed in order.

Defined results: nulls become one space (in ``conv_id:turn`` too); rows with null conv_id are
one conversation; null turns come first, equal turns go by role and text; an empty role has no
initial, so such a row is never kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import column_or_null, crc32_of, crc32_sql, joined_sha256, running_sums, spread_join, table, through_files

#: Rows of a segment, which bounds the recursions of a batch.
SEGMENT = 64
#: Rows of a batch, about.
BATCH_ROWS = 20_000
BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
COSTS = {"keep": 0, "rerole": 2, "delete": 3, "insert": 2, "truncated": 1}
START, SYSTEM, USER, ASSISTANT = range(4)

# An edit is one letter of ``made``: k keep, d delete, U and A rerole, u and a insert. Inserts come before the edit of a row.
_INSERTS = {START: {START: "", USER: "u", ASSISTANT: "ua"}, SYSTEM: {SYSTEM: "", USER: "u", ASSISTANT: "ua"}, USER: {USER: "", ASSISTANT: "a"}, ASSISTANT: {ASSISTANT: "", USER: "u"}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What ends a conversation from each state.
CLOSING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
_AUDIT = str.maketrans("kdUAua", "KDRRII")


def moves() -> list[tuple[int, str | None, str, int, int, bool]]:
    """state, initial (null: any), made, next state, cost, whether the row stays: inserts and the edit of one row."""
    out = []
    for state, ways in _INSERTS.items():
        for at, made in ways.items():
            cost, then = len(made) * COSTS["insert"], _NEXT[at]
            out.append((state, None, made + "d", at, cost + COSTS["delete"], False))
            out.append((state, None, made + ("U" if then == USER else "A"), then, cost + COSTS["rerole"], True))
            out.append((state, "u" if then == USER else "a", made + "k", then, cost + COSTS["keep"], True))
            if at == START:
                out.append((state, "s", made + "k", SYSTEM, cost + COSTS["keep"], True))
    return out


def _walk_sql() -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()
    rows = ", ".join(f"({', '.join(map(quoted, (s, i, m, t, c, stays, m.translate(_AUDIT))))})" for s, i, m, t, c, stays in moves())
    return f"""WITH RECURSIVE moves(state, initial, made, target, cost, stays, audit) AS (VALUES {rows}),
    walk(conv, seg, entry, k, state, best) AS (
      SELECT DISTINCT conv, seg, e, 0, e, {{'cost': 0::BIGINT, 'audit': '', 'made': ''}} FROM part, range(4) r(e) WHERE seg > 0 OR e = {START}
      UNION ALL
      SELECT w.conv, w.seg, w.entry, p.k, m.target, min({{'cost': w.best.cost + m.cost + (m.stays AND p.fault = {TRUNCATED})::INT * {COSTS["truncated"]}, 'audit': w.best.audit || m.audit, 'made': w.best.made || m.made}})
      FROM walk w JOIN part p ON p.conv = w.conv AND p.seg = w.seg AND p.k = w.k + 1
      JOIN moves m ON m.state = w.state AND (m.initial IS NULL OR m.initial = p.initial) AND (NOT m.stays OR p.fault NOT IN ({BLANK}, {DUPLICATE}))
      GROUP BY w.conv, w.seg, w.entry, p.k, m.target
    )
    SELECT conv, seg, entry::INT AS entry, state::INT AS state, best.cost AS cost, best.audit AS audit, best.made AS made
    FROM walk JOIN (SELECT conv, seg, max(k) AS k FROM part GROUP BY ALL) USING (conv, seg, k)"""


WALK = _walk_sql()
_WALKED = "conv string, seg long, entry int, state int, cost long, audit string, made string"


def walk(part: pa.Table) -> pa.Table:
    """Least cost, audit and edits of every segment of ``part(conv, seg, k, initial, fault)`` from each state to each state."""
    import duckdb  # only in the workers: the driver needs none of it

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    try:
        con.register("part", part)
        found = con.execute(WALK).to_arrow_table()
    finally:
        con.close()
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return found.cast(pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _WALKED.split(", ")]))


def _plain(conversations: DataFrame) -> DataFrame:
    """``conv`` (conv_id as text, one space for null), turn, role, text."""
    text = lambda c: F.coalesce(column_or_null(conversations, c, "string"), F.lit(" ")).alias(c)
    conv = F.coalesce(column_or_null(conversations, "conv_id", "long").cast("string"), F.lit(" ")).alias("conv")
    return conversations.select(conv, column_or_null(conversations, "turn", "long"), text("role"), text("text"))


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text) after damage by crc32(conv:turn) % 20."""
    k = crc32_of(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.withColumn("k", k).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).select("conv", "turn", "role", "text")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """rows with pos (from 1) in their conversation, initial, whether blank or truncated, and a digest of role and text."""
    placed = running_sums(rows.withColumn("one", F.lit(1)), ["conv"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], {"before": "one"}, "repair-order")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    digest = F.xxhash64("role", "text"), F.crc32(F.concat("text", F.lit(":"), "role").cast("binary"))
    return through_files(placed.select("conv", "turn", "role", "text", (F.col("before") + 1).alias("pos"), F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), digest[0].alias("d1"), digest[1].alias("d2")), "repair-rows")


def _faults(rows: DataFrame) -> DataFrame:
    """conv, seg, pos, initial, fault (0: none), context: rows in their segments, and the last row of each segment also in the next one."""
    first = rows.groupBy("conv", "d1", "d2").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    slim = rows.select("conv", "pos", "initial", "blank", "cut").join(first, ["conv", "pos"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    own = F.expr(f"(pos - 1) div {SEGMENT}")
    places = F.when(F.col("pos") % SEGMENT == 0, F.array(own, own + 1)).otherwise(F.array(own))
    return slim.select("conv", F.posexplode(places).alias("context", "seg"), "pos", "initial", fault.alias("fault"))


def _joined(a: Column, b: Column, with_path: bool) -> Column:
    fields = [(a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["made"], b["made"]).alias("made")]
    return F.struct(*fields, *([F.concat(a["path"], b["path"]).alias("path")] if with_path else []))


def _combined(walks: DataFrame, longest: int) -> DataFrame:
    """conv, state, best(cost, audit, made, path) of whole conversations; path has the state after each segment."""
    best = F.struct("cost", "audit", "made", F.col("state").cast("string").alias("path")).alias("best")
    held = walks.select("conv", "seg", "entry", "state", best)
    while longest > 1:
        left = held.where("seg % 2 = 0").withColumn("pair", F.expr("seg div 2"))
        right = held.where("seg % 2 = 1").select("conv", F.expr("seg div 2").alias("pair"), F.col("entry").alias("state"), F.col("state").alias("end"), F.col("best").alias("after"))
        both = left.join(right, ["conv", "pair", "state"]).groupBy("conv", "pair", "entry", "end").agg(F.min(_joined(F.col("best"), F.col("after"), True)).alias("best"))
        both = both.select("conv", F.col("pair").alias("seg"), "entry", F.col("end").alias("state"), "best")
        alone = left.join(right.select("conv", "pair").distinct(), ["conv", "pair"], "left_anti").select("conv", F.col("pair").alias("seg"), "entry", "state", "best")
        held, longest = through_files(both.unionByName(alone), "repair-pairs"), (longest + 1) // 2
    return held.select("conv", "state", "best")


def _lines(inserted: Column) -> Column:
    """Text of inserted turns, a newline before each."""
    return F.array_join(F.transform(F.split(inserted, ""), lambda c: F.when(c == "u", "\nuser:").when(c == "a", "\nassistant:").otherwise("")), "")


def repair(conversations: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation of ``conversations(conv_id, turn, role, text)``, which are taken as they are."""
    return _repaired(_plain(conversations), _plain(conversations), batch_rows)


def repair_damaged(conversations: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The same after ``damage``; conversations that lose all rows stay."""
    return _repaired(_plain(conversations), damage(_plain(conversations)), batch_rows)


def _repaired(every: DataFrame, rows: DataFrame, batch_rows: int) -> DataFrame:
    rows = numbered_rows(rows)
    turns = rows.groupBy("conv").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
    turns = through_files(turns.select("conv", "n", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")), "repair-turns")
    faults = through_files(_faults(rows), "repair-faults")
    own = F.col("context") == 0
    before = F.lag("initial").over(Window.partitionBy("conv", "seg").orderBy("pos"))
    illegal = own & before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")
    counted = faults.withColumn("illegal", illegal)
    tally = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = counted.groupBy("conv").agg(*(tally(own & (F.col("fault") == f)).alias(c) for f, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))), tally(F.col("illegal")).alias("illegal"))

    facts = turns.agg(F.sum("n").alias("n"), F.max("n").alias("longest")).first()
    total = facts["n"] or 0
    batches = max(1, -(-total // batch_rows))
    part = faults.where(own).select(F.pmod(F.xxhash64("conv", "seg"), F.lit(batches)).alias("batch"), "conv", "seg", (F.col("pos") - F.col("seg") * SEGMENT).alias("k"), "initial", "fault")
    walks = through_files(part.groupBy("batch").applyInArrow(walk, _WALKED), "repair-walks")
    segments = F.ceil(F.col("n") / SEGMENT)
    many = turns.where(segments > 1).select("conv", "n")
    long_ = through_files(spread_join(walks, many, ["conv"], "n"), "repair-long").drop("n") if (facts["longest"] or 0) > SEGMENT else None
    short = walks.join(turns.where(segments == 1).select("conv"), "conv", "left_semi") if long_ is not None else walks
    best = F.struct("cost", "audit", "made", F.lit("").alias("path")).alias("best")
    whole = short.select("conv", "state", best)
    if long_ is not None:
        whole = whole.unionByName(_combined(long_, -(-facts["longest"] // SEGMENT)))
    rows_of = lambda make: F.create_map(*(x for s, made in CLOSING.items() for x in (F.lit(s), F.lit(make(made)))))[F.col("state")]
    end = F.struct((F.col("best.cost") + rows_of(lambda m: len(m) * COSTS["insert"])).alias("cost"), F.concat("best.audit", rows_of(lambda m: m.translate(_AUDIT))).alias("audit"), F.col("best.made").alias("made"), F.col("best.path").alias("path"), rows_of(str).alias("tail"))
    chosen = through_files(whole.groupBy("conv").agg(F.min(end).alias("end")).select("conv", "end.*"), "repair-chosen")

    pieces = chosen.where("path = ''").select("conv", F.lit(0).cast("long").alias("seg"), F.lit(1).cast("long").alias("parts"), "made", "tail")
    if long_ is not None:
        steps = chosen.where("path <> ''").select("conv", "path", "tail", F.length("path").cast("long").alias("parts"), F.posexplode(F.split("path", "")).alias("seg", "state")).where("state <> ''")
        entry = F.when(F.col("seg") == 0, START).otherwise(F.substring(F.col("path"), F.col("seg"), F.lit(1)).cast("int"))
        steps = steps.select("conv", F.col("seg").cast("long"), entry.alias("entry"), F.col("state").cast("int").alias("state"), "parts", F.when(F.col("seg") == F.col("parts") - 1, F.col("tail")).otherwise("").alias("tail"))
        pieces = pieces.unionByName(steps.join(long_, ["conv", "seg", "entry", "state"]).select("conv", "seg", "parts", "made", "tail"))
    placed = rows.select("conv", F.expr(f"(pos - 1) div {SEGMENT}").alias("seg"), "pos", "role", "text").join(through_files(pieces, "repair-pieces"), ["conv", "seg"])
    edit = F.element_at(F.regexp_extract_all("made", F.lit("([ua]*[kdUA])")), (F.col("pos") - F.col("seg") * SEGMENT).cast("int"))
    kind = F.right(edit, F.lit(1))
    line = F.when(kind == "k", F.concat(F.lit("\n"), "role", F.lit(":"), "text")).when(kind == "U", F.concat(F.lit("\nuser:"), "text")).when(kind == "A", F.concat(F.lit("\nassistant:"), "text")).otherwise("")
    placed = placed.select("conv", "seg", "parts", "tail", "pos", F.concat(_lines(F.regexp_extract(edit, "^[ua]*", 0)), line).alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "")
    texts = placed.groupBy("conv", "seg", "parts", "tail").agg(text.alias("piece")).withColumn("piece", F.concat("piece", _lines(F.col("tail"))))
    hashes = joined_sha256(texts, "conv", "seg", "piece", "parts").withColumnRenamed("sha256", "repaired_sha256")

    out = every.select("conv").distinct().join(turns.drop("n"), "conv", "left").join(counts, "conv", "left").join(chosen.select("conv", "cost", "audit"), "conv", "left").join(hashes, "conv", "left")
    numbers = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


# The oracle takes an insertion as a step of its own: in a recursion a state reads its next row or inserts a turn; the best ways are taken by a window.
SQL = f"""WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations
), dmg AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw WHERE k <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM raw WHERE k = 3
), pos AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS ini FROM dmg
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(ini) OVER (PARTITION BY c ORDER BY pos) || ini AS two, count(*) OVER (PARTITION BY c) AS n FROM pos
), w(c, k, st, cost, audit, made, inserts) AS (
  SELECT DISTINCT c, 0::BIGINT, '', 0, '', '', 0 FROM f
  UNION ALL
  SELECT c, k, st, cost, audit, made, inserts FROM (
    SELECT c, k, st, cost, audit, made, inserts, row_number() OVER (PARTITION BY c, k, st, inserts ORDER BY cost, audit) AS best FROM (
      SELECT w.c, w.k, CASE WHEN st = 'u' THEN 'a' ELSE 'u' END AS st, cost + 2 AS cost, audit || 'I' AS audit, made || CASE WHEN st = 'u' THEN 'a' ELSE 'u' END AS made, inserts + 1 AS inserts FROM w WHERE inserts < 2
      UNION ALL
      SELECT w.c, f.pos, CASE e WHEN 'K' THEN ini WHEN 'R' THEN CASE WHEN st = 'u' THEN 'a' ELSE 'u' END ELSE st END,
             cost + CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + (e <> 'D' AND fault = 3)::INT, audit || e, made || CASE e WHEN 'K' THEN 'k' WHEN 'D' THEN 'd' WHEN 'R' THEN CASE WHEN st = 'u' THEN 'A' ELSE 'U' END END, 0
      FROM w JOIN f ON f.c = w.c AND f.pos = w.k + 1, unnest(['K', 'R', 'D']) t(e)
      WHERE e = 'D' OR (fault NOT IN (1, 2) AND (e = 'R' OR st || ini IN ('s', 'u', 'su', 'ua', 'au')))
    )
  ) WHERE best = 1
), fin AS (SELECT w.c, min({{'cost': cost, 'audit': audit, 'made': made}}) AS b FROM w JOIN (SELECT c, max(n) AS n FROM f GROUP BY c) x ON x.c = w.c AND w.k = x.n WHERE st IN ('', 'a') GROUP BY w.c),
tok AS (
  SELECT f.c, f.pos, 0 AS side, regexp_extract_all(b.made, '[ua]*[kdUA]')[pos] AS t, role, text FROM f JOIN fin ON fin.c = f.c
  UNION ALL SELECT c, 1099511627776, 1, regexp_extract(b.made, '[ua]*$'), '', '' FROM fin
), bits AS (SELECT c, pos, i, substr(t, i, 1) AS e, role, text FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM tok)),
rep AS (
  SELECT c, string_agg(CASE e WHEN 'k' THEN role || ':' || text WHEN 'U' THEN 'user:' || text WHEN 'A' THEN 'assistant:' || text WHEN 'u' THEN 'user:' ELSE 'assistant:' END, chr(10) ORDER BY pos, i) AS txt FROM bits WHERE e <> 'd' GROUP BY c
), g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 1)::INT) AS blank, sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated, sum(coalesce(two NOT IN ('su', 'ua', 'au'), false)::INT) AS illegal FROM f GROUP BY c
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(txt, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations) a LEFT JOIN g USING (c) LEFT JOIN fin USING (c) LEFT JOIN rep USING (c)"""
