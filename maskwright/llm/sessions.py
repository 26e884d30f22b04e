"""Sessions of events that arrive in batches, late ones too, as a log of versions.

After each batch the events a user has so far form sessions: neighbours in time at most `gap` apart share one. A session
that holds an event of the batch is a new version; it retracts the standing sessions that went into it.

Everything is built-in expressions, and no group grows with the number of events:

* events of one user, batch and moment are summed before the first shuffle, so a user with a third of all rows is a row a
  moment and task;
* the moments of a user's batch become fragments, runs without a larger gap. They are never parted later, and there are at
  most as many as gaps fit into the time that a batch spans;
* a user's fragments are cut into islands where the whole input leaves a larger gap: no session ever crosses one;
* the sorted batches of an island are folded: an array of standing sessions is filtered and transformed batch by batch,
  and each session goes to the log when it is retracted, or at the end.

Events without a user, batch or moment take no part. Repeated rows are events of their own; moments may be negative and of
any scale that fits in a long; an empty table gives an empty log; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import bound
from .common import table

GAP = 420
FRAGMENT = "struct<start_s:bigint,end_s:bigint,n:bigint,h:bigint>"
SESSION = "struct<batch:bigint,start_s:bigint,end_s:bigint,n_events:bigint,n_new:bigint,n_retracted:bigint,h_sum:bigint>"
VERSION = SESSION[:-1] + ",retracted_batch:bigint,retracted_start_s:bigint>"


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def _fragments(moments: Column, gap: int) -> Column:
    """Sorted moments (second, n, h) as array<FRAGMENT>: the places where a run begins, and what lies between two of them."""
    after = lambda i: (i == 0) | (F.get(moments, i)["second"] - F.get(moments, i - 1)["second"] > gap)
    heads = F.filter(F.sequence(F.lit(0), F.size(moments) - 1), after)
    total = lambda run, name: F.aggregate(run, F.lit(0).cast("long"), lambda acc, m: acc + m[name])

    def one(run):
        return F.struct(F.get(run, 0)["second"].alias("start_s"), _last(run)["second"].alias("end_s"), total(run, "n").alias("n"), total(run, "h").alias("h"))

    def cut(found):
        ends = F.concat(F.slice(found, 2, F.size(found)), F.array(F.size(moments)))
        return F.transform(F.zip_with(found, ends, lambda a, b: F.slice(moments, a + 1, b - a)), one)

    return bound(heads, cut)


def _merged(pieces: Column, batch: Column, gap: int) -> Column:
    """Sorted pieces (SESSION) as sessions of a batch. Pieces near each other become one."""

    def joined(a, b):
        added = {name: (a[name] + b[name]).alias(name) for name in ("n_events", "n_new", "n_retracted", "h_sum")}
        return F.struct(a["batch"].alias("batch"), a["start_s"].alias("start_s"), F.greatest(a["end_s"], b["end_s"]).alias("end_s"), *added.values())

    def step(acc, piece):
        piece = piece.withField("batch", batch)
        near = (F.size(acc) > 0) & (piece["start_s"] - _last(acc)["end_s"] <= gap)
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined(_last(acc), piece)))).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(pieces, _nothing(SESSION), step)


def _version(session: Column, batch: Column, start: Column) -> Column:
    own = [session[name].alias(name) for name in ("batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum")]
    return F.struct(*own, batch.cast("long").alias("retracted_batch"), start.cast("long").alias("retracted_start_s"))


def _log(batches: Column, gap: int) -> Column:
    """array<VERSION> of the sorted batches (batch, fragments) of an island."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(state, b):
        near = lambda s: F.exists(b["fragments"], lambda f: (f["start_s"] - s["end_s"] <= gap) & (s["start_s"] - f["end_s"] <= gap))
        touched, rest = F.filter(state["standing"], near), F.filter(state["standing"], lambda s: ~near(s))
        old = F.transform(touched, lambda s: F.struct(s["start_s"].alias("start_s"), s["batch"].alias("batch"), s["end_s"].alias("end_s"), s["n_events"].alias("n_events"), zero.alias("n_new"), one.alias("n_retracted"), s["h_sum"].alias("h_sum")))
        new = F.transform(b["fragments"], lambda f: F.struct(f["start_s"].alias("start_s"), b["batch"].alias("batch"), f["end_s"].alias("end_s"), f["n"].alias("n_events"), f["n"].alias("n_new"), zero.alias("n_retracted"), f["h"].alias("h_sum")))
        pieces = F.transform(F.array_sort(F.concat(old, new)), lambda p: F.struct(*[p[name].alias(name) for name in ("batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum")]))

        def after(fresh):
            home = lambda s: F.get(F.filter(fresh, lambda m: (m["start_s"] <= s["start_s"]) & (s["end_s"] <= m["end_s"])), 0)
            gone = F.transform(touched, lambda s: _version(s, b["batch"], home(s)["start_s"]))
            return F.struct(F.concat(rest, fresh).alias("standing"), F.concat(state["log"], F.array(gone)).alias("log"))

        return bound(_merged(pieces, b["batch"], gap), after)

    start = F.struct(_nothing(SESSION).alias("standing"), F.array().cast(f"array<array<{VERSION}>>").alias("log"))
    none = F.lit(None)
    return F.aggregate(batches, start, step, lambda state: F.concat(F.flatten(state["log"]), F.transform(state["standing"], lambda s: _version(s, none, none))))


def session_versions(events: DataFrame, gap: int = GAP, user_col: str = "user", batch_col: str = "batch", second_col: str = "second", value_col: str = "h") -> DataFrame:
    """user and VERSION of every version of every session. h_sum adds up value_col; nulls count as 0."""
    rows = events.select(F.col(user_col).alias("user"), F.col(batch_col).cast("long").alias("batch"), F.col(second_col).cast("long").alias("second"), F.coalesce(F.col(value_col), F.lit(0)).cast("long").alias("h"))
    rows = rows.where("user IS NOT NULL AND batch IS NOT NULL AND second IS NOT NULL")
    moments = rows.groupBy("user", "batch", "second").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    arrays = moments.groupBy("user", "batch").agg(F.array_sort(F.collect_list(F.struct("second", "n", "h"))).alias("moments"))
    fragments = arrays.select("user", "batch", F.inline(_fragments(F.col("moments"), gap)))
    # All that follows is dealt by user: the window, both groupings and the fold share one shuffle.
    by_start = Window.partitionBy("user").orderBy("start_s", "end_s", "batch")
    reach = F.max("end_s").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = fragments.withColumn("apart", (F.coalesce(F.col("start_s") - reach > gap, F.lit(False))).cast("long"))
    islands = apart.withColumn("island", F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    batches = islands.groupBy("user", "island", "batch").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "n", "h"))).alias("fragments"))
    folded = batches.groupBy("user", "island").agg(F.array_sort(F.collect_list(F.struct("batch", "fragments"))).alias("batches"))
    return folded.select("user", F.inline(_log(F.col("batches"), gap)))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """user, batch, second, h of each turn. Turns without a conversation, and times that don't fit in a long, give no event."""
    crc = lambda text: F.crc32(text.cast("binary"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = conversations.where("turn IS NOT NULL AND conv_id IS NOT NULL")
    rows = rows.select(conv.alias("conv"), turn.alias("turn"), crc(conv.cast("string")).alias("c"), crc(F.concat_ws(":", conv.cast("string"), turn.cast("string"))).alias("h"))
    offset = F.expr("(c div 2) % 7200 + h % 600")
    second = F.try_add(F.try_multiply(F.lit(300).cast("long"), F.col("turn")), offset)
    rows = rows.select(F.expr("2 * shiftright(conv, 3) + c % 2").alias("user"), second.alias("second"), "h", F.expr("h div 600").alias("g"))
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return rows.select("user", (F.expr("(second - pmod(second, 3600)) div 3600") + late).alias("batch"), "second", "h")


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_versions(conversation_events(table(spark, sf_dir, "conversations")))


#: Every state after every batch is made anew from all events so far; nothing is folded.
OP12_SQL = """
WITH crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
named AS (
  SELECT conv_id, turn, string_split(conv_id::VARCHAR, '') AS a, string_split(conv_id::VARCHAR || ':' || turn::VARCHAR, '') AS b
  FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, turn,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(a, lambda ch: ascii(ch)::BIGINT)), lambda c, ch: xor(c // 256, crc[xor(c % 256, ch) + 1]))) AS c,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda ch: ascii(ch)::BIGINT)), lambda c, ch: xor(c // 256, crc[xor(c % 256, ch) + 1]))) AS h
  FROM named, crcs),
timed AS (
  SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS "user", (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM hashed),
event AS (
  SELECT "user", floor(s / 3600)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch, s, h FROM timed),
seen AS (
  SELECT e."user", b.batch, e.batch AS own, e.s, e.h,
    CASE WHEN e.s - lag(e.s) OVER (PARTITION BY e."user", b.batch ORDER BY e.s) <= 420 THEN 0 ELSE 1 END AS apart
  FROM event e JOIN (SELECT DISTINCT "user", batch FROM event) b ON e."user" = b."user" AND e.batch <= b.batch),
placed AS (
  SELECT *, sum(apart) OVER (PARTITION BY "user", batch ORDER BY s, apart DESC ROWS UNBOUNDED PRECEDING) AS k FROM seen),
version AS (
  SELECT "user", batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (own = batch) AS n_new, sum(h)::BIGINT AS h_sum
  FROM placed GROUP BY "user", batch, k HAVING count(*) FILTER (own = batch) > 0),
ended AS (
  SELECT v.*, w.batch AS retracted_batch, w.start_s AS retracted_start_s
  FROM version v LEFT JOIN version w ON v."user" = w."user" AND w.batch > v.batch AND w.start_s <= v.start_s AND v.end_s <= w.end_s
  QUALIFY row_number() OVER (PARTITION BY v."user", v.batch, v.start_s ORDER BY w.batch) = 1)
SELECT v."user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new,
  (SELECT count(*) FROM ended x WHERE x."user" = v."user" AND x.retracted_batch = v.batch AND x.retracted_start_s = v.start_s) AS n_retracted,
  v.h_sum, v.retracted_batch, v.retracted_start_s
FROM ended v
"""
