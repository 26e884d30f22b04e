"""Replacement of spans by stand-ins, restoring, and the dictionary of stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fakes import fake
from ..functions.scalar import bound, pieces
from ..sources.rules import CORE


def with_fakes(found: DataFrame, key: str, rules=CORE, dictionary: DataFrame | None = None, visible: bool = False) -> DataFrame:
    """found (rule_id, raw, ...) with category, subcategory, severity and fake.

    A canonical stand-in that the dictionary has for the original comes before a new one.
    """
    raw, out = F.col("raw"), F.lit(None).cast("string")
    for r in rules:
        out = F.when(F.col("rule_id") == r.id, fake(r.replacement_type, key, raw, r.literal_prefix, visible, r.id)).otherwise(out)
    info = lambda name: F.coalesce(*[F.when(F.col("rule_id") == r.id, F.lit(getattr(r, name))) for r in rules])
    made = found.select("*", *[info(n).alias(n) for n in ("category", "subcategory", "severity")], out.alias("fake"))
    if dictionary is None:
        return made
    known = canonical(dictionary).select(F.col("original").alias("raw"), F.col("fake").alias("known_fake"))
    return made.join(known, "raw", "left").withColumn("fake", F.coalesce("known_fake", "fake")).drop("known_fake")


def splice(text: Column, spans: Column) -> Column:
    """text with disjoint spans (start, end, fake), sorted, replaced from left to right.

    A place in a text is found by counting from its start. So the text is cut once for each piece of spans, and the gaps between
    them from that cut.
    """

    def replaced(part, base):
        def inside(cut):
            before = lambda i: F.when(i == 0, base).otherwise(F.get(part, i - 1)["end"])
            return F.array_join(F.transform(part, lambda s, i: F.concat(F.substr(cut, before(i) - base + 1, s["start"] - before(i)), s["fake"])), "")

        return bound(F.substr(text, base + 1, F.get(part, F.size(part) - 1)["end"] - base), inside)

    def joined(parts):
        base = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(F.get(parts, k - 1), -1)["end"])
        done = F.transform(parts, lambda part, k: bound(base(k), lambda at: replaced(part, at)))
        return F.concat(F.array_join(done, ""), F.substr(text, F.element_at(F.element_at(parts, -1), -1)["end"] + 1))

    return F.when(F.size(spans) > 0, bound(pieces(spans), joined)).otherwise(text)


def rewrite(docs: DataFrame, redactions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs(id, text) with new_text and n_redacted; texts without spans stay as they are.

    Only the spans are grouped and travel once; documents without spans never enter the aggregate.
    """
    grouped = redactions.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "fake"))).alias("_spans"))
    joined = docs.join(grouped, docs[id_col] == F.col("_id"), "left")
    new = F.when(F.col("_spans").isNotNull(), splice(F.col(text_col), F.col("_spans"))).otherwise(F.col(text_col))
    return joined.withColumn("new_text", new).withColumn("n_redacted", F.coalesce(F.size("_spans"), F.lit(0))).drop("_id", "_spans")


def restore(text: Column, pairs: Column) -> Column:
    """text with each stand-in of pairs (array of fake, original) replaced, longest stand-in first; empty ones are skipped."""
    usable = F.filter(pairs, lambda p: F.coalesce(F.length(p["fake"]), F.lit(0)) > 0)
    ordered = F.array_sort(usable, lambda a, b: F.when(F.length(a["fake"]) != F.length(b["fake"]), F.length(b["fake"]) - F.length(a["fake"])).when(a["fake"] < b["fake"], -1).when(a["fake"] > b["fake"], 1).otherwise(0))
    return F.aggregate(ordered, text, lambda t, p: F.when(F.contains(t, p["fake"]), F.replace(t, p["fake"], p["original"])).otherwise(t))


# ---- dictionary --------------------------------------------------------------------------


def canonical(dictionary: DataFrame) -> DataFrame:
    """original -> the stand-in that was written first."""
    return dictionary.groupBy("original").agg(F.min_by("fake", F.struct("created_at", "fake")).alias("fake"))


def upsert(dictionary: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """dictionary(fake, original, created_at, updated_at) after batch(fake, original).

    A stand-in that exists keeps its original and creation time; only updated_at moves.
    """
    first = batch.groupBy("fake").agg(F.min("original").alias("new_original"))
    joined = dictionary.join(first, "fake", "full_outer")
    return joined.select(
        "fake",
        F.coalesce("original", "new_original").alias("original"),
        F.coalesce("created_at", F.lit(now).cast("long")).alias("created_at"),
        F.when(F.col("new_original").isNotNull(), F.greatest(F.coalesce("updated_at", F.lit(0)), F.lit(now)).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def dictionary_of(redactions: DataFrame, now: int) -> DataFrame:
    one = redactions.where("fake <> raw").groupBy("fake").agg(F.min("raw").alias("original"))
    return one.select("fake", "original", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))


def first_of(df: DataFrame, keys, order) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
