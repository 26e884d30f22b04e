"""Evaluation: what was missed, and what was found in clean text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import at_least, spans

#: Shapes of our own stand-ins, by a part of the rule's id.
KNOWN_FAKES = (
    ("email", r"@example\.(com|org|net)$"),
    ("ipv4", r"^(192\.0\.2|198\.51\.100|203\.0\.113)\."),
    ("ssn", r"^(9[0-9]{2}|000)-"),
    ("jwt", r"^eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9\."),
)


def known_fake(rule_id: Column, raw: Column) -> Column:
    """Whether raw looks like one of our stand-ins for the rule."""
    out = F.lit(False)
    for part, shape in KNOWN_FAKES:
        out = out | (F.contains(rule_id, F.lit(part)) & raw.rlike(shape))
    return out


def found_against_caught(found: DataFrame, caught: DataFrame, entries: DataFrame) -> DataFrame:
    """Per entry (entry_id): matches of a re-scan, recorded redactions and misses. Null records count as 0."""
    n = found.groupBy("entry_id").agg(F.count(F.lit(1)).alias("found"))
    return (
        entries.join(n, "entry_id", "left").join(caught, "entry_id", "left")
        .select("entry_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("caught", F.lit(0)).alias("caught"))
        .withColumn("missed", F.greatest(F.col("found") - F.col("caught"), F.lit(0)))
    )


def missed_totals(per_entry: DataFrame) -> DataFrame:
    return per_entry.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("found").alias("found"), F.sum("caught").alias("caught"), F.sum("missed").alias("missed"),
        F.count_if(F.col("missed") > 0).alias("entries_with_misses"), F.round(100.0 * F.sum("missed") / F.greatest(F.sum("found"), F.lit(1)), 4).alias("miss_pct"),
    )


def top_missed(found: DataFrame, per_entry: DataFrame, severities: DataFrame, least: str = "low", limit: int = 20) -> DataFrame:
    """Rules by how often they match in entries with misses, of at least a severity."""
    bad = per_entry.where("missed > 0").select("entry_id")
    kept = found.join(bad, "entry_id", "left_semi").join(F.broadcast(severities), "rule_id").where(at_least(F.col("severity"), least))
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "rule_id").limit(limit)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("count"))


def false_positive_matrix(clean: DataFrame, rules, id_col: str, text_col: str = "text") -> DataFrame:
    """(rule_id, sample_id, hits) of every pair of a rule and a clean text: one pass, a column for each rule."""
    each = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.size(spans(F.col(text_col), r.regex)).cast("long").alias("hits")) for r in rules])
    return clean.select(F.col(id_col).alias("sample_id"), F.inline(each)).select("rule_id", "sample_id", "hits")


def false_positive_rates(matrix: DataFrame) -> DataFrame:
    """Per rule: pairs, pairs with a match, rate and matches."""
    return matrix.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("hits") > 0).alias("positive_pairs"), F.sum("hits").alias("hits")
    ).withColumn("rate", F.round(F.col("positive_pairs") / F.col("pairs"), 6))


def fixture_verdicts(fixtures: DataFrame, rules: DataFrame) -> DataFrame:
    """fixtures (rule_id, polarity, text) with matched and passed: a positive text must have a match of its rule, a negative one none.

    rules (id, regex) is a rule table, a dimension of hundreds of rows, and is broadcast; each pattern is compiled once a worker, whatever the order of the
    pairs, so nothing is shuffled and a rule may have any share of them. Fixtures of unknown rules don't pass; a null text is empty.
    """
    import pyarrow as pa

    from ..functions.arrow import bounded_batches, slices
    from .matcher import compiled_once

    known = F.broadcast(rules.select(F.col("id").alias("rule_id"), F.col("regex").alias("_regex")))
    rows = fixtures.select("rule_id", "polarity", "text").join(known, "rule_id", "left")

    def run(batches):
        for part in slices(batches, ["text"]):
            found = [None if p is None else compiled_once(p).search(t or "") is not None for p, t in zip(part.column("_regex").to_pylist(), part.column("text").to_pylist())]
            columns = [part.column(c) for c in ("rule_id", "polarity", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.bool_())], names=["rule_id", "polarity", "text", "matched"])

    bounded_batches(rows.sparkSession)
    out = rows.mapInArrow(run, "rule_id string, polarity string, text string, matched boolean")
    return out.withColumn("passed", F.coalesce(F.col("matched") == (F.col("polarity") == "pos"), F.lit(False)))


def fixture_totals(verdicts: DataFrame) -> DataFrame:
    """Per rule and polarity: fixtures, and those that fail."""
    return verdicts.groupBy("rule_id", "polarity").agg(F.count(F.lit(1)).alias("fixtures"), F.count_if(~F.col("passed")).alias("failed"))
