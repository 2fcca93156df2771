"""Findings: normalise, fingerprint, first-wins dedup, rank and summarise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import clean_tags, fingerprint, trimmed
from codesift.schema import RULE_IDS, rule_catalogue

VERDICT_RANK = {"confirmed": 3, "needs_validation": 2, "hardening": 1}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}

# Fields added by a custom pack, and what they default to.
OPTIONAL = {"severity": "string", "tags": "array<string>", "blocker": "string"}


def union_packs(packs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packs)


def describe(raw: DataFrame, own_rules: list[tuple] = []) -> DataFrame:
    """Join the rule catalogue to raw findings: 58 fixed rows, and those of own packs."""
    rules = rule_catalogue(raw.sparkSession, own_rules).withColumnsRenamed(
        {"analyzer": "rule_analyzer", "verdict": "rule_verdict", "confidence": "rule_confidence", "blocker": "rule_blocker"}
    )
    out = raw.join(F.broadcast(rules), ["rule_id", "variant"])
    verdict = F.coalesce("verdict", "rule_verdict")
    softened = (F.col("rule_verdict") != "hardening") & (verdict == "hardening")
    return out.withColumns({
        "verdict": verdict,
        "confidence": F.coalesce("confidence", "rule_confidence"),
        "blocker": F.when(softened, F.lit("")).otherwise(F.coalesce("blocker", "rule_blocker")),
    }).drop("rule_analyzer", "rule_verdict", "rule_confidence", "rule_blocker")


def normalize(found: DataFrame) -> DataFrame:
    """Trim texts, default the confidence, clear severities that are not earned,
    clean the tags and add the fingerprint where it is missing."""
    have = set(found.columns)
    out = found.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in have})
    texts = [c for c in ("rule_id", "analyzer", "attack_class", "title", "description", "path", "evidence",
                         "remediation", "blocker") if c in out.columns]
    out = out.withColumns({c: trimmed(F.col(c)) for c in texts})
    own = fingerprint(F.col("rule_id"), F.col("path"), F.col("evidence"))
    kept = F.when(F.col("fingerprint") != "", F.col("fingerprint")) if "fingerprint" in have else F.lit(None)
    return out.withColumns({
        "fingerprint": F.coalesce(kept, own),
        # Catalogue rules take their confidence from the catalogue (see ``describe``).
        "confidence": F.coalesce(
            F.when(F.col("confidence") != "", F.col("confidence")), F.when(~F.col("rule_id").isin(RULE_IDS), F.lit("medium"))
        ),
        "severity": F.when(F.col("verdict") == "confirmed", F.col("severity")),
        "tags": clean_tags(F.col("tags")),
    })


def first_wins(found: DataFrame) -> DataFrame:
    """Keep the first finding per (repo, fingerprint) across all analyzers.

    A minimum over an ordered struct instead of a window: it combines map-side,
    so a fingerprint repeated in a third of all rows shrinks to one row per task
    before the shuffle.
    """
    order = ["analyzer", "path", "phase", "pos", "rule_no"]
    rest = [c for c in found.columns if c not in ("repo", "fingerprint", *order)]
    best = found.groupBy("repo", "fingerprint").agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select("repo", "fingerprint", "best.*")


def rank_of(col: Column, ranks: dict[str, int]) -> Column:
    pairs = [F.lit(x) for pair in ranks.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(0))


def order_of_findings() -> list[Column]:
    return [
        rank_of(F.col("verdict"), VERDICT_RANK).desc(), rank_of(F.col("severity"), SEVERITY_RANK).desc(),
        F.col("path"), F.col("line"), F.col("rule_id"), F.col("analyzer"), F.col("phase"), F.col("pos"), F.col("rule_no"),
    ]


def ranked(found: DataFrame, within_repo: bool = True) -> DataFrame:
    """Report order.  A range-partitioned sort, so no repo lands in one task."""
    return found.orderBy(*(["repo"] if within_repo else []), *order_of_findings())


def summarize(found: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Counts per repo: total, per verdict, and per severity among confirmed; of all
    ``repos`` if given, else of those with findings."""
    verdict, confirmed = F.col("verdict"), F.col("verdict") == "confirmed"
    counts = [F.count_if(verdict == v).alias(v) for v in VERDICT_RANK]
    levels = [F.count_if(confirmed & (F.col("severity") == s)).alias(f"severity_{s}") for s in SEVERITY_RANK]
    out = found.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), *counts, *levels)
    return out if repos is None else repos.join(out, "repo", "left").na.fill(0)


def by_severity(summary: DataFrame) -> DataFrame:
    """Fold the severity counters into one map without zero entries."""
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"severity_{s}").alias("value")) for s in SEVERITY_RANK])
    present = F.map_filter(F.map_from_entries(entries), lambda _, n: n > 0)
    return summary.withColumn("by_severity", present).drop(*[f"severity_{s}" for s in SEVERITY_RANK])


def accepted(found: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """Unique findings credited to each analyzer; of all that ``ran`` on a repo if given,
    with 0 for those that found nothing new."""
    counts = found.groupBy("repo", "analyzer").agg(F.count(F.lit(1)).alias("accepted"))
    if ran is None:
        return counts
    return ran.select("repo", "analyzer").join(counts, ["repo", "analyzer"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)).cast("bigint"))


def findings(packs: list[DataFrame], own_rules: list[tuple] = []) -> DataFrame:
    """Raw findings of several packs → described, normalised, deduplicated."""
    return describe(first_wins(normalize(attach_analyzer(union_packs(packs)))), own_rules)


def attach_analyzer(raw: DataFrame) -> DataFrame:
    """The analyzer follows from the rule id, before the wide texts are joined."""
    rule = F.col("rule_id")
    known = F.when(rule.startswith("GO"), F.lit("go")).when(rule.startswith("JS"), F.lit("javascript-typescript")).otherwise(F.lit("generic"))
    return raw.withColumn("analyzer", F.coalesce(F.col("analyzer"), known) if "analyzer" in raw.columns else known)
