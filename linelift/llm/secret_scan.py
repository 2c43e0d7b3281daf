"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger says of
each blob which rule versions it was scanned for and what they found. A scan takes the pairs
of blob and rule version that the ledger lacks, searches each once, and joins old and new
findings back to all paths. Only ids meet the ledger: the texts of blobs that it holds for all rules
are told by a Bloom filter over the ids that still need a scan, before any shuffle. All steps are
Spark SQL functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.llm.common import materialize, need_columns
from linelift.llm.native import bound, free_names, running_sums
from linelift.operators.bloom import may_contain


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has at least
    ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    # A run of its own kind of characters is matched whole, so asking for its length in the
    # pattern finds the same matches as dropping the short ones.
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", "gh[opsru]_[A-Za-z0-9]{36,}"),
    # The header's length is bounded, as the search starts anew at each "eyJ" of a run without a dot.
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,512}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)


def rule_version(rule: Rule) -> str:
    """Names one rule; any change of it makes a new version."""
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


SPANS = "array<struct<rule:string,start:bigint,end:bigint>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (rule, start, end): code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so the running sums of
    their lengths are the positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))

    def sizes(matches: Column) -> Column:
        return F.transform(matches, lambda m: (F.length(m["gap"]) + F.coalesce(
            F.length(m["whole"]), F.lit(0))).cast("bigint"))

    def spans(matches: Column) -> Column:
        return bound(running_sums(sizes(matches)), lambda starts: F.filter(F.transform(
            matches, lambda m, i: F.when(F.length(m["part"]) >= rule.least, F.struct(
                F.lit(rule_version(rule)).alias("rule"),
                (F.get(starts, i) + F.length(m["gap"])).alias("start"),
                (F.get(starts, i) + F.length(m["gap"]) + F.length(m["whole"])).alias("end")))),
            lambda span: span.isNotNull()))

    return F.when(text.rlike(rule.pattern), bound(found, spans)).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (LEDGER) of ``blobs`` (blob, text, rules: the versions to scan for)."""
    wanted = [F.when(F.array_contains("rules", rule_version(r)), _spans(F.col("text"), r))
              .otherwise(F.array().cast(SPANS)) for r in rules]
    return blobs.select("blob", "rules", F.flatten(F.array(*wanted)).alias("spans"))


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules): the versions of ``rules`` that each of ``blobs`` (blob) was not scanned for."""
    every = F.array(*[F.lit(rule_version(r)) for r in rules])
    ids = blobs.select("blob").distinct()
    if ledger is None:
        return ids.withColumn("rules", every)
    known = (ledger.select("blob", F.explode("rules").alias("rule")).distinct()
             .groupBy("blob").agg(F.collect_set("rule").alias("known")))
    return (ids.join(known, "blob", "left")
            .select("blob", F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))
                    .alias("rules")).where(F.size("rules") > 0))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None,
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, spans) for what ``ledger`` lacks of ``versions`` (text, ...): one row
    per blob, for the rule versions that it was not scanned for yet, each searched once.

    The result is written to the shared folder; append it to the stored ledger to keep it. Texts of
    blobs that the ledger knows for all rules are not shuffled, but for the share of less than 1 in
    100 that the filter cannot tell (see ``may_contain``).
    """
    need_columns(versions, "text")
    text = F.coalesce("text", F.lit(""))
    texts = versions.select(_blob(text).alias("blob"), text.alias("text"))
    if ledger is None:
        every = F.array(*[F.lit(rule_version(r)) for r in rules])
        return materialize(scan_blobs(texts.dropDuplicates(["blob"]).withColumn("rules", every), rules), "ledger")
    wanted = materialize(unseen(texts, ledger, rules), "unseen")
    texts = texts.where(may_contain(wanted, "blob")).join(wanted, "blob").dropDuplicates(["blob"])
    return materialize(scan_blobs(texts, rules), "ledger")


def secrets(versions: DataFrame, ledger: DataFrame | None = None,
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of ``versions`` (text, ...): its other columns with blob, n_assign,
    n_access, n_hex, base_sha256 and spans.

    A null text counts as empty. Rows of one text share their findings; repeated rows and
    null ids stay; columns named like the added ones are replaced, all others pass through. An
    empty table gives no rows.
    """
    need_columns(versions, "text")
    base = [r for r in rules if r.base]
    kept = versions.drop("blob", *[f"n_{r.kind}" for r in base], "base_sha256", "spans")
    number = {rule_version(r): i for i, r in enumerate(rules)}
    rows = update_ledger(versions, ledger, rules)
    if ledger is not None:
        rows = rows.select("blob", "spans").unionByName(ledger.select("blob", "spans"))
        rows = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    kind = F.array(*[F.lit(r.kind) for r in rules])
    rank = F.create_map(*[F.lit(v) for pair in number.items() for v in pair])
    ranked = F.array_sort(F.filter(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(rank, s["rule"]).alias("rank"), s["end"].alias("end"))),
        lambda s: s["rank"].isNotNull()))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(rule: Rule):
        return F.filter("ranked", lambda s: s["rank"] == number[rule_version(rule)])

    in_base = F.filter("ranked", lambda s: s["rank"].isin(*[number[rule_version(r)] for r in base]))
    blob, *_ = free_names(kept, "blob")
    found = (rows.select(F.col("blob").alias(blob), ranked.alias("ranked"))
             .select(blob, *[F.size(of(r)).cast("long").alias(f"n_{r.kind}") for r in base],
                     F.sha2(joined(in_base).cast("binary"), 256).alias("base_sha256"),
                     joined(F.col("ranked")).alias("spans")))
    paths = kept.withColumn(blob, _blob(F.coalesce("text", F.lit("")))).drop("text")
    return paths.join(found, blob)
