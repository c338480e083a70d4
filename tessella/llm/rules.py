"""Quality rules as a ledger of failure bits and measurements, in SQL functions only.

Every rule is evaluated once per document; its outcome is a bit of ``failures`` and what it measured stays in
the row. Policies are masks with a version, applied to the stored bits, and ablations are bitwise aggregates of
them: neither reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rule, and the condition over the measurements under which a document fails it. The place is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words + 50"),
    ("repeated_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words)"),
    ("shouting", "2 * n_upper > word_chars AND n_words >= 10"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policy versions: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_windows"), "v1": tuple(BIT)}


def mask(policy: tuple[str, ...]) -> int:
    return sum(BIT[r] for r in policy)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and with the measurements; names that clash are replaced by them.

    Null texts measure as empty texts. Repeated windows are found by 64-bit hashes of three words within one
    text: hashes are sorted with their positions only where some hash repeats, and windows of equal hashes are compared by their words.
    Very long texts are measured whole, in time that grows as n log n with their words; a text's words, lines and windows are arrays in one row's memory.
    """
    own = [c for c in docs.columns if c not in (text, *MEASURES)]
    words = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(*own, "_text", F.expr(rf"regexp_extract_all(_text, '[^\\x20\\x09-\\x0D]+', 0)").alias("_words"))
    lines = words.withColumns(
        {
            "_lines": F.expr(r"filter(split(_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
            "_windows": F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))))"),
        }
    )
    found = lines.select(
        *own, "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(_text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(regexp_count(_text, '[A-Z]') as bigint)").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr("if(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))), array())").alias("_sorted"),
    )
    twice = "sort_array(filter(transform({0}, (s, i) -> if(s.{1} = get({0}, i - 1).{1} OR s.{1} = get({0}, i + 1).{1}, s.i, null)), x -> x IS NOT NULL))"
    alike = found.withColumn("_alike", F.expr(twice.format("_sorted", "h")))
    texts = alike.withColumn("_texts", F.expr("sort_array(transform(_alike, i -> struct(array_join(slice(_words, i + 1, 3), ' ') AS w, i AS i)))"))
    at = texts.withColumn("_at", F.expr(twice.format("_texts", "w")))
    covered = F.expr("aggregate(transform(_at, (p, i) -> least(3, coalesce(get(_at, i + 1) - p, 3))), 0, (a, n) -> a + n)")
    return at.withColumn("n_repeat_words", covered.cast("long")).drop("_words", "_sorted", "_alike", "_texts", "_at")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failures``: one bit for each rule that the document fails."""
    bits = " | ".join(f"if({condition}, {BIT[name]}, 0)" for name, condition in RULES)
    return measured(docs, text).withColumn("failures", F.expr(bits))


def verdict(policy: str) -> Column:
    return F.col("failures").bitwiseAND(mask(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, and those that only it rejects, by one pass over the bits."""
    whole = mask(POLICIES[policy])
    failed = F.col("failures").bitwiseAND(whole)
    sums = [f(r).alias(f"{k}_{r}") for r in POLICIES[policy] for k, f in (("failed", lambda r: F.count_if(failed.bitwiseAND(BIT[r]) != 0)), ("alone", lambda r: F.count_if(failed == BIT[r])))]
    one = rows.agg(F.count_if(failed != 0).alias("rejected"), F.bit_or(failed).alias("seen"), *sums)
    lines = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("failed"), F.col(f"alone_{r}").alias("alone")) for r in POLICIES[policy]])
    return one.select(F.lit(policy).alias("policy"), "rejected", F.inline(lines))


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the measurements, base_failed, kept under a policy, failures (bits of RULES), the policy, and ``only``: the rule that
    alone rejects the document under it, so that it would stay without.

    Null and empty texts have no words and fail; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    failed = F.col("failures").bitwiseAND(mask(POLICIES[policy]))
    only = F.coalesce(*[F.when(failed == BIT[r], F.lit(r)) for r in POLICIES[policy]])
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict("base")).alias("base_failed"), (verdict("base") & verdict(policy)).alias("kept"), "failures",
        F.lit(policy).alias("policy"), only.alias("only"),
    )


def quality_rule_ablations(spark, sf_dir: str) -> DataFrame:
    """For each policy version and rule of it: documents rejected at all, failing the rule, and kept if the rule were dropped.

    Every row counts, whatever its id and however often it is there; null and empty texts fail as texts of no words do. An empty table gives the rows of all rules,
    with zeros.
    """
    rows = ledger(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))).select("failures")
    return ablations(rows, "base").unionByName(ablations(rows, "v1"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM d),
w AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM w WHERE n > 1) GROUP BY k),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (k)),
f AS (SELECT *, BITS AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures,
       'v1' AS policy, CASE failures ONLY END AS only FROM f
""".replace("BITS", " | ".join(f"(CASE WHEN {c} THEN {BIT[n]} ELSE 0 END)" for n, c in RULES)).replace("ONLY", " ".join(f"WHEN {b} THEN '{n}'" for n, b in BIT.items()))

ABLATIONS = ORACLE[: ORACLE.rindex("SELECT doc_id")] + " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, (SELECT count(*) FROM f WHERE (failures & {mask(rules)}) <> 0) AS rejected, '{r}' AS rule, count(*) FILTER (WHERE (failures & {BIT[r]}) <> 0) AS failed, count(*) FILTER (WHERE (failures & {mask(rules)}) = {BIT[r]}) AS alone FROM f"
    for policy, rules in POLICIES.items()
    for r in rules
)
