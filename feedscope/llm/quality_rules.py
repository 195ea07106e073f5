"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps one failure bit a rule beside the
measurements. A policy is a named, versioned set of rules, so that changing or ablating a policy reads the
ledger and never the texts again.

Defined cases: a null text has no words and so fails ``few_words``; an empty table gives an empty ledger;
repeated rows are measured one by one; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import GAP, let, words


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the failing condition from the ledger's measurement columns."""

    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: The position of a rule is its bit. Append only: stored ledgers refer to these positions.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: _c("n_words") < 50),
    Rule("repeated_phrases", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("duplicate_lines", lambda: 10 * _c("n_dup_lines") > 4 * _c("n_lines")),
    Rule("short_words", lambda: 10 * _c("word_chars") < 25 * _c("n_words")),
    Rule("long_words", lambda: _c("word_chars") > 15 * _c("n_words")),
    Rule("shouting", lambda: 2 * _c("n_upper") > _c("n_letters")),
)

#: Versioned policies: which rules count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_phrases"),
    "2024-1": ("few_words", "repeated_phrases", "symbols", "duplicate_lines", "short_words", "long_words"),
    "2024-2": tuple(r.name for r in RULES),
}
CURRENT = "2024-2"


def policy_mask(policy: str, rules: Sequence[Rule] = RULES) -> int:
    wanted = POLICIES[policy]
    return sum(1 << k for k, r in enumerate(rules) if r.name in wanted)


def _covered(windows: Column) -> Column:
    """How many words stand in a three-word window whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(s, j)["h"])
        hit = F.transform(s, lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(hit), lambda i: F.array(i, i + 1, i + 2)))))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)


def _repeated(ws: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    # sorting is needed only where some window repeats
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0))
    return F.when(F.size(ws) < 6, _short(ws)).otherwise(found)


def _short(ws: Column) -> Column:
    """Texts of four or five words: too few to be worth the hashing path, but two windows may be equal."""
    eq = lambda a, b: F.concat_ws(" ", F.slice(ws, a, 3)) == F.concat_ws(" ", F.slice(ws, b, 3))
    n = F.size(ws)
    far = F.when((n == 5) & eq(1, 3), 5)
    near = F.when((n >= 4) & eq(1, 2), 4).when((n == 5) & eq(2, 3), 4)
    return F.coalesce(F.when((n == 5) & eq(1, 2) & eq(2, 3), 5), far, near, F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = docs.select(
        "doc_id",
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("rep"))).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, GAP, ""))).cast("long").alias("gaps"),
        F.length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )
    return m.select(
        "doc_id", F.col("w.n").alias("n_words"), (F.col("n_chars") - F.col("gaps")).alias("word_chars"), "n_symbols",
        (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_upper", "n_letters",
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.coalesce(rule.fails(), F.lit(True)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0)


def ablate(rows: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it fails (kept without it).

    The ledger shrinks first to one row for each distinct mask, at most 2 to the number of rules.
    """
    mask = policy_mask(policy, rules)
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if r.name in POLICIES[policy]])
    return (
        by_mask.select("m", "n", F.explode(named).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


def quality_verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The digest of the ledger that the registered query returns."""
    rows = apply_policy(ledger(docs), policy)
    base = policy_mask("base")
    failed = F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "fail_bits",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
g AS (SELECT rid, p, concat(w, ' ', lead(w) OVER q, ' ', lead(w, 2) OVER q) AS g, lead(w, 2) OVER q AS third FROM w WINDOW q AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT rid, p FROM g WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
n AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
ll AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS u FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_words, coalesce(n.chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ll.n - ll.u, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(ll.n, 0) AS n_lines,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid) LEFT JOIN ll USING (rid)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 4 * n_lines)::BIGINT + 16 * (10 * word_chars < 25 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
    + 64 * (2 * n_upper > n_letters)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
