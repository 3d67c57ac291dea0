"""Quality rules by a rule bitmask ledger.

Every rule is evaluated once a document: the ledger keeps its measurements, and one bit a rule that it breaks. What is
kept is decided afterwards, by policies: a policy is a versioned mask of rules, so that a new version costs a bitwise AND on
the ledger, not another pass over the texts. What each rule does in a policy (ablations) comes from the counts of the
ledger's distinct bit patterns. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import documents

BLANK = r"[ \t-\r]"  # \x20 and \x09 to \x0D
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``broken`` is SQL over the measurements, true where a document breaks the rule; ``bit`` is its place for good."""

    bit: int
    name: str
    broken: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never given anew: a retired rule keeps its bit, so that old ledgers can be read.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("web", 1, BASE),
    Policy("web", 2, (*BASE, "symbols", "word_length")),
    Policy("web", 3, (*BASE, "symbols", "word_length", "repeated_lines")),
)
CURRENT = POLICIES[-1]


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the rules named; an unknown name is an error."""
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def windows(words: Column, n: Column) -> Column:
    """The 3-word windows as (word, word, word, place), sorted: equal windows are neighbours. Needs n >= 3."""
    m = n - 2
    return F.sort_array(F.arrays_zip(F.slice(words, F.lit(1), m).alias("a"), F.slice(words, F.lit(2), m).alias("b"), F.slice(words, F.lit(3), m).alias("c"), F.sequence(F.lit(0), m - 1).alias("i")))


def repeated_places(s: Column) -> Column:
    """Places of the windows that occur twice or more, of windows sorted as above."""
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
    return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))


def measurements(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every whole text, each text cut once.

    n_lines: lines with a word; n_dup_lines: of these, those equal to an earlier one; n_repeat_words: words in windows of
    three that occur twice or more in the text. Windows are compared as words, not as hashes, after a sort in the row; so a
    text takes memory in proportion to its words, and no row of it is shuffled.
    """
    cut = documents(docs).select(
        "doc_id",
        (F.length("text") - F.length(F.regexp_replace("text", f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
        F.array_remove(F.split("text", f"{BLANK}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    counted = cut.select("doc_id", "n_symbols", "words", F.size("words").alias("n"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    ordered = counted.withColumn("sorted", F.when(F.col("n") >= 4, windows(F.col("words"), F.col("n"))))
    chars = F.length(F.array_join("words", "")).cast("long")
    placed = ordered.select("doc_id", "n", "n_symbols", "n_lines", "n_dup_lines", chars.alias("word_chars"), repeated_places(F.col("sorted")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(p, p + 1, p + 2)))))
    repeat = F.when(F.size("places") > 0, covered).otherwise(0).cast("long")
    return placed.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat.alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements of every document, and failed_bits: bit k is set where the rule with bit k is broken.

    A null text counts as empty and has no words. Null doc_ids stay null; repeated rows give a row each; an empty table
    gives none; extra columns, whatever their names, stay behind. A ledger is there to be written and read by policies: a filter
    on one that isn't goes down to the texts with its measurements, which are then made twice.
    """
    bits = sum((F.when(F.expr(r.broken), 1 << r.bit).otherwise(0).cast("long") for r in rules[1:]), F.when(F.expr(rules[0].broken), 1 << rules[0].bit).otherwise(0).cast("long"))
    return measurements(docs).withColumn("failed_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failed_bits") -> Column:
    """True where the ledger's row breaks no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")) == 0


def verdicts(kept: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger with a column kept_<name>_v<version> for every policy."""
    return kept.withColumns({f"kept_{p.name}_v{p.version}": passes(p, rules) for p in policies})


def ablations(kept: DataFrame, policies: tuple[Policy, ...] = POLICIES, by: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each policy, rule of it, and group of the columns ``by``: what the rule does there.

    n_docs; n_broken: rows that break the rule; n_rejected: by the policy; n_only: by this rule alone, so kept without it;
    ever and always: bits broken by any and by all rows of the group. The ledger is first brought down to its distinct bit
    patterns (2 to the number of rules, at most, a group), which the policies then read.
    """
    patterns = kept.groupBy(*by, "failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.name, p.version, r.name, mask(p.rules, rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for a, v, r, m, b in cases]))
    broken = F.col("failed_bits").bitwiseAND(F.col("x.mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = patterns.select("*", each.alias("x")).groupBy(*by, F.col("x.policy").alias("policy"), F.col("x.version").alias("version"), F.col("x.rule").alias("rule"))
    return out.agg(
        F.sum("n").alias("n_docs"),
        total(F.col("failed_bits").bitwiseAND(F.col("x.bit")) != 0).alias("n_broken"),
        total(broken != 0).alias("n_rejected"),
        total(broken == F.col("x.bit")).alias("n_only"),
        F.bit_or("failed_bits").alias("ever"),
        F.bit_and("failed_bits").alias("always"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    from calibra.llm.common import table

    kept = ledger(table(spark, sf_dir, "documents"))
    base = ~passes(Policy("base", 1, BASE))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(CURRENT).alias("kept"), "failed_bits")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
u AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM w),
g AS (SELECT rid, i, w AS a, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM u),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
places AS (SELECT rid, i FROM rep WHERE n > 1 UNION SELECT rid, i + 1 FROM rep WHERE n > 1 UNION SELECT rid, i + 2 FROM rep WHERE n > 1),
covered AS (SELECT rid, count(*) AS n FROM places GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
wc AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM u GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_words, CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lc.n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(lc.n_lines, 0) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN wc ON wc.rid = d.rid LEFT JOIN lc ON lc.rid = d.rid LEFT JOIN covered ON covered.rid = d.rid),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""
