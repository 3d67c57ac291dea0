"""Structural families of market titles: what a market is about, and what kind of proposition it makes.

A grammar is data: ordered topics and ordered propositions, the first that matches counts. It is compiled to one column
expression each, so that titles are read in one pass inside code generation; no prices or outcomes are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


@dataclass(frozen=True)
class Topic:
    """``pattern`` on ``field`` (text or series) gives the domain; its subject is ``subject``, or what ``subject_from`` finds there, else the series."""

    domain: str
    field: str
    pattern: str
    subject: str | None = None
    subject_from: str | None = None


@dataclass(frozen=True)
class Proposition:
    """``pattern`` on ``field`` (text, or claim: the subtitle if there is one) gives the structure; ``bounds`` says which numbers of the claim it bears on."""

    structure: str
    field: str
    pattern: str
    bounds: str = ""  # low, high, or both


@dataclass(frozen=True)
class Grammar:
    topics: tuple[Topic, ...]
    propositions: tuple[Proposition, ...]
    #: Domains whose one-sided propositions are told apart by series, as unknown ones are.
    by_series: tuple[tuple[str, tuple[str, ...]], ...] = ()


# The subjects and wordings of the public markets that the analyses are about.
PUBLIC_TOPICS = (
    Topic("weather", "text", r"temp.*(?:high|low)|(?:high|low).*temp"),
    Topic("equities", "text", r"s&p 500", "SP500"),
    Topic("equities", "text", r"nasdaq", "NASDAQ100"),
    Topic("sports", "series", r"^(?:NFL|NBA|NCAA|MLB|NHL|WNBA|ATP|WTA|PGA)", subject_from=r"^(NCAAMB|NCAAF|WNBA|NFL|NBA|MLB|NHL|ATP|WTA|PGA)"),
    Topic("mentions", "series", r"MENTION"),
    Topic("crypto", "text", r"bitcoin", "BTC"),
    Topic("crypto", "text", r"ethereum", "ETH"),
    Topic("crypto", "text", r"dogecoin", "DOGE"),
)
#: Subjects of the order markets of the test tables: the trade, and the region it is placed in.
ORDER_TOPICS = tuple(Topic(domain, "text", pattern, subject_from=r"\bin the ([a-z ]+) region\b") for domain, pattern in (("industry", r"\b(?:automobile|machinery)\b"), ("property", r"\bbuilding\b"), ("home", r"\b(?:household|furniture)\b")))
PROPOSITIONS = (
    Proposition("spread", "text", r"wins by"),
    Proposition("total", "text", r"total points|points scored"),
    Proposition("interval", "claim", NUMBER + r"\s*°?\s*(?:to|–|—)\s*\$?" + NUMBER, "both"),
    Proposition("above", "claim", r"\b(?:above|over|exceed|greater|at least)\b|>|\d\+", "low"),
    Proposition("below", "claim", r"\b(?:below|under|less|at most)\b|<", "high"),
    Proposition("winner", "text", r"winner|\bwin\b"),
)
MARKETS = Grammar(PUBLIC_TOPICS + ORDER_TOPICS, PROPOSITIONS, (("sports", ("above", "below")),))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(otherwise) if cases else otherwise


def number(text: Column, nth: int) -> Column:
    """The nth number of a text, without its commas."""
    return F.replace(F.get(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(nth)), F.lit(","), F.lit("")).try_cast("double")


def attributes(df: DataFrame, title: str = "title", subtitle: str = "yes_sub_title", event_ticker: str = "event_ticker", grammar: Grammar = MARKETS) -> DataFrame:
    """df with text, series, domain, underlying, structure, low, high and family (domain/underlying/structure).

    Null fields count as empty. low and high are the bounds that the proposition names, null where it has none.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    series = F.regexp_replace(F.substring_index(of(event_ticker), "-", 1), "^KX", "")
    base = df.withColumns({"text": F.trim(F.concat_ws(" ", of(title), of(subtitle))), "series": series, "__claim": F.lower(F.when(of(subtitle) != "", of(subtitle)).otherwise(of(title)))})
    base = base.withColumn("__text", F.lower("text"))
    field = {"text": F.col("__text"), "series": F.col("series"), "claim": F.col("__claim")}
    own = F.when(F.col("series") != "", F.col("series")).otherwise("unknown")

    def subject(t: Topic) -> Column:
        if t.subject:
            return F.lit(t.subject)
        found = F.regexp_extract(field[t.field], t.subject_from, 1) if t.subject_from else F.lit("")
        return F.when(found != "", found).otherwise(F.col("series"))

    hits = [(field[t.field].rlike(t.pattern), t) for t in grammar.topics]
    kinds = [(field[p.field].rlike(p.pattern), p) for p in grammar.propositions]
    named = base.withColumns(
        {
            "domain": first_of([(c, F.lit(t.domain)) for c, t in hits], F.lit("unknown")),
            "__subject": first_of([(c, subject(t)) for c, t in hits], own),
            "structure": first_of([(c, F.lit(p.structure)) for c, p in kinds], F.lit("unknown")),
        }
    )
    apart = F.col("structure") == "unknown"
    for domain, structures in grammar.by_series:
        apart = apart | ((F.col("domain") == domain) & F.col("structure").isin(*structures))
    low = [p.structure for p in grammar.propositions if p.bounds in ("low", "both")]
    both = [p.structure for p in grammar.propositions if p.bounds == "both"]
    high = [p.structure for p in grammar.propositions if p.bounds == "high"]
    out = named.withColumns(
        {
            "underlying": F.when(apart, own).otherwise(F.col("__subject")),
            "low": F.when(F.col("structure").isin(*low), number(F.col("__claim"), 0)),
            "high": F.when(F.col("structure").isin(*both), number(F.col("__claim"), 1)).when(F.col("structure").isin(*high), number(F.col("__claim"), 0)),
        }
    )
    return out.withColumn("family", F.concat_ws("/", "domain", "underlying", "structure")).drop("__claim", "__text", "__subject")
