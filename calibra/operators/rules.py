"""Ordered substring rules as data: the first rule whose pattern occurs in a text names its labels.

The patterns are compiled to an Aho-Corasick automaton: one step a character, however many rules. A state knows the
first rule of all the patterns that end there, so a text is classified in one walk without listing what it holds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are held by the driver and sent to tasks: the size of a rule table, so an error, not a cut.
MOST_RULES = 100_000


class Automaton:
    """``patterns`` in order of priority; ``first(text)`` is the place of the first that occurs in the text, -1 if none does."""

    def __init__(self, patterns: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        self.best: list[int] = [-1]
        for k, pattern in enumerate(patterns):
            state = 0
            for ch in pattern:
                if ch not in self.step[state]:
                    self.step[state][ch] = len(self.step)
                    self.step.append({})
                    self.best.append(-1)
                state = self.step[state][ch]
            self.best[state] = self.sooner(self.best[state], k)
        self.fail = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            self.best[state] = self.sooner(self.best[state], self.best[self.fail[state]])
            for ch, after in self.step[state].items():
                self.fail[after] = self.follow(self.fail[state], ch)
                queue.append(after)
        self.best = [self.sooner(b, self.best[0]) for b in self.best]  # an empty pattern occurs in every text

    @staticmethod
    def sooner(a: int, b: int) -> int:
        return b if a < 0 else a if b < 0 else min(a, b)

    def follow(self, state: int, ch: str) -> int:
        while ch not in self.step[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.step[state][ch]

    def first(self, text: str) -> int:
        state, found = 0, self.best[0]
        for ch in text:
            state = self.follow(state, ch)
            if self.best[state] >= 0:
                found = self.sooner(found, self.best[state])
                if found == 0:
                    break
        return found


class RuleTable:
    """Rules (pattern, labels...) in order of priority, patterns compared in upper case."""

    def __init__(self, rules: Iterable[tuple], names: tuple[str, ...]):
        self.rules, self.names = [tuple(r) for r in rules], tuple(names)
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        if any(len(r) != len(self.names) + 1 or r[0] is None for r in self.rules):
            raise ValueError("a rule is a pattern and a label for each name")
        self.automaton = Automaton(r[0].upper() for r in self.rules)

    @classmethod
    def read(cls, df: DataFrame, names: tuple[str, ...], pattern: str = "pattern", priority: str = "priority") -> RuleTable:
        """The rules of a table, such as a CSV file's, the smallest priority first, ties by pattern."""
        rows = df.select(priority, pattern, *names).limit(MOST_RULES + 1).collect()
        return cls([tuple(r)[1:] for r in sorted(rows, key=lambda r: (r[0], r[1]))], names)

    def classify(self, df: DataFrame, column: str, other: str = "Other") -> DataFrame:
        """df with a column for each name: the labels of the first rule that occurs in ``column``. Where none does, ``other``,
        and the text itself as last label if there are several. A null text has none. For distinct texts, not for facts."""
        last = len(self.names) > 1
        rules, automaton = self.rules, self.automaton

        @F.pandas_udf(", ".join(f"`{n}` string" for n in self.names))
        def labels(texts: pd.Series) -> pd.DataFrame:
            found = []
            for t in texts:
                k = automaton.first((t or "").upper())
                found.append(rules[k][1:] if k >= 0 else (*[other] * (len(self_names) - last), *([t] if last else [])))
            return pd.DataFrame(found, columns=list(self_names))

        self_names = self.names
        out = df.withColumn("__labels", labels(F.col(column)))
        return out.select(*[c for c in df.columns if c not in self.names], *[F.col(f"__labels.`{n}`").alias(n) for n in self.names])

    def join(self, df: DataFrame, column: str, other: str = "Other") -> DataFrame:
        """The same for a table with many rows a text: distinct texts are classified, then joined."""
        distinct = self.classify(df.select(F.col(column).alias("__text")).distinct(), "__text", other)
        kept = df.drop(*self.names)
        return kept.join(distinct, kept[column].eqNullSafe(distinct["__text"])).drop("__text")
