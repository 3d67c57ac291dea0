"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols stand in a doubly linked list; adjacent pairs with a merge rule wait in a heap ordered by
(rank, position). Popping the lowest pair, joining it and pushing its two new neighbours repeats until the heap is
empty. The count is the number of initial symbols less the number of merges: no identifier is ever made.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import DataFrame

from calibra.llm.common import BoundedCache, documents, map_arrow, slices, vocabulary
from calibra.llm.words import PreTokens, chunks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter:
    """Counts the tokens of whole texts for a word-end byte-pair vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        self.words = PreTokens(path)
        self.rank = {pair: k for k, pair in enumerate(self.words.merges)}
        self.of_word = BoundedCache(self.count_word, 800_000)
        self.of_chunk = BoundedCache(self.count_chunk, 600_000)

    def count_word(self, word: str) -> int:
        """Initial symbols less merges, for one pre-token in the byte alphabet."""
        symbols = list(word)
        symbols[-1] += self.words.suffix
        n, rank, push, pop = len(symbols), self.rank.get, heapq.heappush, heapq.heappop
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry holds for the pair at its place only while the rank there is still its own.
        heap = [(r, i) for i, pair in enumerate(pairwise(symbols)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = pop(heap)
            j = right[i]
            a = symbols[i]
            if a is None or j >= n or rank((a, b := symbols[j])) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = ab, _ = a + b, None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank((ab, symbols[k]))) is not None:
                    push(heap, (r, i))
            if (h := left[i]) >= 0 and (r := rank((symbols[h], ab))) is not None:
                push(heap, (r, h))
        return n - merges

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a run without white space; each special string in it is one token, as the library has it."""
        parts = self.words.parts(chunk)
        return len(parts) // 2 + sum([self.of_word[w] for part in parts[::2] for w in self.words.of(part)])

    def count(self, text: str) -> int:
        return sum(map(self.of_chunk.__getitem__, chunks(text)))


@lru_cache(1)
def counter_of(path: str) -> MergeCounter:
    """One counter for the life of a Python worker, so that its memory of words outlives a task."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give a row each; an empty
    table gives none; extra columns are left behind. No shuffle: one pass over the scan's partitions.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def work(batches):
        counter = counter_of(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(documents(docs), work, SCHEMA)
