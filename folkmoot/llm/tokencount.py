"""Token counts by byte-pair merging, without producing identifiers.

Each pretoken of the public split pattern starts as its bytes in a linked list;
a heap holds the ranks of adjacent pairs, and the lowest is merged again and
again. The count is the number of bytes less the number of merges. The work is
n log n in the length of a pretoken, so one of a million letters is no trouble.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

from folkmoot.llm.common import TOKENIZERS, Intake, byte_ranks, kept, pretoken_pattern, vocabulary

REMEMBERED = 600_000


def merged_count(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens byte-pair merging leaves of ``word``."""
    n = len(word)
    if n < 2:
        return n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    if not heap:
        return n
    heapify(heap)
    end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends; 0 if none starts there
    before = list(range(-1, n))  # before[i]: where the symbol left of i starts
    merges = 0
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has been merged since
        merges += 1
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := get(word[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    return n - merges


class Counter(dict):
    """Counts by pretoken; forgets all when it has grown to ``REMEMBERED``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        n = merged_count(word.encode("utf-8", "surrogatepass"), self.ranks)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n
        return n


def counter(name: str, folder: str):
    """(findall, counter) of a vocabulary, kept as long as the process has no other work."""
    import regex

    return kept(("counter", name, folder), lambda: (regex.compile(pretoken_pattern(folder)).findall, Counter(byte_ranks(vocabulary(name, folder)))))


def token_counts(df: DataFrame, name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_bytes) of every row.

    A null text gives null counts, an empty one zeros. Null and repeated ids are
    kept, a row for each row. Other columns aren't read.
    """
    took = Intake(df, id_col, text_col)
    rows = took.narrow(doc_id=id_col, text=text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        findall, counts = counter(name, folder)
        of = counts.__getitem__
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if text is None:
                    out.append((None, None, None))
                else:
                    words = findall(text)
                    out.append((sum(map(of, words)), len(words), len(text.encode("utf-8", "surrogatepass"))))
            got = pd.DataFrame(out, columns=["n_tokens", "n_pretokens", "n_bytes"], dtype="Int64", index=pdf.index)
            yield pd.concat([pdf[["doc_id"]], got], axis=1)

    return rows.mapInPandas(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pretokens long, n_bytes long")
