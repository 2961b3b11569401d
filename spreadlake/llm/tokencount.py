"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: one for the piece that begins a word, one for the pieces
that follow. Where no edge leads on, a failure link leaves the node for the one that stands for
what is left after the pieces found so far are given away, and the node knows how many those are.
So the length of a word is a sum over its bytes, no piece is built and no byte is read twice.
Words are walked side by side, one byte position at a time, each distinct word of a batch once.
"""

from __future__ import annotations

import json
import sys
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm.common import slices, utf8
from spreadlake.llm.packing import byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes that begin a word and that go on with one.
HEAD, TAIL = 0, 1


class Automaton:
    """Arrays of the trie: sorted edge keys with their children, failure links and popped pieces."""

    def __init__(self, heads: list[bytes], tails: list[bytes]):
        edges: dict[tuple[int, int], int] = {}
        ends: set[int] = set()
        nodes = 2
        for root, pieces in ((HEAD, heads), (TAIL, tails)):
            for piece in pieces:
                at = root
                for b in piece:
                    if (at, b) not in edges:
                        edges[at, b] = nodes
                        nodes += 1
                    at = edges[at, b]
                if piece:
                    ends.add(at)
        down: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for (a, b), c in edges.items():
            down[a].append((b, c))
        fail, pops = [-1] * nodes, [0] * nodes
        queue = deque([HEAD, TAIL])
        while queue:
            u = queue.popleft()
            for b, v in down[u]:
                queue.append(v)
                if v in ends:
                    fail[v], pops[v] = TAIL, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and (z, b) not in edges:
                    popped, z = popped + pops[z], fail[z]
                if z >= 0:
                    fail[v], pops[v] = edges[z, b], popped
        keys = np.array([a * 256 + b for a, b in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.child, self.fail, self.pops

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, ...]) -> Automaton:
        out = cls.__new__(cls)
        out.keys, out.child, out.fail, out.pops = arrays
        return out

    def lengths(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of each word; 1 for a word that the vocabulary can't spell, 0 for an empty one."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        at = np.full(len(size), HEAD, np.int64)
        count = np.zeros(len(size), np.int64)
        lost = np.zeros(len(size), bool)
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for i, k in enumerate(longer):
            todo = np.flatnonzero(~lost[:k])
            byte = data[start[:k] + i].astype(np.int64)
            while len(todo):
                key = at[todo] * 256 + byte[todo]
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[pos] == key
                at[todo[hit]] = self.child[pos[hit]]
                todo = self._give(todo[~hit], at, count, lost)
        todo = np.flatnonzero(~lost & (size > 0) & (at != TAIL))
        while len(todo):
            todo = self._give(todo, at, count, lost)
            todo = todo[at[todo] != TAIL]
        count[lost] = 1
        out = np.empty(len(size), np.int64)
        out[order] = count
        return out

    def _give(self, todo: np.ndarray, at: np.ndarray, count: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """Give away the pieces popped at the nodes and follow the failure links; those without one are lost."""
        u = at[todo]
        count[todo] += self.pops[u]
        at[todo] = self.fail[u]
        gone = self.fail[u] < 0
        lost[todo[gone]] = True
        return todo[~gone]


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(heads, tails) of a byte-level vocabulary file: pieces with a leading space begin a word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pieces = [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def count_pieces(
    docs: DataFrame, heads: list[bytes], tails: list[bytes], doc_id: str = "doc_id", text: str = "text", lead: bytes = b" "
) -> DataFrame:
    """(doc_id, n_words, n_tokens): words of ``[^\\x20\\x09-\\x0D]+`` and the pieces they have, ``lead`` before each.

    Null and empty texts have neither. A word that can't be spelled counts as one piece. Repeated
    rows are counted each; an empty table gives an empty result; other columns are not carried. The
    automaton that goes to the tasks is as large as the vocabulary, whatever the corpus.
    """
    built = docs.sparkSession.sparkContext.broadcast(Automaton(heads, tails).arrays())

    def work(batches):
        automaton = Automaton.of(built.value)
        for part in slices(batches, 1):
            column = part.column(1).cast(pa.large_string()).fill_null("")
            # blanks at the ends would make empty words
            lists = pc.split_pattern_regex(pc.ascii_trim_whitespace(column), r"[\x20\x09-\x0d]+")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            data, off = utf8(coded.dictionary)
            size = np.diff(off) + len(lead) * (np.diff(off) > 0)
            begin = np.cumsum(size) - size
            with_lead = np.empty(int(size.sum()), np.uint8)
            fill = np.ones(len(with_lead), bool)
            for i, b in enumerate(lead):
                with_lead[begin[size > 0] + i] = b
                fill[begin[size > 0] + i] = False
            with_lead[fill] = data[off[0] : off[-1]]
            each = automaton.lengths(with_lead, begin, size)
            codes = coded.indices.to_numpy()
            sums = np.concatenate(([0], np.cumsum(each[codes])))
            words = np.concatenate(([0], np.cumsum((size > 0)[codes])))
            at = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words[at[1:]] - words[at[:-1]]), pa.array(sums[at[1:]] - sums[at[:-1]])],
                ["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        work, "doc_id bigint, n_words bigint, n_tokens bigint"
    )
