"""Inverted treaps of a shard of documents: one per term, in search order of the documents and in heap order of the
term's impact on them, and their simultaneous traversal for many queries at once.

A treap's root is the posting of the largest impact, and its left and right subtrees hold the postings of the documents
before and behind it. So the first node on the way down that lies in a range of documents has the largest impact there.
A traversal halves ranges of documents; a state is a query, a range, and for each of the query's terms that node. The
weighted sum of the nodes' impacts bounds the score of every document in the range and is the score of a range of one.
States whose bound is below the query's kth score so far are dropped with all that is beneath them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States of a query that are followed at once, and states of all queries. The others wait, and most are ruled out by
#: the scores that these find.
BEAM, MOST_STATES = 32, 1 << 15


@dataclass
class Treaps:
    """Nodes are postings; doc, impact, left and right by node, and root by term. -1 is no node."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray
    n_docs: int


def build(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> Treaps:
    """From postings in the order of documents. All treaps grow together, a level at a time; of equal impacts the middle
    one becomes the root, which keeps treaps of equal impacts shallow."""
    order = np.argsort(term, kind="stable")
    term, doc, impact = term[order], doc[order].astype(np.int32), impact[order]
    n = len(term)
    link = np.full((2, n), -1, dtype=np.int32)
    root = np.full(n_terms, -1, dtype=np.int32)
    lo = np.flatnonzero(np.diff(term, prepend=-1)) if n else np.zeros(0, dtype=np.int64)
    hi = np.append(lo[1:], n) if n else lo
    parent, side = term[lo].astype(np.int64), np.full(len(lo), 2)  # side 2: a root, of the term parent
    while len(lo):
        size = hi - lo
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - start, size)
        most = np.maximum.reduceat(impact[at], start)
        ties = np.flatnonzero(impact[at] == np.repeat(most, size))
        first = np.searchsorted(ties, start)
        node = at[ties[first + (np.append(first[1:], len(ties)) - first) // 2]]
        root[parent[side == 2]] = node[side == 2]
        for s in (0, 1):
            link[s][parent[side == s]] = node[side == s]
        lo, hi, parent = np.concatenate([lo, node + 1]), np.concatenate([node, hi]), np.concatenate([node, node])
        side = np.repeat([0, 1], len(node))
        some = lo < hi
        lo, hi, parent, side = lo[some], hi[some], parent[some], side[some]
    return Treaps(doc, impact, link[0], link[1], root, n_docs)


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids, a missing id last."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.none = np.zeros(0, dtype=bool)
        #: The kth score of each query, or 1, as scores are above 0.
        self.least = np.ones(n_queries, dtype=np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least[query]
        if not good.any():
            return
        new = zip(("query", "score", "id", "none"), (query, score, ids, none), strict=True)
        found = {c: np.concatenate([getattr(self, c), v[good]]) for c, v in new}
        order = np.lexsort((found["id"], found["none"], -found["score"], found["query"]))
        q = found["query"][order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.query, self.score, self.id, self.none = (found[c][order] for c in ("query", "score", "id", "none"))
        last = rank == self.k - 1
        self.least[self.query[last]] = self.score[last]


@dataclass
class Queries:
    """Query i has the terms term[bounds[i]:bounds[i + 1]], each once, with their weights."""

    bounds: np.ndarray
    term: np.ndarray
    weight: np.ndarray


@dataclass
class _States:
    query: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    bound: np.ndarray
    many: np.ndarray  # of its nodes
    node: np.ndarray
    weight: np.ndarray

    def take(self, at: np.ndarray) -> _States:
        start, many = (np.cumsum(self.many) - self.many)[at], self.many[at]
        flat = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
        return _States(self.query[at], self.lo[at], self.hi[at], self.bound[at], many, self.node[flat], self.weight[flat])


def _narrowed(t: Treaps, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, many: np.ndarray, node: np.ndarray, weight: np.ndarray, least: np.ndarray) -> _States:
    """States of these ranges: nodes go down to the first inside, and terms without one are left out."""
    begin, end = np.repeat(lo, many), np.repeat(hi, many)
    node = node.copy()
    out = np.arange(len(node))
    while len(out):
        at = node[out]
        doc = t.doc[at]
        before, behind = doc < begin[out], doc >= end[out]
        node[out] = np.where(before, t.right[at], np.where(behind, t.left[at], at))
        out = out[(before | behind) & (node[out] >= 0)]
    some = node >= 0
    of = np.repeat(np.arange(len(query)), many)[some]
    node, weight = node[some], weight[some]
    many = np.bincount(of, minlength=len(query))
    sums = np.concatenate([[0], np.cumsum(weight * t.impact[node])])
    ends = np.cumsum(many)
    bound = sums[ends] - sums[ends - many]
    return _States(query, lo, hi, bound, many, node, weight).take(np.flatnonzero(bound >= least[query]))


def search(t: Treaps, queries: Queries, ids: np.ndarray, none: np.ndarray, best: Best) -> int:
    """Adds this shard's documents to best, whose scores so far rule states out; ids and none are by document. Gives the
    number of states looked at."""
    n = len(queries.bounds) - 1
    roots = t.root[queries.term]
    some = roots >= 0
    many = np.bincount(np.repeat(np.arange(n), np.diff(queries.bounds))[some], minlength=n)
    zero, whole = np.zeros(n, dtype=np.int64), np.full(n, t.n_docs, dtype=np.int64)
    waiting, seen = [_narrowed(t, np.arange(n), zero, whole, many, roots[some], queries.weight[some], best.least)], 0
    while waiting:
        now = waiting.pop()
        keep = np.flatnonzero(now.bound >= best.least[now.query])
        order = keep[np.lexsort((-now.bound[keep], now.query[keep]))]
        rank = np.arange(len(order)) - np.searchsorted(now.query[order], now.query[order])
        first = (rank < BEAM) & (np.arange(len(order)) < MOST_STATES)
        if not first.all():
            waiting.append(now.take(order[~first]))
        now = now.take(order[first])
        seen += len(now.query)
        one = now.hi - now.lo == 1
        best.add(now.query[one], now.bound[one], ids[now.lo[one]], none[now.lo[one]])
        if not one.all():
            now = now.take(np.flatnonzero(~one))
            half = (now.lo + now.hi) // 2
            twice = [np.concatenate([x, x]) for x in (now.query, now.many, now.node, now.weight)]
            waiting.append(_narrowed(t, twice[0], np.append(now.lo, half), np.append(half, now.hi), *twice[1:], best.least))
    return seen
