"""A prefix tree of ordered token sets that finds all components of sets with a given Jaccard similarity.

Sets are inserted in order of size. Nodes hold runs of tokens. A query walks the tree once; sets with a common start
share the counting of their overlap, and a subtree is left as soon as the tokens that remain on either side can't
bring the overlap to what the similarity needs, or the sizes below can't match. Links that would join what is joined
already are of no use to components, so subtrees all of whose sets are in the query's own component are left too.
"""

from __future__ import annotations

from bisect import bisect_right


class Node:
    __slots__ = ("children", "ends", "least", "member", "most", "rest", "tokens", "uniform")

    def __init__(self, tokens: list[int], rest: int, size: int, member: int):
        self.tokens = tokens
        self.children: dict[int, Node] = {}
        self.ends: list[int] = []  # sets that end with this node's run
        self.rest = rest  # most tokens that a set has below this run
        self.least = self.most = size
        self.member, self.uniform = member, True  # some set below; whether all were in one component when last seen


class PrefixTree:
    """Sets of the same tree are compared; ``union`` has the components of all sets, by position."""

    def __init__(self, percent: int, sizes: list[int], union: list[int], links: list[tuple[int, int]]):
        self.percent, self.sizes, self.union, self.links = percent, sizes, union, links
        self.root = Node([], 0, 0, -1)
        self.empty = True

    def find(self, i: int) -> int:
        union = self.union
        while union[i] != i:
            union[i] = union[union[i]]
            i = union[i]
        return i

    def query(self, q: list[int], i: int) -> None:
        """Link set i, with shared tokens q, to sets in the tree: at least one of each component it has a link to."""
        if self.empty:
            return
        percent, sizes, own, n = self.percent, self.sizes, set(q), self.sizes[i]
        root = self.find(i)
        stack = [(child, 0) for child in self.root.children.values()]
        both = 100 + percent
        while stack:
            node, overlap = stack.pop()
            if 100 * node.most < percent * n:
                continue
            if node.uniform and self.find(node.member) == root:
                continue
            # least overlap that any set below needs: percent / (100 + percent) of both sizes
            need = -(-percent * (n + max(node.least, -(-percent * n // 100))) // both)
            tokens = node.tokens
            if len(tokens) > 32:  # a long run is cut off after its start already, if that has too little
                start = tokens[:32]
                got = len(own.intersection(start))
                if overlap + got + min(len(q) - bisect_right(q, start[-1]), len(tokens) - 32 + node.rest) < need:
                    continue
                overlap += got + len(own.intersection(tokens[32:]))
            else:
                overlap += len(own.intersection(tokens))
            after = len(q) - bisect_right(q, tokens[-1])
            for j in node.ends:
                if both * overlap >= percent * (n + sizes[j]):
                    other = self.find(j)
                    if other != root:
                        self.links.append((i, j))
                        self.union[max(other, root)] = min(other, root)
                        root = min(other, root)
            if node.children and overlap + min(after, node.rest) >= need:
                stack.extend((child, overlap) for child in node.children.values())

    def insert(self, q: list[int], i: int) -> None:
        self.empty = False
        node, at, n, root = self.root, 0, self.sizes[i], self.find(i)
        while True:
            if at == len(q):
                node.ends.append(i)
                return
            child = node.children.get(q[at])
            if child is None:
                node.children[q[at]] = new = Node(q[at:], 0, n, i)
                new.ends.append(i)
                return
            run, k = child.tokens, 1
            most = min(len(run), len(q) - at)
            while k < most and run[k] == q[at + k]:
                k += 1
            if k < len(run):  # part the run
                upper = Node(run[:k], child.rest + len(run) - k, child.least, child.member)
                upper.most, upper.uniform = child.most, child.uniform
                child.tokens = run[k:]
                upper.children[run[k]] = child
                node.children[q[at]] = upper
                child = upper
            at += k
            child.rest = max(child.rest, len(q) - at)
            child.least, child.most = min(child.least, n), max(child.most, n)
            child.uniform = child.uniform and self.find(child.member) == root
            node = child


def link(groups: list[int], sets: list[list[int]], sizes: list[int], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets of a group with a similarity of percent or more.

    sets: ascending tokens that other sets may share; sizes: sizes of the whole sets; sets with the same ``known`` need
    no links between them.
    """
    union, links, trees = list(range(len(sets))), [], {}
    first: dict[int, int] = {}
    for i, k in enumerate(known or ()):
        union[i] = first.setdefault(k, i)
    for i in sorted(range(len(sets)), key=lambda k: (sizes[k], sets[k])):
        tree = trees.get(groups[i])
        if tree is None:
            tree = trees[groups[i]] = PrefixTree(percent, sizes, union, links)
        tree.query(sets[i], i)
        tree.insert(sets[i], i)
    return links
