"""Dynamic Markov coding: an automaton over bits that clones a state once two paths into it are both well used."""

from __future__ import annotations

import math


class Dmc:
    """States hold counts of 0 and 1 and their successors; the start is one chain of bit positions for each byte."""

    def __init__(self, own: float = 2.0, others: float = 2.0, most: int = 1 << 18):
        self.own, self.others, self.most = own, others, most
        self.count = [[0.2, 0.2] for _ in range(255)]
        # node n of 1..255 stands for the bits read of a byte; after the eighth bit the tree begins anew
        self.next = [[m - 1 if (m := 2 * n + bit) < 256 else 0 for bit in (0, 1)] for n in range(1, 256)]
        self.at = 0

    def p1(self) -> float:
        zero, one = self.count[self.at]
        return one / (zero + one)

    def step(self, bit: int) -> None:
        at, to = self.at, self.next[self.at][bit]
        here, there = self.count[at][bit], sum(self.count[to])
        if here > self.own and there - here > self.others and len(self.next) < self.most:
            share = here / there
            moved = [c * share for c in self.count[to]]
            self.count[to] = [c - m for c, m in zip(self.count[to], moved)]
            self.count.append(moved)
            self.next.append(list(self.next[to]))
            to = len(self.next) - 1
            self.next[at][bit] = to
        self.count[at][bit] += 1
        self.at = to


    def cost(self, data: bytes) -> float:
        """Bits that these bytes take from here on."""
        total = 0.0
        for b in data:
            for k in range(7, -1, -1):
                bit = b >> k & 1
                p = self.p1()
                total -= math.log2(p if bit else 1 - p)
                self.step(bit)
        return total


def dmc_bits(data: bytes) -> float:
    """Cost of a document in bits, its own past being all the automaton knows."""
    return Dmc().cost(data)
