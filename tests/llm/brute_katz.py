"""A plain dictionary version of the backoff model."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = ("end",), ("start",)


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), END]


def trains(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 1


class Katz:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            line = [START] * (order - 1) + tokens(text)
            for i in range(order - 1, len(line)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(line[i - n + 1 : i + 1])] += 1
        self.ratios = [None] + [self._ratios(Counter(self.counts[n].values())) for n in range(1, order + 1)]
        self.followers = [defaultdict(list) for _ in range(order + 1)]
        for n in range(1, order + 1):
            for gram, c in self.counts[n].items():
                self.followers[n][gram[:-1]].append((gram[-1], c))
        self.memo = {}

    @staticmethod
    def _ratios(n, k=5):
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        found = {}
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            found[r] = d if 0 < d < 1 else (r - 0.5) / r
        return found

    def context(self, n, ctx):
        if (n, ctx) not in self.memo:
            rows = self.followers[n][ctx]
            total = sum(c for _, c in rows)
            if not total:
                self.memo[n, ctx] = (0, 1.0)
            else:
                given = sum(self.ratios[n].get(c, 1) * c for _, c in rows) / total
                scale = min(1, total / (total + 1) / given)
                lower = math.fsum(self.p(n - 1, ctx[1:] + (w,)) for w, _ in rows) if n > 1 else 0
                self.memo[n, ctx] = (scale / total, (1 - scale * given) / (1 - lower))
        return self.memo[n, ctx]

    def p(self, n, gram):
        factor, weight = self.context(n, gram[:-1])
        c = self.counts[n][gram]
        if c:
            return factor * self.ratios[n].get(c, 1) * c
        return weight * (self.p(n - 1, gram[1:]) if n > 1 else 1.0)

    def score(self, text):
        line = [START] * (self.order - 1) + tokens(text)
        return math.fsum(math.log10(self.p(self.order, tuple(line[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(line)))
