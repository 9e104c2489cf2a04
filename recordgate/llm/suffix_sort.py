"""Deep-shallow sorting of byte strings.

Multikey quicksort splits the strings on blocks of bytes down to a shallow depth.
Groups that still agree there have long common prefixes; a blind trie puts each in
order: it keeps only the depths at which strings part and the bytes there, so a string
is placed by walking down blindly, comparing once with the leaf reached, and
branching where that comparison says.
"""

from __future__ import annotations

#: Bytes that one step of the quicksort looks at, and the depth at which tries take over.
BLOCK = 16
SHALLOW = 64


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """Inner nodes are [depth, {byte: child}]; a leaf is a list of the numbers of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.top: list | None = None

    @staticmethod
    def _inner(node: list) -> bool:
        return len(node) == 2 and isinstance(node[1], dict)

    def add(self, number: int) -> None:
        if self.top is None:
            self.top = [number]
            return
        text, node = self.strings[number], self.top
        while self._inner(node):
            depth, children = node
            symbol = text[depth] if depth < len(text) else -1
            node = children.get(symbol) or next(iter(children.values()))
        other = self.strings[node[0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(number)
            return
        symbol = text[depth] if depth < len(text) else -1
        above, key, node = None, None, self.top
        while self._inner(node) and node[0] < depth:
            above, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        if self._inner(node) and node[0] == depth:
            node[1][symbol] = [number]
            return
        branch = [depth, {symbol: [number], other[depth] if depth < len(other) else -1: node}]
        if above is None:
            self.top = branch
        else:
            above[1][key] = branch

    def ordered(self):
        waiting = [self.top] if self.top is not None else []
        while waiting:
            node = waiting.pop()
            if self._inner(node):
                waiting += [node[1][s] for s in sorted(node[1], reverse=True)]
            else:
                yield from node


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in ascending order; equal ones in order of their numbers."""
    result: list[int] = []
    waiting = [(list(range(len(strings))), 0)]
    while waiting:
        group, depth = waiting.pop()
        if len(group) == 1:
            result.append(group[0])
        elif group and depth >= shallow:
            trie = BlindTrie(strings)
            for number in group:
                trie.add(number)
            result += trie.ordered()
        elif group:
            keys = [strings[i][depth : depth + BLOCK] for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            waiting.append((more, depth))
            if len(pivot) < BLOCK:  # these strings end here and are equal
                waiting += [([i], depth) for i in reversed(same)]
            else:
                waiting.append((same, depth + BLOCK))
            waiting.append((less, depth))
    return result


def neighbour_prefixes(strings: list[bytes], order: list[int]) -> list[int]:
    """For each place in the order the length of the prefix it shares with the place before; 0 for the first."""
    return [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
