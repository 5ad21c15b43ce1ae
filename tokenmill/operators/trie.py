"""Longest matches of a vocabulary in columns of words, by a double-array trie."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tokenmill.functions.bytelevel import byte_symbols

#: byte of each code point of the byte alphabet
_BYTES = np.zeros(max(map(ord, byte_symbols())) + 1, dtype=np.uint8)
_BYTES[[ord(s) for s in byte_symbols()]] = np.arange(256, dtype=np.uint8)


def bytes_of_forms(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that forms in the byte alphabet stand for, one after the other,
    and the end of each form."""
    ends = np.cumsum(np.fromiter(map(len, forms), np.int64, len(forms)))
    points = np.frombuffer("".join(forms).encode("utf-16-le"), dtype=np.uint16)
    return _BYTES[points], ends


class Trie:
    """Tokens over bytes. The child of node ``s`` by byte ``c`` is ``base[s] + c``
    if ``check`` there is ``s``; ``value`` is the token of a node, or -1."""

    def __init__(self, tokens: Iterable[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for token, value in tokens:
            node = 0
            for byte in token:
                following = children[node].get(byte)
                if following is None:
                    following = len(children)
                    children[node][byte] = following
                    children.append({})
                    values.append(-1)
                node = following
            values[node] = value
        base, check, value = ([fill] * 256 for fill in (0, -1, -1))
        value[0] = values[0]
        holes: list[int] = []
        place = {0: 0}
        level = [0]
        while level:
            for node in level:
                own = sorted(children[node])
                if not own:
                    continue
                # a node with one child takes a gap that others left
                if len(own) == 1 and holes:
                    first = holes.pop()
                else:
                    first = len(check)
                    span = own[-1] - own[0] + 1
                    base += [0] * span
                    check += [-1] * span
                    value += [-1] * span
                    holes += [first + c - own[0] for c in range(own[0], own[-1]) if c not in children[node]]
                at = place[node]
                base[at] = first - own[0]
                for c in own:
                    child = children[node][c]
                    slot = first + c - own[0]
                    check[slot], value[slot], place[child] = at, values[child], slot
            level = [child for node in level for child in children[node].values()]
        # the last node's row may be asked for any byte
        self.base = np.array(base + [0] * 256, dtype=np.int32)
        self.check = np.array(check + [-1] * 256, dtype=np.int32)
        self.value = np.array(value + [-1] * 256, dtype=np.int32)

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and token of the longest match at every place; ``stop`` is the
        end of the word at each place. 0 and -1 without a match."""
        size = np.zeros(len(data), dtype=np.int32)
        token = np.full(len(data), -1, dtype=np.int32)
        place = np.arange(len(data))
        state = np.zeros(len(data), dtype=np.int32)
        depth = 0
        while len(place):
            at = place + depth
            inside = at < stop[place]
            if not inside.all():
                place, state, at = place[inside], state[inside], at[inside]
            following = self.base[state] + data[at]
            known = self.check[following] == state
            place, state = place[known], following[known]
            depth += 1
            value = self.value[state]
            hit = value >= 0
            size[place[hit]] = depth
            token[place[hit]] = value[hit]
        return size, token

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a left-to-right walk of longest matches through the words
        from ``starts`` to ``ends``, and their number in each word. A place
        without a match is passed over."""
        stop = np.zeros(len(data), dtype=np.int64)
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        # the places of the words; words may be cut short, so there may be gaps
        places = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        stop[places] = ends[owner]
        size, token = self.longest(data, stop)
        visited = np.zeros(len(data), dtype=bool)
        at, limit = starts[lengths > 0], ends[lengths > 0]
        while len(at):
            visited[at] = True
            at = at + np.maximum(size[at], 1)
            inside = at < limit
            at, limit = at[inside], limit[inside]
        given = visited[places] & (token[places] >= 0)
        return token[places][given], np.bincount(owner[given], minlength=len(starts))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
