"""A suffix automaton over integer symbols, with first occurrences and matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of a symbol sequence; every state knows where its substrings end first."""

    def __init__(self, symbols: list[int]):
        edges: list[dict[int, int]] = [{}]
        link, length, first_end = [-1], [0], [-1]
        last = 0
        for position, symbol in enumerate(symbols):
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            first_end.append(position)
            link.append(0)
            state = last
            while state >= 0 and symbol not in edges[state]:
                edges[state][symbol] = new
                state = link[state]
            if state >= 0:
                target = edges[state][symbol]
                if length[state] + 1 == length[target]:
                    link[new] = target
                else:
                    copy = len(edges)
                    edges.append(edges[target].copy())
                    length.append(length[state] + 1)
                    first_end.append(first_end[target])
                    link.append(link[target])
                    while state >= 0 and edges[state].get(symbol) == target:
                        edges[state][symbol] = copy
                        state = link[state]
                    link[target] = link[new] = copy
            last = new
        self.edges, self.link, self.length, self.first_end = edges, link, length, first_end

    def first_matches(self, symbols: list[int], window: int) -> list[int]:
        """For each place, where the window of symbols that ends there ends first in the sequence, or -1.

        The matching statistics (longest suffix that the automaton knows) are kept as a state and a length; from a
        match of at least the window, suffix links lead to the state that holds the window itself."""
        edges, link, length, first_end = self.edges, self.link, self.length, self.first_end
        out = []
        state = matched = 0
        for symbol in symbols:
            target = edges[state].get(symbol)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = edges[state].get(symbol)
            if target is not None:
                state = target
                matched += 1
            if matched < window:
                out.append(-1)
                continue
            while length[link[state]] >= window:  # longer context is not needed for the windows to come
                state = link[state]
                matched = length[state]
            out.append(first_end[state])
        return out
