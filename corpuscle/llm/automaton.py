"""Levenshtein automata of all terms of a lexicon at once, run along its trie.

The product of the trie with the edit counter is a nondeterministic automaton whose
states are (trie node, edits so far). It is made deterministic while it reads: each
set of states met becomes one state of a table, so a word costs one lookup a letter
and is left as soon as no term can still be reached.
"""

from __future__ import annotations


def allowed_edits(term: str) -> int:
    """Edits within which a word counts as a misspelling of ``term``."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Finds the term of a lexicon that a word is, or is a misspelling of, and the stems that it begins with.

    Stems lie in the same trie and allow no edits: passing the end of one is enough.
    """

    #: Entries of the transition table after which it is begun anew.
    TABLE = 400_000

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.reach: list[int] = [0]  # the most edits that a term below a node allows
        self.stem_ends: dict[int, int] = {}
        for i, term in enumerate(self.terms):
            self.ends[self._path(term, allowed_edits(term))] = i
        for i, stem in enumerate(self.stems):
            self.stem_ends[self._path(stem, 0)] = i
        self._begin()

    def _path(self, letters: str, edits: int) -> int:
        """The trie node at the end of ``letters``, made if need be; nodes on the way reach so many edits."""
        node = 0
        self.reach[0] = max(self.reach[0], edits)
        for char in letters:
            if char not in self.children[node]:
                self.children[node][char] = len(self.children)
                self.children.append({})
                self.ends.append(-1)
                self.reach.append(0)
            node = self.children[node][char]
            self.reach[node] = max(self.reach[node], edits)
        return node

    def _begin(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.finals: list[tuple[int, int] | None] = []
        self.passed: list[tuple[int, ...]] = []
        self.entries = 0
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The id of a set of states, given each node's fewest edits; term letters may be skipped."""
        todo = list(least)
        while todo:
            node = todo.pop()
            edits = least[node] + 1
            for child in self.children[node].values():
                if edits <= self.reach[child] and edits < least.get(child, 99):
                    least[child] = edits
                    todo.append(child)
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = [(edits, self.ends[node]) for node, edits in key if self.ends[node] >= 0 and edits <= allowed_edits(self.terms[self.ends[node]])]
            self.finals.append(min(hits, default=None))
            self.passed.append(tuple(self.stem_ends[node] for node, edits in key if edits == 0 and node in self.stem_ends))
        return self.ids[key]

    def _step(self, state: int, char: str) -> int:
        least: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < least.get(node, 99):
                least[node] = edits

        for node, edits in self.sets[state]:
            put(node, edits + 1)
            for letter, child in self.children[node].items():
                put(child, edits + (letter != char))
        to = self._state(least)
        self.steps[state][char] = to
        self.entries += 1
        return to

    def read(self, word: str) -> tuple[tuple[int, int] | None, list[int]]:
        """(edits, term number) of the nearest term that allows so many edits, or None; and the numbers of the stems that the word begins with, itself not among them."""
        if self.entries > self.TABLE:
            self._begin()
        state, dead, steps, passed, stems = self.start, self.dead, self.steps, self.passed, []
        for char in word:
            if passed[state]:
                stems += passed[state]
            to = steps[state].get(char)
            state = self._step(state, char) if to is None else to
            if state == dead:
                return None, stems
        return self.finals[state], stems

    def find(self, word: str) -> tuple[int, int] | None:
        return self.read(word)[0]
