"""Minimal acyclic automata that number their words, and words at one error from a query."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Stands between parts of a rotated word (see spelling.py); an error never makes or takes one.
MARK = "\0"


class Automaton:
    """The smallest automaton of a set of words.

    Equal remainders of words share their states.  A step knows how many words come before those it leads to, so that the
    sum along a word's path is its place in the sorted set: a perfect hash, which leads to what is kept beside the words.
    """

    def __init__(self, words: Iterable[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._many: list[int] = []
        register: dict[tuple, int] = {}
        open_: list[tuple[list, list]] = [([], [])]  # of each letter of the last word: steps so far, and whether a word ends here
        last = ""

        def state(steps: list, ends: list) -> int:
            key = (bool(ends), tuple(steps))
            if key not in register:
                register[key] = len(self.steps)
                before, out = int(bool(ends)), {}
                for letter, target in steps:
                    out[letter] = target, before
                    before += self._many[target]
                self.steps.append(out)
                self.final.append(bool(ends))
                self._many.append(before)
            return register[key]

        def close(depth: int) -> None:
            for k in range(len(open_) - 1, depth, -1):
                open_[k - 1][0].append((last[k - 1], state(*open_.pop())))

        for word in sorted(set(words)):
            same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            close(same)
            open_ += [([], []) for _ in word[same:]]
            open_[-1][1].append(True)
            last = word
        close(0)
        self.root = state(*open_[0])

    def __len__(self) -> int:
        return self._many[self.root]

    def _follow(self, state: int, place: int, word: str, begin: int) -> tuple[int, int] | None:
        for letter in word[begin:] if begin else word:
            step = self.steps[state].get(letter)
            if step is None:
                return None
            state, place = step[0], place + step[1]
        return state, place

    def number(self, word: str) -> int | None:
        """The word's place in the sorted set; None for others."""
        end = self._follow(self.root, 0, word, 0)
        return end[1] if end and self.final[end[0]] else None

    def one_error(self, exact: str, rest: str) -> Iterator[int]:
        """Numbers of the words that begin with ``exact`` and go on with ``rest`` but for one letter, replaced or left out."""
        at = self._follow(self.root, 0, exact, 0)
        before = ""
        for k, letter in enumerate(rest):
            if at is None:
                return
            state, place = at
            if letter != before:  # to leave out the second of two equal letters is the same
                end = self._follow(state, place, rest, k + 1)
                if end and self.final[end[0]]:
                    yield end[1]
            for other, (target, skipped) in self.steps[state].items():
                if other != letter and other != MARK:
                    end = self._follow(target, place + skipped, rest, k + 1)
                    if end and self.final[end[0]]:
                        yield end[1]
            step = self.steps[state].get(letter)
            at = (step[0], place + step[1]) if step else None
            before = letter
