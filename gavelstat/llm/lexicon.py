"""A word lexicon as a minimal acyclic automaton whose words have numbers.

Words that end alike share states.  Every edge knows how many words sort before those that pass through it, so
a walk sums up the word's number; the number finds the word's output ids.  All parts are flat integer arrays in
one file, which readers map into memory.
"""

from __future__ import annotations

import mmap

import numpy as np

PARTS = ("starts", "finals", "labels", "targets", "skips", "offsets", "outputs")


def compile_words(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` with their output ids, as the bytes of a file."""
    ordered = sorted(words)
    nodes: list[list[tuple[int, int]]] = []  # edges of each finished state
    finals: list[bool] = []
    counts: list[int] = []  # words from each state on
    known: dict[tuple, int] = {}

    def finish(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(nodes)
            nodes.append(edges)
            finals.append(final)
            counts.append(final + sum(counts[t] for _, t in edges))
        return known[key]

    # the path of the last word: [final, edges to finished states, label to the next on the path]
    path: list[list] = [[False, [], -1]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges, _ = path.pop()
            path[-1][1].append((path[-1][2], finish(final, edges)))

    for word in ordered:
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        close(shared)
        for label in word[shared:]:
            path[-1][2] = label
            path.append([False, [], -1])
        path[-1][0] = True
        last = word
    close(0)
    root = finish(path[0][0], path[0][1])
    starts, labels, targets, skips = [0], [], [], []
    for state, edges in enumerate(nodes):
        before = int(finals[state])
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += counts[target]
        starts.append(len(labels))
    outputs = [words[w] for w in ordered]
    offsets = np.cumsum([0] + [len(o) for o in outputs])
    arrays = [starts, finals, labels, targets, skips, offsets, [i for o in outputs for i in o]]
    parts = [np.asarray(a, "<i4") for a in arrays]
    head = np.asarray([root, *map(len, parts)], "<i4")
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """Look words up in a compiled file."""

    def __init__(self, path: str, at: int = 0):
        """``at``: where the automaton begins in the file, in bytes."""
        with open(path, "rb") as file:
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(mapped, "<i4", offset=at)
        self.root, *sizes = numbers[: len(PARTS) + 1].tolist()
        ends = np.cumsum([len(PARTS) + 1, *sizes])
        self.parts = {name: numbers[a:b] for name, a, b in zip(PARTS, ends, ends[1:])}
        self.ends = (4 * self.parts["offsets"]).tolist()
        self.outputs = memoryview(mapped)[at + 4 * ends[-2] :]
        # edges stand in the order of state and label
        states = np.repeat(np.arange(len(self.parts["finals"])), np.diff(self.parts["starts"]))
        self.edges = states * 256 + self.parts["labels"]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' places in sorted order, -1 for unknown ones; all walk through the automaton in step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        labels = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.root, np.int64)
        number = np.zeros(len(words), np.int64)
        walking = np.arange(len(words))
        depth = 0
        while True:
            done = sizes[walking] == depth
            ended = walking[done]
            number[ended] = np.where(self.parts["finals"][state[ended]], number[ended], -1)
            walking = walking[~done]
            if not len(walking) or not len(self.edges):
                number[walking] = -1
                return number
            wanted = state[walking] * 256 + labels[begins[walking] + depth]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            found = self.edges[edge] == wanted
            number[walking[~found]] = -1
            walking, edge = walking[found], edge[found]
            number[walking] += self.parts["skips"][edge]
            state[walking] = self.parts["targets"][edge]
            depth += 1

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """Output ids of every word as little-endian 32-bit integers, None for unknown words."""
        ends, outputs = self.ends, self.outputs
        return [None if n < 0 else bytes(outputs[ends[n] : ends[n + 1]]) for n in self.numbers(words).tolist()]
