"""Generalised LR repair of token sequences at least cost.

A grammar becomes a table of shifts and reductions (SLR).  All repairs are followed at once: stacks share their
lower cells, and of repairs that arrive at the same stack top only the one with the least (cost, audit) stays.
Before every row symbols may be inserted; the row itself is kept, given another symbol or deleted.

A layer is what is alive after a row: stack tops in the order of their audits, with their costs above the least.
Few different layers occur, so each step is worked out once and then looked up.  Audits of one layer have read the
same rows and end with a row's edit, so none is the start of another, and their order stays when they grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

END = "$"


class Table:
    """Shifts, gotos and reductions of a grammar, given as (head, body) pairs, the first head being the start."""

    def __init__(self, grammar: Sequence[tuple[str, tuple[str, ...]]]):
        self.rules = [("", (grammar[0][0],)), *grammar]
        heads = {h for h, _ in self.rules}
        self.follow = self._follow(heads)
        self.states: list[frozenset] = [self._closed({(0, 0)})]
        self.to: list[dict[str, int]] = []
        for items in self.states:  # grows while it is read
            moves: dict[str, int] = {}
            for symbol in sorted({self._next(i) for i in items} - {None}):
                there = self._closed({(rule, dot + 1) for rule, dot in items if self._next((rule, dot)) == symbol})
                if there not in self.states:
                    self.states.append(there)
                moves[symbol] = self.states.index(there)
            self.to.append(moves)
        self.reductions = [
            [(self.rules[rule][0], dot) for rule, dot in sorted(items) if rule and self._next((rule, dot)) is None]
            for items in self.states
        ]
        self.accepts = [(0, 1) in items for items in self.states]

    def _next(self, item):
        body = self.rules[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            symbol = self._next(todo.pop())
            new = {(i, 0) for i, (head, _) in enumerate(self.rules) if i and head == symbol} - items
            items |= new
            todo += new
        return frozenset(items)

    def _follow(self, heads: set[str]) -> dict[str, set[str]]:
        """What may come behind each head; a set grows until nothing changes."""
        first = {h: set() for h in heads}
        empty: set[str] = set()
        follow = {h: {END} if h == "" else set() for h in heads}
        size = -1
        while size != (size := sum(map(len, (*first.values(), *follow.values(), empty)))):
            for head, body in self.rules:
                after = set(follow[head])
                for symbol in reversed(body):
                    if symbol in heads:
                        follow[symbol] |= after
                        after = first[symbol] | (after if symbol in empty else set())
                    else:
                        after = {symbol}
                if all(s in empty for s in body):
                    empty.add(head)
                for symbol in body:
                    first[head] |= first[symbol] if symbol in heads else {symbol}
                    if symbol not in empty:
                        break
        return follow


@dataclass(frozen=True)
class Cell:
    """A stack from its top down."""

    state: int
    below: Cell | None = None


@dataclass(frozen=True)
class Costs:
    rename: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


#: A layer: (stack, cost above the least) in the order of audits.
Layer = tuple[tuple[Cell, int], ...]
#: For each stack of a layer: the stack of the layer before that it comes from, and the edits in between.
Moves = tuple[tuple[int, str], ...]


class Repair:
    """Repairs of rows, each with a symbol of the grammar or another one, with scripts of edits.

    In a script K keeps a row, D deletes it, the lower-case letter of a symbol inserts it and the upper-case letter
    renames a row to it; ``audit`` turns it into the initials of Keep, Delete, Insert and Rerole.
    """

    def __init__(self, grammar, insertable: str, costs: Costs = Costs()):
        self.table, self.insertable, self.costs = Table(grammar), insertable, costs
        self.start = Cell(0)
        letters = insertable + insertable.upper()
        self._initials = str.maketrans(letters, "I" * len(insertable) + "R" * len(insertable))
        self._steps: dict[tuple, tuple[Layer, int, Moves]] = {}
        self.cells = self._reachable()
        self.number = {cell: i for i, cell in enumerate(self.cells)}

    def _reachable(self) -> list[Cell]:
        """All stacks that any tokens lead to; finite where rules repeat on their left."""
        tokens = sorted({s for _, body in self.table.rules for s in body} - {h for h, _ in self.table.rules})
        cells = [self.start]
        for cell in cells:
            cells += [c for t in tokens if (c := self.push(cell, t)) is not None and c not in cells]
        return cells

    def audit(self, script: str) -> str:
        return script.translate(self._initials)

    def push(self, cell: Cell, token: str) -> Cell | None:
        """The stack after all reductions that ``token`` allows, and the token; None where it does not fit."""
        table = self.table
        while token not in table.to[cell.state]:
            for head, size in table.reductions[cell.state]:
                if token in table.follow[head]:
                    below = cell
                    for _ in range(size):
                        below = below.below
                    cell = Cell(table.to[below.state][head], below)
                    break
            else:
                return cell if token == END and table.accepts[cell.state] else None
        return Cell(table.to[cell.state][token], cell)

    def _with_inserts(self, cell: Cell) -> list[tuple[Cell, str]]:
        """Stacks after any inserts, each with the fewest."""
        found, seen = [(cell, "")], {cell}
        for there, script in found:
            for symbol in self.insertable:
                new = self.push(there, symbol)
                if new is not None and new not in seen:
                    seen.add(new)
                    found.append((new, script + symbol))
        return found

    def step(self, layer: Layer, symbol: str, must_go: bool, truncated: bool) -> tuple[Layer, int, Moves]:
        """The layer after one row, what its least cost adds, and where its stacks come from."""
        key = (layer, symbol, must_go, truncated)
        if key not in self._steps:
            self._steps[key] = self._step(*key)
        return self._steps[key]

    def _step(self, layer, symbol, must_go, truncated):
        costs, best = self.costs, {}
        extra = costs.truncated * truncated
        for rank, (cell, cost) in enumerate(layer):
            for there, inserts in self._with_inserts(cell):
                paid = cost + costs.insert * len(inserts)
                options = [(there, paid + costs.delete, "D")]
                if not must_go:
                    options.append((self.push(there, symbol), paid + extra, "K"))
                    options += [(self.push(there, s), paid + extra + costs.rename, s.upper()) for s in self.insertable]
                for new, total, edit in options:
                    value = (total, rank, self.audit(inserts + edit), inserts + edit)
                    if new is not None and (new not in best or value < best[new]):
                        best[new] = value
        least = min(v[0] for v in best.values())
        order = sorted(best.items(), key=lambda kv: kv[1][1:])
        return tuple((c, v[0] - least) for c, v in order), least, tuple((v[1], v[3]) for _, v in order)

    def paths(self, rows: Iterable[tuple[str, bool, bool]], enter: Cell) -> list[tuple[Cell, int, str]]:
        """(stack, cost, script) of every stack that is alive after the rows, from the stack ``enter``."""
        layer, cost, taken = ((enter, 0),), 0, []
        for row in rows:
            layer, more, moves = self.step(layer, *row)
            cost += more
            taken.append(moves)
        found = []
        for at, (cell, above) in enumerate(layer):
            script = []
            for moves in reversed(taken):
                at, edits = moves[at]
                script.append(edits)
            found.append((cell, cost + above, "".join(reversed(script))))
        return found

    def finish(self, paths: Iterable[tuple[Cell, int, str]]) -> tuple[int, str]:
        """The least (cost, script) among paths that inserts can complete."""
        done = [
            (cost + self.costs.insert * len(inserts), self.audit(script + inserts), script + inserts)
            for cell, cost, script in paths for there, inserts in self._with_inserts(cell)
            if self.push(there, END) is not None
        ]
        cost, _, script = min(done)
        return cost, script
