"""Weighted repair of symbol sequences against a grammar, by generalised LR parsing.

The grammar's LR(0) automaton is built from its productions. A parse keeps a graph-structured stack: a node is
a state with links to the nodes below it; shifting a symbol puts a node on a top, reductions follow every
path down. Tops of one state are merged: links are united, and the smaller (cost, audit) stays. That is exact for
grammars in which tops of one state have one future (``Automaton`` checks it).

Rows are read from the last to the first, against the mirrored grammar. So an audit grows at its front,
and audits of one cost are compared by their first letter and the rank of what follows, never as strings. The
frontier (states, costs less the least, ranks) takes few values, so each step is looked up in a table once it
has been made.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

#: Costs of edits, and of a row with a truncated text that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Faults of rows.
FINE, BLANK, REPEATED, CUT = range(4)
#: ``(s?(ua)+)?`` from its end to its begin.
MIRRORED = (("Talk", ()), ("Talk", ("Body",)), ("Talk", ("Body", "s")), ("Body", ("Pair",)), ("Body", ("Body", "Pair")), ("Pair", ("a", "u")))
#: Symbols that a row may be given.
FREE = "ua"


class Node(NamedTuple):
    """A node of the stack: an automaton state and the nodes below."""

    state: int
    below: frozenset[Node]


class Automaton:
    """LR(0) states of a grammar, and the stack work on them."""

    def __init__(self, productions: tuple = MIRRORED):
        self.productions = (("", (productions[0][0],)), *productions)
        self.heads = {head for head, _ in productions}
        first = self._closed({(0, 0)})
        self.states, self.moves = [first], [{}]
        for state, items in enumerate(self.states):  # grows while it is read
            nexts: dict[str, set] = {}
            for p, dot in items:
                body = self.productions[p][1]
                if dot < len(body):
                    nexts.setdefault(body[dot], set()).add((p, dot + 1))
            for symbol, kernel in sorted(nexts.items()):
                made = self._closed(kernel)
                if made not in self.states:
                    self.states.append(made)
                    self.moves.append({})
                self.moves[state][symbol] = self.states.index(made)
        self.root = Node(0, frozenset())
        self.nodes = self._live_nodes()

    def _closed(self, items: set) -> frozenset:
        done = set(items)
        todo = list(items)
        while todo:
            p, dot = todo.pop()
            body = self.productions[p][1]
            if dot < len(body) and body[dot] in self.heads:
                for q, (head, _) in enumerate(self.productions):
                    if head == body[dot] and (q, 0) not in done:
                        done.add((q, 0))
                        todo.append((q, 0))
        return frozenset(done)

    def _reduced(self, node: Node) -> list[Node]:
        """``node`` and all tops that reductions make of it."""
        out, todo = [], [node]
        while todo:
            top = todo.pop()
            if top in out:
                continue
            out.append(top)
            for p, dot in self.states[top.state]:
                head, body = self.productions[p]
                if p and dot == len(body):
                    bottoms = {top}
                    for _ in body:
                        bottoms = {n for b in bottoms for n in b.below}
                    todo += [Node(self.moves[b.state][head], frozenset([b])) for b in bottoms]
        return out

    def shifted(self, node: Node, symbol: str) -> list[Node]:
        """Tops that can read on, or where a parse may end, after ``symbol`` has been shifted on ``node``."""
        state = self.moves[node.state].get(symbol)
        if state is None:
            return []
        tops = self._reduced(Node(state, frozenset([node])))
        return [t for t in tops if self._stays(t.state)]

    def _stays(self, state: int) -> bool:
        """Whether a state reads symbols or is the whole of a start production."""
        whole = any(p and dot == len(self.productions[p][1]) and self.productions[p][0] == self.productions[0][1][0] for p, dot in self.states[state])
        return whole or any(s not in self.heads for s in self.moves[state])

    def ends(self, node: Node) -> bool:
        """Whether a parse may end at ``node``: only reductions to the start symbol are left."""
        return any((0, 1) in self.states[t.state] for t in self._reduced(node))

    def _live_nodes(self) -> dict[int, Node]:
        """One node for each state that can be a top, its links united."""
        symbols = sorted({s for _, body in self.productions for s in body if s not in self.heads})
        found = {0: self.root}
        grown = True
        while grown:
            grown = False
            for node in list(found.values()):
                for symbol in symbols:
                    for top in self.shifted(node, symbol):
                        known = found.get(top.state)
                        united = Node(top.state, (known.below if known else frozenset()) | top.below)
                        if known != united:
                            found[top.state] = united
                            grown = True
        for state, node in found.items():
            for symbol in symbols:
                for below in node.below:
                    if {t.state for t in self.shifted(Node(state, frozenset([below])), symbol)} != {t.state for t in self.shifted(node, symbol)}:
                        raise ValueError("tops of one state have different futures")
        return found


class Step(NamedTuple):
    """A frontier after a row: entries by (lane, state), and what was added to the least cost."""

    frontier: tuple
    added: int
    #: (lane, state) → (state before, edits as (letter, symbol) from the row on).
    back: dict


class Repairer:
    """Cheapest edits of rows, from the last row to the first.

    A frontier is a tuple of (lane, node, cost, rank). Lanes are independent parses that share ranks: a whole
    conversation has one, a part whose end isn't the conversation's has one for each possible top there.
    """

    def __init__(self, automaton: Automaton | None = None):
        self.automaton = automaton or Automaton()
        self.steps: dict[tuple, Step] = {}
        self.states = sorted(self.automaton.nodes)
        self.ending = [s for s in self.states if self.automaton.ends(self.automaton.nodes[s])]

    def start(self) -> Step:
        """The frontier behind the last row, insertions included."""
        return self._finished({(0, 0): (self.automaton.root, 0, (), 0, ())})

    def open_start(self) -> Step:
        """A lane for each top, at a border inside a conversation. Insertions there belong to the row before."""
        nodes = self.automaton.nodes
        return self._finished({(s, s): (nodes[s], 0, (), s, ()) for s in self.states}, inserts=False)

    def lane_start(self, state: int) -> Step:
        return self._finished({(state, state): (self.automaton.nodes[state], 0, (), state, ())}, inserts=False)

    def step(self, frontier: tuple, symbol: str, fault: int) -> Step:
        """The frontier before a row whose role has the initial ``symbol``."""
        key = (frontier, symbol, fault)
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._made(frontier, symbol, fault)
        return found

    def _made(self, frontier: tuple, symbol: str, fault: int) -> Step:
        made: dict = {}
        stays = TRUNCATED if fault == CUT else 0
        for lane, node, cost, rank in frontier:
            self._offer(made, lane, node, cost + DELETE, ("D", rank), node.state, (("D", ""),))
            if fault in (BLANK, REPEATED):
                continue
            for top in self.automaton.shifted(node, symbol):
                self._offer(made, lane, top, cost + stays, ("K", rank), node.state, (("K", symbol),))
            for free in FREE:
                for top in self.automaton.shifted(node, free):
                    self._offer(made, lane, top, cost + REROLE + stays, ("R", rank), node.state, (("R", free),))
        return self._finished(made)

    @staticmethod
    def _offer(made: dict, lane: int, node: Node, cost: int, key: tuple, before: int, edits: tuple) -> bool:
        """Merges a top into those of its state: links united, the smaller (cost, audit) stays."""
        place = (lane, node.state)
        known = made.get(place)
        if known is None:
            made[place] = (node, cost, key, before, edits)
            return True
        united = Node(node.state, known[0].below | node.below)
        better = (cost, key) < (known[1], known[2])
        made[place] = (united, cost, key, before, edits) if better else (united, *known[1:])
        return better

    def _finished(self, made: dict, inserts: bool = True) -> Step:
        """Adds insertions before the row, cheapest tops first, then ranks audits and takes off the least cost."""
        todo = set(made) if inserts else set()
        while todo:
            place = min(todo, key=lambda p: (made[p][1], made[p][2]))
            todo.remove(place)
            node, cost, key, before, edits = made[place]
            for free in FREE:
                for top in self.automaton.shifted(node, free):
                    if self._offer(made, place[0], top, cost + INSERT, ("I", *key), before, (("I", free), *edits)):
                        todo.add((place[0], top.state))
        order = {k: r for r, k in enumerate(sorted({m[2] for m in made.values()}))}
        least = min(m[1] for m in made.values())
        frontier = tuple(sorted(((p[0], m[0], m[1] - least, order[m[2]]) for p, m in made.items()), key=lambda x: (x[0], x[1].state)))
        return Step(frontier, least, {p: (m[3], m[4]) for p, m in made.items()})

    def run(self, rows: Iterable[tuple[str, int]], begin: Step) -> tuple[tuple, int, list[Step]]:
        """Reads ``rows``, given from the last to the first: the last frontier, its least cost, and all steps."""
        frontier, cost, steps = begin.frontier, begin.added, [begin]
        for symbol, fault in rows:
            made = self.step(frontier, symbol, fault)
            frontier, cost = made.frontier, cost + made.added
            steps.append(made)
        return frontier, cost, steps

    def best_end(self, frontier: tuple, cost: int) -> tuple[int, int]:
        """(cost, state) of the cheapest top at which a conversation may begin."""
        least, _, state = min((c, r, node.state) for _, node, c, r in frontier if node.state in self.ending)
        return cost + least, state

    @staticmethod
    def edits(steps: list[Step], lane: int, state: int) -> list[tuple]:
        """Edits of each row, from the first row on; the last entry holds insertions behind the last row."""
        out = []
        for made in reversed(steps):
            state, edits = made.back[(lane, state)]
            out.append(edits)
        return out
