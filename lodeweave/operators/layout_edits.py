"""Edits of where cards stand on their papers, as a log that is folded paper by paper.

``regions`` moves a card, ``renumber`` names it anew, ``add`` makes one,
``split`` and ``merge`` replace cards by others. Each operation says which
revision of the layout and of its source cards it has seen and is refused if
these have changed; a request that comes again is answered by its first receipt.
``undo`` applies the inverse of the newest operation, which holds the few cards
that it touched, never a copy of all. ``edit`` stands for a change of a card's
content and ``pages`` for one of the page order: both outdate what was seen.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame

from .sequences import streamed_groups

# Sources and targets that each kind of operation takes, at least and at most; the highest number.
TAKES = {"regions": ((1, 1), (1, 1)), "renumber": ((1, 1), (1, 1)), "add": ((0, 0), (1, 1)), "split": ((1, 1), (2, 12)), "merge": ((2, 12), (1, 1))}
HIGHEST = 999

REGION = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
OPERATION = f"paper_id long, op_id long, request string, kind string, expected int, sources array<int>, seen array<int>, targets array<struct<number:int,grp:int,regions:array<{REGION}>>>"
RECEIPT = "paper_id long, op_id long, outcome string, reason string, revision int, sources array<int>, created array<int>, cards int, answers long"
CARD = f"paper_id long, card int, number int, grp int, regions array<{REGION}>, revision int"


def _list(value) -> list:
    return [] if value is None else list(value)


def _boxes(value) -> tuple:
    return tuple(tuple(r[k] for k in ("page", "x0", "y0", "x1", "y1")) for r in _list(value))


def _valid(boxes: tuple) -> bool:
    return bool(boxes) and all(None not in b and b[0] >= 0 and 0 <= b[1] < b[3] <= 1000 and 0 <= b[2] < b[4] <= 1000 for b in boxes)


class _Refused(Exception):
    """Why an operation changes nothing."""


class _Paper:
    """The cards of one paper while its log is folded. A card is (number, group, boxes, revision, live)."""

    def __init__(self, paper_id: int):
        self.paper_id = paper_id
        self.cards: dict[int, tuple] = {}
        self.held: dict[tuple, int] = {}  # (group, number) of live cards
        self.revision = self.epoch = self.live = 0
        self.newest = None  # (inverse, revisions reached, layout revision, epoch) of the newest operation
        self.receipts: dict[str, tuple] = {}

    def put(self, card: int, state: tuple) -> None:
        old = self.cards.get(card)
        if old and old[4]:
            self.held.pop((old[1], old[0]), None)
            self.live -= 1
        self.cards[card] = state
        if state[4]:
            self.held[state[1], state[0]] = card
            self.live += 1

    def change(self, op) -> tuple[str, list, list]:
        """Outcome, sources and created cards of one operation."""
        if op.kind == "edit":  # content changes, the layout does not
            for card in _list(op.sources):
                if card in self.cards:
                    self.put(card, (*self.cards[card][:3], self.cards[card][3] + 1, self.cards[card][4]))
            return "noted", _list(op.sources), []
        if op.kind == "pages":
            self.epoch += 1
            return "noted", [], []
        if op.expected == op.expected and op.expected is not None and int(op.expected) != self.revision:
            raise _Refused("stale")
        if op.kind == "undo":
            return self.undo()
        if op.kind not in TAKES:
            raise _Refused("kind")
        sources, targets = [int(c) for c in _list(op.sources)], _list(op.targets)
        (low, high), (least, most) = TAKES[op.kind]
        if not (low <= len(sources) <= high and least <= len(targets) <= most):
            raise _Refused("count")
        if len(set(sources)) < len(sources):
            raise _Refused("repeated")
        old = [self.cards.get(c) for c in sources]
        if not all(s and s[4] for s in old):
            raise _Refused("missing")
        if op.seen is not None and [int(r) for r in op.seen] != [s[3] for s in old]:
            raise _Refused("changed")
        if len({s[1] for s in old}) > 1:
            raise _Refused("groups")
        boxes = [_boxes(t["regions"]) for t in targets]
        if op.kind != "renumber" and not all(map(_valid, boxes)):
            raise _Refused("regions")
        places = [(old[0][1] if old else t["grp"], t["number"]) for t in targets]
        if op.kind != "regions":
            if not all(n is not None and 1 <= n <= HIGHEST for _, n in places):
                raise _Refused("number")
            if len(set(places)) < len(places) or any(p in self.held and self.held[p] not in sources for p in places):
                raise _Refused("taken")
        if op.kind in ("regions", "renumber"):
            number, group, had, revision, _ = old[0]
            now = (number, group, boxes[0]) if op.kind == "regions" else (places[0][1], group, had)
            if now == (number, group, had):
                return "unchanged", sources, []
            after = {sources[0]: (*now, revision + 1, True)}
        else:
            after = {c: (*s[:2], (), s[3] + 1, False) for c, s in zip(sources, old)}  # an undo has their boxes
            new = range(len(self.cards) + 1, len(self.cards) + 1 + len(targets))  # cards that are gone keep their ids
            after |= {c: (n, g, b, 0, True) for c, (g, n), b in zip(new, places, boxes)}
        self.apply(after)
        created = [c for c in after if c not in sources]
        return "applied", sources, created

    def apply(self, after: dict) -> None:
        before = {c: self.cards.get(c) for c in after}
        for c, s in after.items():
            self.put(c, s)
        self.revision += 1
        self.newest = (before, {c: s[3] for c, s in after.items()}, self.revision, self.epoch)

    def undo(self) -> tuple[str, list, list]:
        if self.newest is None:
            raise _Refused("nothing")
        before, reached, revision, epoch = self.newest
        if epoch != self.epoch:
            raise _Refused("pages")
        if revision != self.revision:
            raise _Refused("later")
        if any(self.cards[c][3] != r for c, r in reached.items()):
            raise _Refused("touched")
        for c, s in before.items():  # what it made first, so that numbers are free again
            if s is None:
                self.put(c, (*self.cards[c][:2], (), reached[c] + 1, False))
        for c, s in before.items():
            if s is not None:
                self.put(c, (*s[:3], reached[c] + 1, True))
        self.revision += 1
        self.newest = (before, reached, 0, self.epoch)  # undone: nothing else can be
        return "undone", [c for c, s in before.items() if s is not None], [c for c, s in before.items() if s is None]

    def step(self, op) -> tuple:
        """The receipt of one operation."""
        said = blake2b(repr((op.kind, _list(op.sources), None if op.seen is None else _list(op.seen), [(t["number"], t["grp"], _boxes(t["regions"])) for t in _list(op.targets)])).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if op.request is not None and op.request in self.receipts:
            first, was, receipt = self.receipts[op.request]
            if was != said:
                return op.paper_id, op.op_id, "refused", "request", self.revision, [], [], self.live, None
            return op.paper_id, op.op_id, "replayed", None, *receipt, self.live, first
        try:
            outcome, sources, created = self.change(op)
        except _Refused as why:  # a refused request may come again
            return op.paper_id, op.op_id, "refused", str(why), self.revision, [], [], self.live, None
        if op.request is not None:
            self.receipts[op.request] = (op.op_id, said, (self.revision, sources, created))
        return op.paper_id, op.op_id, outcome, None, self.revision, sources, created, self.live, None


def receipts(log: DataFrame) -> DataFrame:
    """What each operation of ``log`` (columns of ``OPERATION``) did: outcome, reason, revision, cards.

    Outcomes are applied, unchanged, undone, noted, replayed (``answers`` is the
    operation that it repeats) and refused with a reason. A null ``expected`` or
    ``seen`` takes what is current, a null request is never a repetition.
    Operations follow each other by op_id. Each costs time by the cards it names.
    A task holds a paper's cards and what answers its requests, never its log.
    """

    return streamed_groups(log, "paper_id", ["op_id"], lambda first: _Paper(first.paper_id), _Paper.step, None, RECEIPT)


def cards_after(log: DataFrame) -> DataFrame:
    """The live cards of each paper after its log."""

    def live(paper: _Paper) -> list[tuple]:
        name = lambda b: dict(zip(("page", "x0", "y0", "x1", "y1"), b))
        return [(paper.paper_id, c, s[0], s[1], [name(b) for b in s[2]], s[3]) for c, s in paper.cards.items() if s[4]]

    return streamed_groups(log, "paper_id", ["op_id"], lambda first: _Paper(first.paper_id), lambda paper, op: paper.step(op) and None, live, CARD)
