"""A weighted finite-state grammar over the words of a clause.

Small transducers read word classes and rewrite them: targets before and after insults, threats, negation and reported speech. Composed they are one deterministic machine, so a clause is read once from left to right.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

#: Words after a target (or before it) that an insult may be aimed at it, words that a negation reaches, and words between
#: an intention and the harm.
REACH, SCOPE, INTENT = 3, 3, 4

# Fixed word lists of the grammar, by class.
TARGETS = "you your yours yourself ya they them their he she him her these those people du dich dir ihr euch sie ihn tu toi te vous ton ta ils elle ellos usted ustedes tú ti vosotros".split()
NEGATIONS = "not no never nobody none isn aren wasn don doesn didn without hardly nicht kein keine keinen nie niemals pas jamais aucun aucune ne nunca jamás ningún ninguna sin".split()
REPORTS = "said says say saying told tells called calls calling wrote writes claimed quote quoted according sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
INTENTIONS = "will ll gonna going want should must shall werde werden soll vais va veux dois voy quiero debo".split()
QUOTES = '"“”„«»'

#: Prior weight of each kind of match, in logits per doubling of evidence.
PRIOR = {
    "insult": 1.5, "aimed insult": 2.0, "denied insult": 0.5, "told insult": 0.7,
    "harm": 0.3, "threat": 2.0, "aimed threat": 2.5, "denied threat": 0.3, "told threat": 0.7,
}

Step = Callable[[Hashable, str], tuple[Hashable, str]]


def _targets(state: int, symbol: str) -> tuple[int, str]:
    """An insult up to ``REACH`` words after a target is aimed at it."""
    if symbol in ("end", "target"):
        return (0 if symbol == "target" else REACH + 1), symbol
    since = min(state + 1, REACH + 1)
    return since, "aimed insult" if symbol == "insult" and since <= REACH else symbol


def _late_targets(state: int, symbol: str) -> tuple[int, str]:
    """Insults that aren't aimed wait for a target that follows."""
    if symbol == "insult":
        return REACH, symbol
    if symbol == "target" and state:
        return 0, "aims"
    return (0 if symbol == "end" else max(state - 1, 0)), symbol


def _threats(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
    """Harm soon after an intention is a threat; a target soon after it aims it."""
    intent, pending = state
    if symbol == "end":
        return (0, 0), symbol
    if symbol == "intent":
        return (INTENT, 0), symbol
    if symbol == "harm":
        return (0, REACH), "threat" if intent else symbol
    if symbol == "target" and pending:
        return (intent, 0), "aims threat"
    return (max(intent - 1, 0), max(pending - 1, 0)), symbol


def _negation(state: int, symbol: str) -> tuple[int, str]:
    """What stands in the scope of a negation is denied."""
    if symbol == "negation":
        return SCOPE, symbol
    out = symbol
    if state and symbol in ("insult", "aimed insult"):
        out = "denied insult"
    elif state and symbol in ("threat", "harm"):
        out = "denied threat"
    return (0 if symbol == "end" else max(state - 1, 0)), out


def _reports(state: tuple[bool, bool], symbol: str) -> tuple[tuple[bool, bool], str]:
    """After a verb of saying, or inside quotation marks, matches are told, not said."""
    said, quoted = state
    if symbol == "end":
        return (False, False), symbol
    if symbol == "report":
        return (True, quoted), symbol
    if symbol == "quote":
        return (said, not quoted), symbol
    if said or quoted:
        if symbol in ("insult", "aimed insult"):
            return state, "told insult"
        if symbol in ("threat", "harm"):
            return state, "told threat"
    return state, symbol


class Machine:
    """The composition of transducers: the output of each is the input of the next. States are found as they are reached."""

    def __init__(self, parts: Iterable[tuple[Step, Hashable]]):
        self.steps, starts = zip(*parts, strict=True)
        self.start = tuple(starts)
        self.arcs: dict[tuple, tuple[tuple, str]] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            after, out = [], symbol
            for part, own in zip(self.steps, state, strict=True):
                own, out = part(own, out)
                after.append(own)
            arc = self.arcs[state, symbol] = (tuple(after), out)
        return arc

    def matches(self, symbols: Iterable[str]) -> list[str]:
        """Output of each symbol of a clause, which ends after the last one."""
        state, out = self.start, []
        for symbol in symbols:
            state, made = self.step(state, symbol)
            out.append(made)
        return out


def grammar() -> Machine:
    return Machine([(_targets, REACH + 1), (_late_targets, 0), (_threats, (0, 0)), (_negation, 0), (_reports, (False, False))])


_CLASS = {
    **dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"), **dict.fromkeys(REPORTS, "report"),
    **dict.fromkeys(INTENTIONS, "intent"), **dict.fromkeys(QUOTES, "quote"),
}
KINDS = list(PRIOR)


def clause_evidence(machine: Machine, tokens: list[str], anchors: dict[int, tuple[str, float]]) -> dict[str, float]:
    """Strength of each kind of match in a clause; ``anchors`` has the class (insult, harm) and strength of tokens by place."""
    symbols = [anchors[i][0] if i in anchors else _CLASS.get(t, "word") for i, t in enumerate(tokens)]
    found: dict[str, float] = {}
    last: tuple[str, float] | None = None
    for i, kind in enumerate(machine.matches(symbols)):
        if kind in ("aims", "aims threat"):
            if last and last[0] in ("insult", "threat"):
                found[last[0]] -= last[1]
                found[f"aimed {last[0]}"] = found.get(f"aimed {last[0]}", 0.0) + last[1]
                last = None
        elif i in anchors and kind in PRIOR:
            last = (kind, anchors[i][1])
            found[kind] = found.get(kind, 0.0) + last[1]
    return found
