"""Context-free rules with up to two symbols on the right, and what can be told from them alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """lhs ::= nothing, rhs1, or rhs1 rhs2."""

    lhs: str
    rhs1: str | None = None
    rhs2: str | None = None

    def __post_init__(self) -> None:
        if not self.lhs or self.rhs1 == "" or self.rhs2 == "" or (self.rhs2 is not None and self.rhs1 is None):
            raise ValueError(f"not a rule: {self!r}")


class Grammar:
    """A set of rules, in the order given, without repeats."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(dict.fromkeys(rules))

    @classmethod
    def of(cls, *rules: str) -> Grammar:
        """From rules like "A ::= B C"; nothing after the sign makes an empty right side."""
        out = []
        for text in rules:
            head, sign, body = text.partition("::=")
            parts = body.split()
            if not sign or len(head.split()) != 1 or len(parts) > 2:
                raise ValueError(f"not a rule: {text!r}")
            out.append(Rule(head.strip(), *parts))
        return cls(out)

    @classmethod
    def parse(cls, text: str) -> Grammar:
        """From a file's text: the number of rules, then a rule a line, its one to three symbols between tabs.

        Lines that start with # and blank lines do not count, nor do carriage returns at line ends. Raises ValueError
        for a wrong number of rules or of symbols.
        """
        lines = [x.rstrip("\r\n") for x in text.split("\n")]
        lines = [x for x in lines if x.strip() and not x.startswith("#")]
        if not lines or not lines[0].strip().isdigit():
            raise ValueError("a grammar starts with its number of rules")
        if len(lines) - 1 != int(lines[0]):
            raise ValueError(f"{lines[0]} rules announced, {len(lines) - 1} found")
        rules = []
        for x in lines[1:]:
            parts = [p for p in x.split("\t") if p]
            if not 1 <= len(parts) <= 3:
                raise ValueError(f"not a rule: {x!r}")
            rules.append(Rule(*parts))
        return cls(rules)

    def to_text(self) -> str:
        return "\n".join([str(len(self.rules)), *("\t".join(x for x in (r.lhs, r.rhs1, r.rhs2) if x is not None) for r in self.rules)]) + "\n"

    @property
    def epsilon(self) -> list[Rule]:
        return [r for r in self.rules if r.rhs1 is None]

    @property
    def unit(self) -> list[Rule]:
        return [r for r in self.rules if r.rhs1 is not None and r.rhs2 is None]

    @property
    def binary(self) -> list[Rule]:
        return [r for r in self.rules if r.rhs2 is not None]

    @property
    def nonterminals(self) -> set[str]:
        return {r.lhs for r in self.rules}

    @property
    def labels(self) -> list[str]:
        """Every symbol, in order of first appearance."""
        return list(dict.fromkeys(x for r in self.rules for x in (r.lhs, r.rhs1, r.rhs2) if x is not None))

    def dataflow_faults(self) -> list[str]:
        """Why the right operands of joins could grow; none of it if dataflow mode gives the whole closure."""
        heads = self.nonterminals
        return [f"unit rule {r.lhs} ::= {r.rhs1}" for r in self.unit] + [f"{r.rhs2} in {r.lhs} ::= {r.rhs1} {r.rhs2} is derived" for r in self.binary if r.rhs2 in heads]

    def sliced(self, wanted: Iterable[str]) -> Grammar:
        """The rules that can matter to the wanted labels."""
        need, more = set(), set(wanted)
        while more:
            need |= more
            more = {x for r in self.rules if r.lhs in need for x in (r.rhs1, r.rhs2) if x is not None} - need
        return Grammar(r for r in self.rules if r.lhs in need)

    def chain(self) -> tuple[str, str, bool] | None:
        """(P, x, whether x comes last) for a P whose only rules are P ::= P x (or x P) and P ::= x or P ::= , x being the head of no rule left.

        With P ::= x both derive one x or more; with P ::= any number of x. None if there is no such P.
        """
        for r in self.rules:
            own = [q for q in self.rules if q.lhs == r.lhs]
            if r.rhs2 is None or (r.rhs1 == r.lhs) == (r.rhs2 == r.lhs) or len(own) != 2:
                continue
            x = r.rhs2 if r.rhs1 == r.lhs else r.rhs1
            if x not in self.nonterminals and (Rule(r.lhs, x) in own or Rule(r.lhs) in own):
                return r.lhs, x, r.rhs1 == r.lhs
        return None

    def without(self, head: str) -> Grammar:
        """The rules of other heads."""
        return Grammar(r for r in self.rules if r.lhs != head)


def normalized(lhs: str, *rhs: str) -> list[Rule]:
    """Rules of at most two symbols for one of any length, with new symbols for what goes on."""
    rules, head = [], lhs
    while len(rhs) > 2:
        new = f"{lhs}<{' '.join(rhs[1:])}>"
        rules.append(Rule(head, rhs[0], new))
        head, rhs = new, rhs[1:]
    return [*rules, Rule(head, *rhs)]
