"""Model formulas as text.

    correct ~ InPhaseTransition * TrialNumber + (1 + InPhaseTransition | ParticipantID)

``a:b`` is an interaction, ``a*b`` stands for ``a + b + a:b``, ``(a + b)^2`` for all
terms up to two of its factors, ``- a`` takes a term out again.  ``(1 | g)`` is a
random intercept for every ``g``, ``(x | g)`` and ``(1 + x | g)`` an intercept with a
slope.  Names that are no identifiers go between backticks.  Main effects come
first, then interactions of two, of three and so on, each in order of appearance.

Every model has an intercept (``+ 1`` is allowed, ``- 1`` and ``0`` are not) and at
most one grouping column; calls like ``log(x)`` are not formulas here: derive a
column first.  What is not understood is an error, with its place.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame

from trialstats.models.glmm import fit_glmm_grid
from trialstats.models.lmm import fit_lmm_grid
from trialstats.models.logit import fit_logit
from trialstats.models.ols import fit_ols
from trialstats.models.spec import Fit, Levels, ModelSpec

_TOKEN = re.compile(r"\s*(?:`([^`]+)`|([^\W\d][\w.]*)|(\d+)|([~+\-*:^()|]))")
# A term is the set of its variables, in order; the intercept is the empty one.
Term = tuple[str, ...]


def _joined(a: Term, b: Term) -> Term:
    return tuple(dict.fromkeys((*a, *b)))


def _distinct(terms: list[Term]) -> list[Term]:
    first: dict[frozenset, Term] = {}
    for t in terms:
        first.setdefault(frozenset(t), t)
    return list(first.values())


class _Reader:
    """Recursive descent over one formula; each method returns the terms it has read."""

    def __init__(self, text: str):
        self.text, self.at, self.tokens, self.random = text, 0, [], []
        place = 0
        while text[place:].strip():
            found = _TOKEN.match(text, place)
            if not found:
                raise ValueError(f"formula not understood at {text[place:].strip()!r}: {text}")
            quoted, name, number, sign = found.groups()
            if quoted and ":" in quoted:
                raise ValueError(f"a column with a colon can't be in a formula: {quoted}")
            kind = "name" if quoted or name else "number" if number else "sign"
            self.tokens.append((kind, quoted or name or number or sign, found.start(found.lastindex)))
            place = found.end()

    def fail(self, what: str):
        rest = self.text[self.tokens[self.at][2] :] if self.at < len(self.tokens) else "the end"
        raise ValueError(f"{what} at {rest!r}: {self.text}")

    def sees(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs

    def takes(self, *signs: str) -> str | None:
        if not self.sees(*signs):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            self.fail("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, sign: str) -> None:
        if not self.takes(sign):
            self.fail(f"{sign!r} is missing")

    def sum(self, outermost: bool = False) -> list[Term]:
        terms: list[Term] = []
        sign = self.takes("+", "-") or "+"
        while True:
            if outermost and self.bars():
                if sign == "-":
                    self.fail("a random effect can't be taken out")
                self.random.append(self.effect())
            else:
                more = self.crossed()
                if sign == "+":
                    terms = _distinct(terms + more)
                elif () in more:
                    self.fail("a model without intercept is not supported; before")
                else:
                    gone = {frozenset(t) for t in more}
                    terms = [t for t in terms if frozenset(t) not in gone]
            sign = self.takes("+", "-")
            if not sign:
                return terms

    def bars(self) -> bool:
        """Whether a bracket with a bar of its own starts here."""
        depth = 0
        for kind, token, _ in self.tokens[self.at :] if self.sees("(") else []:
            depth += (kind == "sign") * ((token == "(") - (token == ")"))
            if kind == "sign" and token == "|" and depth == 1:
                return True
            if depth == 0:
                return False
        return False

    def effect(self) -> tuple[list[Term], str]:
        self.need("(")
        terms = self.sum()
        self.need("|")
        group = self.name()
        self.need(")")
        return terms, group

    def crossed(self) -> list[Term]:
        terms = self.interacting()
        while self.takes("*"):
            more = self.interacting()
            terms = _distinct([*terms, *more, *(_joined(a, b) for a, b in product(terms, more))])
        return terms

    def interacting(self) -> list[Term]:
        terms = self.powered()
        while self.takes(":"):
            terms = _distinct([_joined(a, b) for a, b in product(terms, self.powered())])
        return terms

    def powered(self) -> list[Term]:
        terms = self.factor()
        if self.takes("^"):
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "number" or int(self.tokens[self.at][1]) < 1:
                self.fail("a power is missing")
            once = terms
            for _ in range(min(int(self.tokens[self.at][1]), len(once)) - 1):
                terms = _distinct([*terms, *(_joined(a, b) for a, b in product(terms, once))])
            self.at += 1
        return terms

    def factor(self) -> list[Term]:
        if self.takes("("):
            terms = self.sum()
            self.need(")")
            return terms
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            if self.tokens[self.at][1] != "1":
                self.fail("a number that is not 1")
            self.at += 1
            return [()]
        return [(self.name(),)]


def parse(text: str, name: str | None = None, family: str = "gaussian") -> ModelSpec:
    """The specification that a formula stands for; ``name`` is the formula itself if absent."""
    reader = _Reader(text)
    outcome = reader.name()
    reader.need("~")
    terms = [t for t in reader.sum(outermost=True) if t]
    if reader.at < len(reader.tokens):
        reader.fail("formula not understood")
    if len(reader.random) > 1:
        raise ValueError(f"at most one grouping column: {text}")
    group = slope = None
    for effects, group in reader.random:
        slopes = [t for t in effects if t]
        if len(slopes) > 1:
            raise ValueError(f"at most one random slope: {text}")
        slope = ":".join(slopes[0]) if slopes else None
    if outcome in {v for t in terms for v in t}:
        raise ValueError(f"the outcome is also a predictor: {text}")
    fixed = tuple(":".join(t) for t in sorted(terms, key=len))
    return ModelSpec(name or text, outcome, fixed, family, group, slope)


def fit(df: DataFrame, formulas: dict[str, str] | list[str], family: str = "gaussian", levels: Levels | None = None) -> list[Fit]:
    """The fits of all formulas, in their order; those of one kind share their scans of ``df``.

    Without grouping column least squares or logistic regression, with one linear
    (REML) or logistic (Laplace) mixed models.
    """
    named = formulas if isinstance(formulas, dict) else {f: f for f in formulas}
    specs = [parse(text, name, family) for name, text in named.items()]
    plain, mixed = (fit_ols, fit_lmm_grid) if family == "gaussian" else (fit_logit, fit_glmm_grid)
    out: dict[str, Fit] = {}
    for grouped, run in ((False, plain), (True, mixed)):
        some = [s for s in specs if bool(s.group) is grouped]
        if some:
            out.update(zip([s.name for s in some], run(df, some, levels), strict=True))
    return [out[s.name] for s in specs]
