"""Formulas: `y ~ a + #b + ^c + 0`: # forces numeric, ^ forces categorical, 0 drops the intercept."""

from __future__ import annotations

from dataclasses import dataclass, field


class FormulaError(ValueError):
    """The text is not a formula."""


@dataclass(frozen=True)
class Formula:
    outcome: str
    variables: tuple[str, ...]
    numeric: frozenset[str] = field(default_factory=frozenset)
    categorical: frozenset[str] = field(default_factory=frozenset)
    intercept: bool = True

    @staticmethod
    def parse(text: str) -> Formula:
        sides = [s.strip() for s in text.split("~")]
        if len(sides) != 2 or not sides[0]:
            raise FormulaError(f"a formula has one ~ and an outcome: {text!r}")
        names, forced, intercept = set(), {"#": set(), "^": set()}, True
        for term in (t.strip() for t in sides[1].split("+")):
            if term == "0":
                intercept = False
                continue
            name = term[1:].strip() if term[:1] in forced else term
            if not name:
                raise FormulaError(f"empty term in {text!r}")
            names.add(name)
            if term[0] in forced:
                forced[term[0]].add(name)
        if forced["#"] & forced["^"]:
            raise FormulaError(f"forced both ways: {sorted(forced['#'] & forced['^'])}")
        return Formula(sides[0], tuple(sorted(names)), frozenset(forced["#"]), frozenset(forced["^"]), intercept)

    def terms(self) -> list[str]:
        """Outcome and variables, sorted: the columns to read."""
        return sorted({self.outcome, *self.variables})

    def kind(self, name: str) -> str:
        return "outcome" if name == self.outcome else "numeric" if name in self.numeric else "categorical" if name in self.categorical else "inferred"

    def __str__(self) -> str:
        mark = {"numeric": " (forced numeric)", "categorical": " (forced categorical)"}
        parts = [v + mark.get(self.kind(v), "") for v in self.variables] + ([] if self.intercept else ["no intercept"])
        return f"{self.outcome} ~ " + " + ".join(parts)
