"""Model specifications: term lists with the edits the analyses make
(remove a term, turn a term into a random intercept, add a term)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ModelSpec:
    response: str
    terms: tuple[str, ...]
    random: tuple[str, ...] = field(default_factory=tuple)

    def drop_term(self, term: str) -> "ModelSpec":
        return replace(self, terms=tuple(t for t in self.terms if t != term))

    def add_terms(self, *terms: str) -> "ModelSpec":
        return replace(self, terms=self.terms + tuple(t for t in terms if t not in self.terms))

    def to_random(self, term: str) -> "ModelSpec":
        """``str_replace(formula, term, "(1|term)")``."""
        return replace(self, terms=tuple(t for t in self.terms if t != term), random=self.random + (term,))

    def add_random(self, term: str) -> "ModelSpec":
        return replace(self, random=self.random + (term,))

    @property
    def variables(self) -> list[str]:
        return [self.response, *self.terms, *self.random]

    def formula(self) -> str:
        rhs = " + ".join(self.terms) if self.terms else "1"
        return f"{self.response} ~ {rhs}"

    def r_formula(self) -> str:
        parts = list(self.terms) + [f"(1|{g})" for g in self.random]
        return f"{self.response} ~ {' + '.join(parts) if parts else '1'}"
