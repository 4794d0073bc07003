"""Column roles: every operator is told which column plays which part, so the
same job runs on any table (the reference hard-wires one student schema).
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    id: str
    target: str
    # ordered period columns, oldest first; the last one is usually the target
    periods: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    # level of effort (ordinal 1..4), prior failures, absences
    effort: str | None = None
    failures: str | None = None
    absences: str | None = None
    # weighted composites: name -> ((column, weight), ...); divided by the weight sum
    composites: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()
    # columns winsorised by IQR and columns given a z-score
    winsor: tuple[str, ...] = ()
    norm: tuple[str, ...] = ()
    pass_mark: float = 10.0
    grade_min: float = 0.0
    grade_max: float = 20.0
    absences_risk: float = 15.0
    iqr_factor: float = 1.5
    # levers a plan may move: name -> (min, max, step, direction(+1 better up / -1 better down))
    levers: tuple[tuple[str, float, float, float, int], ...] = ()
    extras: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def business(self) -> tuple[str, ...]:
        """All input columns except the key (duplicate detection works on these)."""
        seen: list[str] = []
        for c in self.categorical + self.numeric + self.periods:
            if c not in seen:
                seen.append(c)
        return tuple(seen)

    @property
    def numeric_all(self) -> tuple[str, ...]:
        seen: list[str] = []
        for c in self.numeric + self.periods:
            if c not in seen:
                seen.append(c)
        return tuple(seen)

    def present(self, cols, columns) -> list[str]:
        cs = set(columns)
        return [c for c in cols if c in cs]


# Role map of the derived `subjects` table (see plans/bindings.py).
SUBJECTS = Roles(
    id="subject_id",
    target="g3",
    periods=("g1", "g2", "g3"),
    numeric=("n_orders", "effort", "failures", "absences"),
    categorical=("segment", "flag"),
    effort="effort",
    failures="failures",
    absences="absences",
    # the reference caps absences, age and the three grades (age has no binding here)
    winsor=("absences", "age", "g1", "g2", "g3"),
    # the reference's seven z-scored columns, bound where they exist
    norm=("effort", "absences", "failures", "goout", "Dalc", "Walc", "g3"),
    levers=(
        ("effort", 1.0, 4.0, 1.0, 1),
        ("absences", 0.0, 93.0, 1.0, -1),
    ),
)

#: `subjects` with a composite of weighted columns, the column of the heavy-use rules.
SUBJECTS_LOAD = replace(SUBJECTS, composites=(("load", (("absences", 2.0), ("failures", 1.0))),))
