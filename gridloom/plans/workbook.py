"""A workbook in memory: sparse sheets of values and formula texts, and defined names."""

from __future__ import annotations

from dataclasses import dataclass, field

from gridloom.functions.values import Value


@dataclass
class SheetData:
    name: str
    values: dict[tuple[int, int], Value] = field(default_factory=dict)
    formulas: dict[tuple[int, int], str] = field(default_factory=dict)
    arrays: set[tuple[int, int]] = field(default_factory=set)

    def extent(self) -> tuple[int, int]:
        """The last row and column in use; -1 where there is none."""
        used = [*self.values, *self.formulas]
        return max((r for r, _ in used), default=-1), max((c for _, c in used), default=-1)


@dataclass
class Workbook:
    sheets: list[SheetData] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)  # capitals -> formula text
    external_names: set[str] = field(default_factory=set)
    epoch_1904: bool = False

    def add(self, name: str) -> SheetData:
        self.sheets.append(SheetData(name))
        return self.sheets[-1]

    def index(self, name: str) -> int | None:
        return next((i for i, s in enumerate(self.sheets) if s.name.lower() == name.lower()), None)

    def formula_cells(self):
        """(sheet, row, col, text) in order."""
        for i, s in enumerate(self.sheets):
            for (r, c), text in sorted(s.formulas.items()):
                yield i, r, c, text
