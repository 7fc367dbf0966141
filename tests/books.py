"""Small workbooks for tests."""

from __future__ import annotations

from gridloom.plans.interp import Evaluator
from gridloom.plans.syntax import as_cell, parse
from gridloom.plans.workbook import Workbook
from gridloom.sources.samples import budget  # noqa: F401  for tests


def book(cells: dict, name: str = "S", evaluate: bool = True) -> Workbook:
    """From A1 names to values, or formulas that begin with an equals sign; formulas get their values stored, in the order
    given."""
    out = Workbook()
    own = out.add(name)
    for at, v in cells.items():
        row, col = as_cell(at)
        place = row.at, col.at
        if isinstance(v, str) and v.startswith("="):
            own.formulas[place] = v[1:]
            if evaluate:
                own.values[place] = Evaluator(out, 0, *place).formula(parse(v[1:]))
        else:
            own.values[place] = float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return out


def chain(n: int) -> Workbook:
    """A_r = r + 1; B1 = A1*2, B_r = A_r*2 + B_(r-1)."""
    cells: dict = {f"A{r}": r for r in range(1, n + 1)}
    for r in range(1, n + 1):
        cells[f"B{r}"] = f"=A{r}*2" if r == 1 else f"=A{r}*2+B{r - 1}"
    return book(cells)
