"""A sample workbook: a budget of twelve categories by quarter with two planted defects.

The total of one row leaves out its last quarter, and one share reads the row below its own.
"""

from __future__ import annotations

from gridloom.plans.interp import Evaluator
from gridloom.plans.syntax import column_letters, parse
from gridloom.plans.workbook import Workbook

QUARTERS = {
    "Salaries & benefits": (412000, 418000, 425000, 431000), "Cloud & infrastructure": (58200, 61500, 64800, 70300), "Hardware prototyping": (91000, 74500, 88000, 102500), "Office & facilities": (23800, 23800, 24600, 24600),
    "Travel": (14200, 18900, 9800, 21400), "Marketing & events": (37500, 52000, 41000, 66500), "Legal & accounting": (12800, 9200, 9200, 15600), "Insurance": (8400, 8400, 8400, 8400), "Recruiting": (19500, 26000, 22500, 12000),
    "Software licenses": (16700, 16700, 17900, 17900), "Training & conferences": (6300, 11800, 4200, 9600), "Contingency": (25000, 25000, 25000, 25000),
}


def budget() -> Workbook:
    out = Workbook()
    own = out.add("Budget")
    own.values[0, 0] = "Budget"
    for i, t in enumerate(("Category", "Q1", "Q2", "Q3", "Q4", "Total", "Share of total")):
        own.values[2, i] = t
    for r, (name, amounts) in enumerate(QUARTERS.items(), 3):
        own.values[r, 0] = name
        for i, v in enumerate(amounts, 1):
            own.values[r, i] = float(v)
        own.formulas[r, 5] = f"SUM(B{r + 1}:{'D' if r == 8 else 'E'}{r + 1})"
        own.formulas[r, 6] = f"F{8 if r == 6 else r + 1}/$F$16"
    for i in range(1, 6):
        c = column_letters(i)
        own.formulas[15, i] = f"SUM({c}4:{c}15)"
    for at in sorted(own.formulas, key=lambda at: (at[1] == 6, at[0])):
        own.values[at] = Evaluator(out, 0, *at).formula(parse(own.formulas[at]))
    return out
