"""Copies of a formula: its text as it would stand in another cell."""

from __future__ import annotations

from gridloom.plans import syntax as S


def moved(node: S.Node, rows: int, cols: int) -> str:
    """The formula's text after a copy by so many rows and columns: relative references move along, absolute ones stay, and
    what would leave the sheet becomes #REF!. Everything else stays byte for byte."""
    return "".join(p if isinstance(p, str) else moved(p, rows, cols) for p in node.pieces) if not isinstance(node, S.Ref) else _reference(node, rows, cols)


def _reference(ref: S.Ref, rows: int, cols: int) -> str:
    if ref.dead:
        return ref.text()
    before = "".join(ref.pieces)
    prefix = before[: before.rindex("!") + 1] if "!" in before else "#REF!" if ref.sheet and ref.sheet.dead else ""

    def axis(a: S.Axis, step: int, most: int, shown) -> str | None:
        at = a.at if a.absolute else a.at + step
        return ("$" if a.absolute else "") + shown(at) if 0 <= at < most else None

    row = lambda a: axis(a, rows, S.MAX_ROWS, lambda n: str(n + 1))
    col = lambda a: axis(a, cols, S.MAX_COLUMNS, S.column_letters)
    if ref.single:
        parts = [col(ref.col), row(ref.row)]
        return "#REF!" if None in parts else prefix + "".join(parts)
    parts = [col(ref.col), col(ref.col2)] if ref.row is None else [row(ref.row), row(ref.row2)]
    return "#REF!" if None in parts else prefix + ":".join(parts)
