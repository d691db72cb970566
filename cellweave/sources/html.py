"""One sheet of an overlay as an HTML table: a bounded report for people."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from ..formula.values import column_name, number_text

#: Bounds of what is shown; more is cut and said so.
MOST_ROWS, MOST_COLS, MOST_CELLS = 20_000, 512, 150_000


def shown(kind: str, number, text, flag, err) -> str:
    return {"num": lambda: number_text(number), "text": lambda: text, "bool": lambda: "TRUE" if flag else "FALSE", "err": lambda: err}.get(kind, lambda: "")()


def safe_link(target: str) -> bool:
    """Only http, https and mailto, whatever control characters are mixed in."""
    plain = "".join(ch for ch in target if ch > " ").lower()
    return plain.startswith(("http://", "https://", "mailto:"))


def render(overlay: DataFrame, workbook_id: str, sheet: str, rows_shown: int = MOST_ROWS, cols_shown: int = MOST_COLS) -> str:
    """Uncomputed cells show a warning sign and their reason, never a number; a caption says when cells are not shown."""
    own = overlay.filter((overlay["workbook_id"] == workbook_id) & (overlay["sheet"] == sheet))
    rows = own.filter((own["row"] <= rows_shown) & (own["col"] <= cols_shown)).orderBy("row", "col").limit(MOST_CELLS).collect()
    cut = own.limit(len(rows) + 1).count() > len(rows)
    grid = {(r["row"], r["col"]): r for r in rows}
    height, width = max((r for r, _ in grid), default=0), max((c for _, c in grid), default=0)
    out = ["<table><thead><tr><th></th>" + "".join(f"<th>{column_name(c)}</th>" for c in range(1, width + 1)) + "</tr></thead><tbody>"]
    for r in range(1, height + 1):
        line = []
        for c in range(1, width + 1):
            x = grid.get((r, c))
            if x is None:
                line.append("<td></td>")
            elif x["provenance"] in ("unsupported", "circular"):
                line.append(f'<td class="refused" title="{html.escape(x["reason"] or "")}">⚠</td>')
            else:
                line.append(f'<td class="{x["provenance"]}">{html.escape(shown(x["kind"], x["number"], x["text"], x["bool"], x["err"]))}</td>')
        out.append(f"<tr><th>{r}</th>{''.join(line)}</tr>")
    note = "<caption>cut: more cells than are shown</caption>" if cut else ""
    return "".join(out).replace("<thead>", note + "<thead>", 1) + "</tbody></table>"
