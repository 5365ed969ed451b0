"""The comparison as one HTML file, without scripts or files from elsewhere."""

from __future__ import annotations

from html import escape

from strata.diff.model import DiffFormatOptions
from strata.diff.result import STATES, DiffResult

_STYLE = """
body{font-family:system-ui,sans-serif;margin:2rem auto;max-width:70rem;color:#222}
table{border-collapse:collapse;margin:.5rem 0 1rem}
td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left;vertical-align:top}
pre{background:#f6f6f6;padding:.6rem;overflow-x:auto}
.bar{display:flex;height:.8rem;width:16rem;background:#eee}
.no_change{background:#7bb77b}.changed{background:#e0a84e}.only_in_left{background:#d9736d}.only_in_right{background:#6d93d9}
.add{color:#22863a}.del{color:#b31d28}summary{cursor:pointer}
"""


def _table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape('NULL' if x is None else str(x))}</{tag}>" for x in row)
    return "<table><tr>" + cells("th", head) + "</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def _schema(text: str) -> str:
    lines = [f'<span class="{"add" if x.startswith("+") else "del" if x.startswith("-") else ""}">{escape(x)}</span>' for x in text.split("\n")]
    return "<pre>" + "\n".join(lines) + "</pre>"


def _bar(counts, total: int) -> str:
    return '<div class="bar">' + "".join(f'<div class="{s}" style="width:{100 * counts[s] / total:.2f}%" title="{s}: {counts[s]}"></div>' for s in STATES if total and counts[s]) + "</div>"


def html_report(result: DiffResult, title: str | None, options: DiffFormatOptions) -> str:
    """All tables hold bounded numbers of rows: kept values of each column and state."""
    left, right = options.left_df_alias, options.right_df_alias
    title = title or f"Data diff: {left} and {right}"
    names = {"changed": "changed", "no_change": "no change", "only_in_left": f"only in {left}", "only_in_right": f"only in {right}"}
    out = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>']
    out.append(f"<p>Schema: {'same' if result.same_schema else 'changed'}. Data: {'same' if result.same_data else 'changed'}. Joined on {escape(', '.join(result.join_cols))}.</p>")
    out.append("<h2>Schema</h2>" + _schema(result.schema_diff_result.diff_str))
    out.append("<h2>Rows</h2>")
    rows = [[level or "root", s.total, s.no_change, s.changed, s.only_in_left, s.only_in_right] for level, s in result.diff_stats_shards.items()]
    out.append(_table(["granularity", "total", "no change", "changed", names["only_in_left"], names["only_in_right"]], rows))
    out.append("<h2>Columns</h2>")
    for r in result.get_diff_per_col_df(options.nb_top_values_kept_per_column).collect():
        out.append(f"<details><summary><b>{escape(r.column_name)}</b> {_bar(r.counts, r.counts.total)} " + ", ".join(f"{names[s]}: {r.counts[s]}" for s in STATES if r.counts[s]) + "</summary>")
        for s in STATES:
            values = r["diff"][s]
            if values:
                head = [left, right, "rows", "sample"] if s == "changed" else ["value", "rows", "sample"]
                out.append(f"<h4>{escape(names[s])}</h4>" + _table(head, [[*x[:-1], " ".join(x.sample_ids or [])] for x in values]))
        out.append("</details>")
    out.append("<h2>Sample rows</h2>")
    for level, sample in zip(result.diff_df_shards, result.get_sample_df_shards(1), strict=True):
        columns = [c for c in sample.columns if not c.startswith("__")]
        body = [[str(x[c].left_value) if x[c].is_equal or not x[c].exists_right else str(x[c].right_value) if not x[c].exists_left else f"{x[c].left_value} → {x[c].right_value}" for c in columns] for x in sample.limit(50).collect()]
        out.append(f"<details><summary>{escape(level or 'root')}</summary>{_table(columns, body)}</details>")
    return "".join(out) + "</body></html>\n"
