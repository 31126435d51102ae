"""Pictures and documents from small tables, where the packages for them are installed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsefeat.plans.report import Report, shown


def _needs(module: str):
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise RuntimeError(f"{module} isn't installed") from missing


def bars(table: DataFrame, label: str, value: str, path: str, title: str = "", marks: tuple[float, ...] = ()) -> None:
    """A bar per row of a small table (histogram bins, rates, correlations), as a PNG."""
    plt = _needs("matplotlib.pyplot")
    rows = table.select(label, value).orderBy(label).limit(500).collect()
    figure, axes = plt.subplots()
    axes.bar([r[0] for r in rows], [r[1] for r in rows])
    for m in marks:
        axes.axvline(m, linestyle="--")
    axes.set_title(title)
    figure.savefig(path)
    plt.close(figure)


def trace(table: DataFrame, x: str, ys: list[str], path: str, title: str = "") -> None:
    """Lines over a small table (rolling statistics, trends), as a PNG."""
    plt = _needs("matplotlib.pyplot")
    rows = table.select(x, *ys).orderBy(x).limit(10_000).collect()
    figure, axes = plt.subplots()
    for i, y in enumerate(ys):
        axes.plot([r[0] for r in rows], [r[i + 1] for r in rows], label=y)
    axes.legend()
    axes.set_title(title)
    figure.savefig(path)
    plt.close(figure)


def document(report: Report, tables: dict[str, DataFrame], path: str, rows: int = 25) -> None:
    """The report's tables as a DOCX."""
    docx = _needs("docx")
    out = docx.Document()
    out.add_heading(report.title, 0)
    for note in [report.notes] if isinstance(report.notes, str) else report.notes:
        out.add_paragraph(note)
    for name, df in tables.items():
        out.add_heading(name, 1)
        found = df.limit(rows).collect()
        grid = out.add_table(rows=1 + len(found), cols=len(df.columns))
        for j, c in enumerate(df.columns):
            grid.cell(0, j).text = c
            for i, r in enumerate(found):
                grid.cell(i + 1, j).text = shown(r[j])
    out.save(path)
