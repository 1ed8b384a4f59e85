"""Results as text, from the few rows that studies and sessions end in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from vintage.operators.evaluate import EDGE, PAPER_CORRELATION, PAPER_DIFFERENCE


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:+.2f} %"


def table(rows: Iterable[Mapping], columns: Mapping[str, str]) -> str:
    """Rows under a head line; columns name the format of each."""
    cells = [list(columns)] + [[percent(r[c]) if kind == "%" else "n/a" if r[c] is None else format(r[c], kind) for c, kind in columns.items()] for r in rows]
    wide = [max(len(line[k]) for line in cells) for k in range(len(columns))]
    return "\n".join("  ".join(cell.rjust(w) for cell, w in zip(line, wide)) for line in cells)


def window_passes(strategy: Mapping, benchmark: Mapping) -> bool:
    return strategy["sharpe"] - benchmark["sharpe"] >= EDGE and strategy["max_drawdown"] >= benchmark["max_drawdown"]


def backtest(name: str, strategy: Mapping, benchmark: Mapping, trades: int) -> str:
    """A run beside its benchmark, with its own verdict."""
    rows = [{"run": name, "trades": trades, **strategy}, {"run": "benchmark", "trades": 1, **benchmark}]
    edge = strategy["sharpe"] - benchmark["sharpe"]
    verdict = "passes" if window_passes(strategy, benchmark) else "does not pass"
    return table(rows, {"run": "", "total_return": "%", "cagr": "%", "sharpe": ".2f", "max_drawdown": "%", "trades": "d"}) + f"\n{name} {verdict}: Sharpe edge {edge:+.2f}, {EDGE:+.2f} asked for, and a drawdown no deeper than the benchmark's"


def attribution(row: Mapping) -> str:
    return f"alpha {percent(row['alpha_annual'])} a year, beta {row['beta']:.2f}, information ratio {row['information_ratio']:.2f}, tracking error {percent(row['tracking_error'])}, active return {percent(row['active_return'])} over {row['n_days']} days"


def walk_forward(verdict: Mapping, windows: Iterable[Mapping] = ()) -> str:
    """Windows, then what the gate makes of them."""
    lines = [f"{w['kind']:8} {w['start']} to {w['end']}: " + ("insufficient data in window" if (w.get("n_dates") or 0) < 2 else f"edge {w['edge']:+.2f}, {'passed' if w['passed'] else 'failed'}") for w in windows]
    edge = "n/a" if verdict["holdout_edge"] is None else f"{verdict['holdout_edge']:+.2f}"
    lines.append(f"{verdict['research_passed']} of {verdict['research_total']} research windows passed, holdout edge {edge}: the gate {'opens' if verdict['gate_passed'] else 'stays shut'}")
    return "\n".join(lines)


def papercheck(row: Mapping) -> str:
    if row["correlation"] is None or row["n"] < 2:
        return "too few common dates to compare paper and backtest"
    return f"correlation {row['correlation']:.3f} ({PAPER_CORRELATION:.2f} asked for), difference {percent(row['cumulative_diff'])} (at most {percent(PAPER_DIFFERENCE)}), {row['n']} days: {'agrees' if row['passed'] else 'does not agree'}"


def placebo(summary: Mapping, histogram: Iterable[Mapping]) -> str:
    """How often noise passes, and how many windows it passed."""
    if not summary["trials"]:
        return "no trials"
    bars = [f"{r['research_passed']} windows  {'#' * r['trials']} {r['trials']}" for r in histogram]
    return "\n".join([f"{summary['passed']} of {summary['trials']} trials of noise pass ({percent(summary['pass_rate'])}); holdout edge median {summary['median_edge']:+.2f}, best {summary['best_edge']:+.2f}", *bars])


def power(rows: Iterable[Mapping]) -> str:
    """Verdicts by strength of foresight, and the least that passes."""
    rows = sorted(rows, key=lambda r: float(r["name"]))
    least = next((r["name"] for r in rows if r["gate_passed"]), None)
    body = table([{**r, "gate": "passes" if r["gate_passed"] else "fails"} for r in rows], {"name": "", "research_passed": "d", "holdout_edge": "+.2f", "gate": ""})
    return body + ("\nno strength passes" if least is None else f"\nthe gate notices foresight from a strength of {least} on")


def session(row: Mapping) -> str:
    return f"{row['samples']} samples, {row['regular_samples']} in regular hours: {row['first']:.2f} to {row['last']:.2f}, {row['pnl']:+.2f} ({percent(row['pct'])})"
