"""A short Markdown brief over the metrics of a run: what a manager asks, answered in sentences."""

from __future__ import annotations


def short(x: float) -> str:
    """Thousand, lakh and crore as K, L and Cr."""
    for base, label in ((1e7, "Cr"), (1e5, "L"), (1e3, "K")):
        if abs(x) >= base:
            return f"{x / base:.2f} {label}"
    return f"{x:.0f}"


def _share(x: float | None) -> str:
    return "unknown" if x is None else f"{100 * x:.1f} %"


def _data(m: dict) -> str:
    rows = sum(m.get("rows", {}).values())
    return f"The checks score {m.get('score', 0):.2f} of 100; {m.get('failed_checks', 0)} of them failed and {m.get('quarantined', 0):,} rows are held back. {rows:,} rows were loaded."


def _customers(m: dict) -> str:
    lift = m.get("top_lift")
    text = f"The best fifth of customers bring {_share(m.get('revenue_share_top20'))} of revenue, and {_share(m.get('retention_month1'))} of new ones come back in their second month."
    return text + (f" Of {m['rules']} rules of what sells together the strongest has a lift of {lift:.1f}." if lift else "")


def _value(m: dict) -> str:
    if m.get("total_clv") is None:
        return "No lifetime value could be estimated."
    return (f"The next year's purchases are worth {short(m['total_clv'])} in all and {short(m['median_clv'])} for the median customer; {m.get('customers_at_risk', 0):,} customers "
            f"have probably left. On held-out weeks the count of trips was off by {m.get('error_pct') or 0:.1f} %.")  # fmt: skip


def _leaving(m: dict) -> str:
    best = m.get("best_campaign")
    text = f"The churn model ranks customers with a ROC-AUC of {m.get('gbm_roc_auc') or 0:.3f}."
    if m.get("top_features"):
        text += f" What tells most: {', '.join(m['top_features'])}."
    return text + (f" Contacting the top {_share(best['target_pct'])} returns {best['roi']:.2f} for each unit spent." if best else "")


def _next(m: dict, incidents: dict) -> str:
    parts = []
    if incidents:
        found = f"{incidents['detected_events']} incidents were found in store traffic"
        known = f", {_share(incidents.get('precision'))} of them planted" if incidents.get("injected") else ""
        parts.append(found + known + ".")
    models = m.get("models") or {}
    if models:
        best = min(models.values(), key=lambda x: x["mase"])
        parts.append(f"The {best['model'].replace('_', ' ')} forecast is the best, with a MASE of {best['mase']:.2f} and a MAPE of {best['mape_pct']:.1f} %.")
    return " ".join(parts)


def brief(metrics: dict[str, dict]) -> str:
    """Sections of the stages that ran."""
    sections = [
        ("Can the data be trusted?", _data, "etl"), ("Who brings the revenue?", _customers, "customer_analytics"),
        ("What is a customer worth?", _value, "clv"), ("Who is leaving, and whom to contact?", _leaving, "churn"),
    ]
    lines = ["# Retail brief", ""]
    for title, text, stage in sections:
        if metrics.get(stage):
            lines += [f"## {title}", "", text(metrics[stage]), ""]
    if after := _next(metrics.get("forecast") or {}, metrics.get("anomaly") or {}):
        lines += ["## What happened, and what comes next?", "", after, ""]
    return "\n".join(lines)
