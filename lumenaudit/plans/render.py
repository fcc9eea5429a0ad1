"""Reports as text: Markdown, HTML and the comparison chart as SVG. A row per site is rendered where the row is, in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The scores a report lists, the chart's dimensions and its colours.
REPORT_SCORES = (("Overall", "overall"), ("GEO/AEO readiness", "aeo_geo"), ("AI readiness", "ai_readiness"), ("Technical SEO", "seo"), ("Mobile PageSpeed", "mobile"), ("Desktop PageSpeed", "desktop"), ("Security", "security"), ("Accessibility", "accessibility"))
DIMENSIONS = (("Overall", "overall"), ("GEO/AEO", "aeo_geo"), ("Crawl", "crawlability"), ("Schema", "structured_data"), ("Answers", "answer_readiness"), ("Trust", "entity_trust"), ("SEO", "seo"))
OWN_COLOUR, COLOURS = "#0891b2", ("#64748b", "#d97706", "#7c3aed", "#e11d48", "#059669")
CAVEAT = "This diagnostic measures on-site readiness and manual competitor gaps. It does not verify live AI answer inclusion."


def cell(text: object) -> str:
    return re.sub(r"\s+", " ", str(text or "").replace("|", "\\|")).strip()


def task_lines(t: dict) -> list[str]:
    tail = "".join(f", {t[k]}" for k in ("effort", "source") if t.get(k))
    return [f"- [ ] **{t['title']}** ({t['impact']} impact{tail})", *([f"  - {t['detail']}"] if t.get("detail") else []), *([f"  - Evidence: {t['evidence']}"] if t.get("evidence") else [])]


def markdown(d: dict) -> str:
    """The report of a site as Markdown; parts that the row lacks are left out."""
    def section(title: str, lines: list[str]) -> list[str]:
        return [title, "", *lines, ""] if lines else []

    name = d.get("company_name") or d.get("domain")
    out = [f"# GEO/AEO Diagnostic Report — {name}", "", f"- **Website:** {d.get('start_url') or d.get('domain')}"]
    out += [f"- **Audit date:** {str(d['created_at'])[:10]}"] if d.get("created_at") else []
    out += [f"- **Pages crawled:** {d['page_count']}"] if d.get("page_count") is not None else []
    out += ["", *section("## Scores (0-100)", ["| Metric | Score |", "| --- | --- |", *(f"| {label} | {d[k]} |" for label, k in REPORT_SCORES if d.get(k) is not None)])]
    out += section("## Executive Summary", [d["summary"]] if d.get("summary") else [])
    found = []
    for n, f in enumerate(d.get("findings") or [], 1):
        found += [f"### {n}. {f['title']} ({f['severity']} severity, {f['category']})", "", *([f["description"]] if f.get("description") else [])]
        found += [f"- **{label}:** {f[k]}" for label, k in (("Evidence", "evidence"), ("URL", "url"), ("Recommendation", "recommendation"), ("Confidence", "confidence")) if f.get(k)] + [""]
    out += section("## Prioritized Findings", found[:-1])
    cats = []
    for c in d.get("categories") or []:
        rows = [f"| {k['label']} | {k['status']} ({k['score']}/{k['max_score']}) | {cell(k['evidence'])} |" for k in c["checks"] if k["status"] != "passed"]
        cats += [f"### {c['name']} — {c['score']}/100", "", *(["| Check | Status | Evidence |", "| --- | --- | --- |", *rows] if rows else ["All checks passed."]), ""]
    out += section("## Category Breakdown", cats[:-1])
    rivals = []
    for r in d.get("competitors") or []:
        if r.get("error"):
            rivals += [f"### {r.get('name') or r['domain']} — crawl failed", "", f"Could not be compared: {r['error']}", ""]
            continue
        diff = r.get("score_diff")
        rivals += [f"### {r.get('name') or r['domain']} ({r['domain']})", "", f"- **GEO/AEO:** {r.get('aeo_geo', 'N/A')} (diff vs audited site: {'+' if diff and diff > 0 else ''}{diff})"]
        for label, k in (("Where the competitor is ahead", "gaps"), ("Where the audited site is ahead", "advantages")):
            rivals += [f"- **{label}:**", *(f"  - {x}" for x in r[k])] if r.get(k) else []
        rivals.append("")
    out += section("## Competitor Comparison", rivals[:-1])
    plan = []
    for title, k in (("### Sitewide Score-Lift Tasks", "general_tasks"), ("### Category Fixes", "category_tasks")):
        plan += [title, "", *(x for t in d[k] for x in task_lines(t)), ""] if d.get(k) else []
    if d.get("page_plans"):
        plan += ["### Page-by-Page Execution", ""]
        for p in d["page_plans"]:
            plan += [f"#### {p['title']} ({p['content_type']}, readiness {p['readiness']}/100)", "", f"URL: {p['url']}", "", *(x for t in p["tasks"] for x in task_lines(t))]
    if d.get("total_tasks") is not None:
        plan = [f"{d['total_tasks']} tasks total, {d['high_impact_tasks']} high impact. Execute in order: sitewide tasks, category fixes, then page-by-page work.", "", *plan]
    out += section("## Action Plan", plan)
    return "\n".join([*out, "## Caveats", "", f"- {CAVEAT}", ""])


def clamp(v: object) -> float:
    return max(0.0, min(100.0, float(v))) if isinstance(v, (int, float)) and v == v else 0.0


def chart(name: str | None, scores: dict | None, rivals: list[dict]) -> str:
    """The comparison of scores as SVG, '' without scores or competitors that have some."""
    rivals = [r for r in rivals or [] if not r.get("error") and r.get("scores")][: len(COLOURS)]
    if not scores or not rivals:
        return ""
    series = [(f"{name or 'Audited site'} (you)", scores, OWN_COLOUR, 3), *((r.get("name") or r.get("domain"), r["scores"], c, 2) for r, c in zip(rivals, COLOURS, strict=False))]
    left, right, top, bottom = 64, 736, 24, 232
    x = [left + k * (right - left) / (len(DIMENSIONS) - 1) for k in range(len(DIMENSIONS))]
    y = lambda v: bottom - clamp(v) / 100 * (bottom - top)
    parts = [f'<line x1="{left}" y1="{y(v):g}" x2="{right}" y2="{y(v):g}" stroke="#e2e8f0"/><text x="{left - 10}" y="{y(v) + 4:g}" text-anchor="end" font-size="11">{v}</text>' for v in (0, 25, 50, 75, 100)]
    parts += [f'<text x="{at:g}" y="{bottom + 20}" text-anchor="middle" font-size="11">{html.escape(label)}</text>' for at, (label, _) in zip(x, DIMENSIONS, strict=True)]
    for _, s, colour, width in series:
        points = [(at, y(s.get(k))) for at, (_, k) in zip(x, DIMENSIONS, strict=True)]
        parts.append(f'<polyline points="{" ".join(f"{a:g},{b:g}" for a, b in points)}" fill="none" stroke="{colour}" stroke-width="{width}"/>')
        parts += [f'<circle cx="{a:g}" cy="{b:g}" r="{width + 1}" fill="{colour}"/>' for a, b in points]
    for k, (label, _, colour, width) in enumerate(series):
        a, b = left - 24 + k % 3 * 236, bottom + 40 + k // 3 * 20
        label = str(label or "")
        short = label if len(label) <= 28 else label[:27] + "…"
        parts.append(f'<line x1="{a}" y1="{b}" x2="{a + 22}" y2="{b}" stroke="{colour}" stroke-width="{width}"/><text x="{a + 28}" y="{b + 4}" font-size="12">{html.escape(short)}</text>')
    height = bottom + 48 + -(-len(series) // 3) * 20
    return f'<svg viewBox="0 0 760 {height}" xmlns="http://www.w3.org/2000/svg" role="img" aria-label="Score comparison against competitors">{"".join(parts)}</svg>'


def page(d: dict) -> str:
    """The report of a site as one HTML page: scores, the first twelve findings and four checks of each category."""
    e = lambda v: html.escape(str(v if v is not None else ""), quote=True)
    cards = "".join(f"<div class='card'><b>{e(label)}</b><span>{e(d[k])}</span></div>" for label, k in REPORT_SCORES if d.get(k) is not None)
    found = "".join(f"<li class='{e(f['severity'])}'><h3>{e(f['title'])}</h3><p>{e(f['description'])}</p><p>{e(f['recommendation'])}</p><small>{e(f['evidence'])}</small></li>" for f in (d.get("findings") or [])[:12])
    cats = "".join(f"<section><h3>{e(c['name'])}: {e(c['score'])}</h3><ul>" + "".join(f"<li>{e(k['label'])}: {e(k['status'])}</li>" for k in c["checks"][:4]) + "</ul></section>" for c in d.get("categories") or [])
    title = e(d.get("company_name") or d.get("domain"))
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><div>{cards}</div>{d.get('chart') or ''}<ol>{found}</ol>{cats}</body></html>"


def rendered(sites: DataFrame, key: str = "site_id") -> DataFrame:
    """``(site_id, markdown, html)`` of rows that hold a site's scores, findings and categories."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [{k: plain(v) for k, v in r.items()} for r in df.to_dict("records")]
            yield pd.DataFrame({key: [r[key] for r in rows], "markdown": [markdown(r) for r in rows], "html": [page(r) for r in rows]})

    return sites.mapInPandas(run, f"{key} string, markdown string, html string")


def plain(v: object) -> object:
    """Rows and arrays as dicts and lists; missing numbers as None."""
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [plain(x) for x in v]
    return None if isinstance(v, float) and v != v else v
