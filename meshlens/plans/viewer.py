"""A page that shows a graph: nodes by risk with their flags, edges of the chosen one, and a search. It reads /graph.json or a document put into it."""

from __future__ import annotations

PAGE = """<!doctype html>
<meta charset="utf-8"><title>meshlens</title>
<style>body{font:14px sans-serif;margin:2em;display:flex;gap:2em}table{border-collapse:collapse}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}
tr:hover{background:#f4f4f4;cursor:pointer}aside{min-width:24em}.critical{color:#a00}.high{color:#c50}.medium{color:#870}</style>
<main><input id="find" placeholder="search"><table><thead><tr><th>risk<th>type<th>label<th>file<th>flags</thead><tbody id="rows"></tbody></table></main><aside id="one"></aside>
<script>
const GIVEN = /*given*/null;
const cell = (row, text, kind) => { const td = row.insertCell(); td.textContent = text ?? ""; if (kind) td.className = kind; };
const heat = r => r >= 70 ? "critical" : r >= 40 ? "high" : r >= 15 ? "medium" : "";
function list(graph, words) {
  rows.replaceChildren();
  const wanted = graph.nodes.filter(n => (n.label + " " + n.file + " " + n.id).toLowerCase().includes(words.toLowerCase()));
  for (const n of wanted.sort((a, b) => b.risk_score - a.risk_score)) {
    const row = rows.insertRow();
    cell(row, n.risk_score, heat(n.risk_score)); cell(row, n.type); cell(row, n.label); cell(row, n.file + ":" + n.line); cell(row, (n.risk_flags || []).length);
    row.onclick = () => show(graph, n);
  }
}
function show(graph, n) {
  one.replaceChildren();
  const add = (tag, text, kind) => { const e = document.createElement(tag); e.textContent = text; if (kind) e.className = kind; one.append(e); };
  add("h2", n.label);
  for (const f of n.risk_flags || []) add("p", f.severity + " " + f.code + ": " + f.message + " (" + f.evidence + ")", f.severity);
  for (const e of graph.edges) if (e.source === n.id || e.target === n.id) add("div", e.type + ": " + e.source + " -> " + e.target);
}
const ready = GIVEN ? Promise.resolve(GIVEN) : fetch("/graph.json").then(r => r.json());
ready.then(graph => { find.oninput = () => list(graph, find.value); list(graph, ""); });
</script>
"""


def page(document: str | None = None) -> str:
    """The page; with a graph's JSON document it needs no server. Angle brackets of the document are escaped, so that no text in it ends the script."""
    return PAGE if document is None else PAGE.replace("/*given*/null", document.replace("<", "\\u003c"), 1)
