"""Pages for a browser. The scripts that draw Mermaid or D3 aren't part of this repository and there is no network, so the
diagram's page holds its text, and the force graph brings a small script of its own."""

from __future__ import annotations

import html
import json

from lattice.render import theme
from lattice.render.visible import Options, Visible, edge_label

COLORS = ["#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#b07aa1", "#76b7b2", "#edc948", "#9c755f"]


def shell(options: Options, body: str) -> str:
    back, front = (c if theme.parse(c) else d for c, d in zip(options.theme, ("#ffffff", "#222222")))
    title = html.escape(options.title)
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title><style>body{{background:{back};color:{front};font-family:sans-serif;margin:1em}}</style></head>\n<body><h1>{title}</h1>\n{body}</body></html>\n'


def diagram(options: Options, text: str) -> str:
    return shell(options, f'<pre class="mermaid">\n{html.escape(text)}</pre>\n')


def groups(shown: Visible) -> dict[str, int]:
    """The number of each node's component, the largest first, then by smallest id."""
    up = {n["id"]: n["id"] for n in shown.nodes}

    def top(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in shown.edges:
        a, b = sorted((top(e["source"]), top(e["target"])))
        up[b] = a
    sizes: dict[str, int] = {}
    for id_ in up:
        sizes[top(id_)] = sizes.get(top(id_), 0) + 1
    rank = {root: k for k, root in enumerate(sorted(sizes, key=lambda r: (-sizes[r], r)))}
    return {id_: rank[top(id_)] for id_ in up}


def force(shown: Visible, options: Options) -> str:
    """Nodes coloured by component, laid out by springs and repulsion in the page itself."""
    of = groups(shown)
    number = {n["id"]: k for k, n in enumerate(shown.nodes)}
    data = {"nodes": [{"id": n["id"], "name": n["name"], "type": n["type"], "component": of[n["id"]]} for n in shown.nodes],
            "links": [{"source": number[e["source"]], "target": number[e["target"]], "type": e["type"], "label": edge_label(e, shown.names)} for e in shown.edges]}
    text = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")  # no text may end the script
    return shell(options, f'<canvas id="c" width="1200" height="800"></canvas>\n<script type="application/json" id="graph">{text}</script>\n<script>\nconst colors={json.dumps(COLORS)};\n{SCRIPT}</script>\n')


SCRIPT = """
const g = JSON.parse(document.getElementById("graph").textContent), c = document.getElementById("c"), d = c.getContext("2d");
g.nodes.forEach((n, k) => { const a = 2.4 * k, r = 12 * Math.sqrt(k + 1); n.x = c.width / 2 + r * Math.cos(a); n.y = c.height / 2 + r * Math.sin(a); });
let heat = 1;
function step() {
  for (const n of g.nodes) { n.dx = (c.width / 2 - n.x) * 0.01; n.dy = (c.height / 2 - n.y) * 0.01; }
  for (const a of g.nodes) for (const b of g.nodes) if (a !== b) {
    const x = a.x - b.x, y = a.y - b.y, f = 900 / (x * x + y * y + 1); a.dx += x * f / 30; a.dy += y * f / 30; }
  for (const l of g.links) { const a = g.nodes[l.source], b = g.nodes[l.target], x = (b.x - a.x) * 0.02, y = (b.y - a.y) * 0.02; a.dx += x; a.dy += y; b.dx -= x; b.dy -= y; }
  for (const n of g.nodes) { n.x += n.dx * heat; n.y += n.dy * heat; }
  heat *= 0.995;
}
function draw() {
  d.clearRect(0, 0, c.width, c.height); d.strokeStyle = "#999";
  for (const l of g.links) { const a = g.nodes[l.source], b = g.nodes[l.target]; d.beginPath(); d.moveTo(a.x, a.y); d.lineTo(b.x, b.y); d.stroke(); }
  for (const n of g.nodes) { d.fillStyle = colors[n.component % colors.length]; d.beginPath(); d.arc(n.x, n.y, 6, 0, 7); d.fill(); d.fillText(n.name, n.x + 8, n.y + 4); }
}
(function run() { step(); draw(); if (heat > 0.02) requestAnimationFrame(run); })();
"""
