"""Diagram texts of a visible graph, one function a format, and their registry."""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import quoteattr

from lattice.model import Graph
from lattice.render import layout, pages, theme
from lattice.render.visible import Options, Visible, clipped, edge_label, safe_id, visible

# Group titles in order, and each format's signs for node and edge types.
GROUPS = {"service": "Services", "module": "Modules", "package": "Packages", "database": "Data Stores", "queue": "Message Queues", "cache": "Caches", "external_api": "External APIs", "endpoint": "Endpoints", "note": "Notes"}
SHAPES = {"database": ("[(", ")]"), "queue": ("[[", "]]"), "cache": ("((", "))"), "external_api": (">", "]"), "endpoint": ("{{", "}}"), "note": ("([", "])")}
KEYWORDS = {"service": "component", "database": "database", "queue": "queue", "cache": "storage", "external_api": "cloud", "endpoint": "usecase"}
ARROWS = {"data_flow": "..>", "read_write": "<-->"}
C4 = {"database": ("ContainerDb", "Data store", ""), "queue": ("Container", "Message queue", " <<queue>>"), "cache": ("Container", "Cache", " <<cache>>"), "service": ("Container", "Service", ""), "module": ("Container", "Service", ""), "package": ("Component", "Package", ""), "endpoint": ("Component", "Endpoint", "")}


def grouped(shown: Visible, kinds: list[str]) -> Iterator[tuple[str, list]]:
    for kind in kinds:
        if own := [n for n in shown.nodes if n["type"] == kind]:
            yield GROUPS[kind], own


def mermaid(shown: Visible, options: Options) -> str:
    quoted = lambda s: '"' + s.replace('"', "&quot;") + '"' if any(c in s for c in '()[]{}"') else s
    out = ["---", f"title: {options.title}", "---", *theme.mermaid_init(options.theme), f"graph {options.direction}"]
    for title, own in grouped(shown, [*GROUPS]):
        out.append(f"    subgraph {title}")
        for n in own:
            left, right = SHAPES.get(n["type"], ("[", "]"))
            out.append(f"        {safe_id(n['id'])}{left}{quoted(n['name'])}{right}")
        out.append("    end")
    for e in shown.edges:
        label = edge_label(e, shown.names)
        out.append(f"    {safe_id(e['source'])} -->{f'|{label}|' if label else ''} {safe_id(e['target'])}")
    return "\n".join(out) + "\n"


def plantuml(shown: Visible, options: Options) -> str:
    out = ["@startuml", f"title {options.title}", *["left to right direction"] * (options.direction == "LR"), ""]
    for title, own in grouped(shown, [k for k in GROUPS if k != "note"]):
        out += [f'package "{title}" {{', *(f'    {KEYWORDS.get(n["type"], "rectangle")} "{n["name"]}" as {safe_id(n["id"])}' for n in own), "}", ""]
    for e in shown.edges:
        label = edge_label(e, shown.names)
        out.append(f"{safe_id(e['source'])} {ARROWS.get(e['type'], '-->')} {safe_id(e['target'])}" + (f" : {label}" if label else ""))
    return "\n".join([*out, "", "@enduml"]) + "\n"


def c4(shown: Visible, options: Options) -> str:
    outside = [n for n in shown.nodes if n["type"] == "external_api"]
    inside = [n for n in shown.nodes if n["type"] != "external_api"]
    out = ["@startuml", "!include <C4/C4_Container>", "", f"title {options.title}", ""]
    if outside:
        out += [*(f'System_Ext({safe_id(n["id"])}, "{n["name"]}")' for n in outside), ""]
    if inside:
        out.append('System_Boundary(system, "System") {')
        for n in inside:
            element, what, mark = C4.get(n["type"], ("Container", "", ""))
            out.append(f'    {element}({safe_id(n["id"])}, "{n["name"]}", "{n["language"]}", "{what}"){mark}')
        out += ["}", ""]
    out += [f'Rel({safe_id(e["source"])}, {safe_id(e["target"])}, "{edge_label(e, shown.names)}")' for e in shown.edges]
    return "\n".join([*out, "", "@enduml"]) + "\n"


def as_json(shown: Visible, options: Options) -> str:
    plain = lambda row: {k: v for k, v in row.asDict().items() if v not in (None, "")}
    return json.dumps({"title": options.title, "view_level": options.view_level, "root_path": options.root, "topology": options.topology,
                       "nodes": [*map(plain, shown.nodes)], "edges": [*map(plain, shown.edges)]}, indent=2, ensure_ascii=False)


# Tags of a workspace's containers.
TAGS = {"database": "Database", "queue": "Queue", "cache": "Cache"}


def structurizr(shown: Visible, options: Options) -> str:
    """A workspace: outside systems, the system with its containers, then what is connected, then one view."""
    quoted = lambda s: '"' + (s or "").replace('"', "'") + '"'
    lines = [(0, "workspace {"), (1, "model {")]
    for n in (n for n in shown.nodes if n["type"] == "external_api"):
        lines += [(2, f"{safe_id(n['id'])} = softwareSystem {quoted(n['name'])} {{"), (3, 'tags "External"'), (2, "}")]
    lines.append((2, f"system = softwareSystem {quoted(options.title)} {{"))
    for n in (n for n in shown.nodes if n["type"] != "external_api"):
        head = f"{safe_id(n['id'])} = container {quoted(n['name'])} \"\" {quoted(n['language'])}"
        lines += [(3, head + " {"), (4, f"tags {quoted(TAGS[n['type']])}"), (3, "}")] if n["type"] in TAGS else [(3, head)]
    lines.append((2, "}"))
    for e in shown.edges:
        label = edge_label(e, shown.names)
        lines.append((2, f"{safe_id(e['source'])} -> {safe_id(e['target'])}" + (f" {quoted(label)}" if label else "")))
    lines += [(1, "}"), (1, "views {"), (2, "container system {"), (3, "include *"), (3, "autoLayout"), (2, "}"), (1, "}"), (0, "}")]
    return "\n".join("    " * depth + text for depth, text in lines) + "\n"


def drawio(shown: Visible, options: Options) -> str:
    """Layers from top to bottom, nodes in barycenter order; neighbours of one type in a layer share a frame."""
    names, kinds, cells = shown.names, {n["id"]: n["type"] for n in shown.nodes}, []
    box = lambda id_, value, style, x, y, w, h, parent="1": f'<mxCell id="{id_}" value={quoteattr(value)} style="{style}" vertex="1" parent="{parent}"><mxGeometry x="{x}" y="{y}" width="{w}" height="{h}" as="geometry"/></mxCell>'
    for y, row in enumerate(layout.ordered(shown)):
        x = 0
        for kind, own in itertools.groupby(row, key=kinds.get):
            own = list(own)
            if len(own) > 1:
                cells.append(box(f"frame_{y}_{x}", GROUPS.get(kind, kind), "group;dashed=1;rounded=0;verticalAlign=top;html=1;", 30 + 200 * x, 20 + 140 * y, 200 * len(own) - 20, 100))
            for id_ in own:
                cells.append(box(safe_id(id_), names[id_], "rounded=1;whiteSpace=wrap;html=1;", 40 + 200 * x, 50 + 140 * y, 160, 60))
                x += 1
    for k, e in enumerate(shown.edges):
        cells.append(f'<mxCell id="edge{k}" value={quoteattr(edge_label(e, names))} style="curved=1;html=1;" edge="1" parent="1" source="{safe_id(e["source"])}" target="{safe_id(e["target"])}"><mxGeometry relative="1" as="geometry"/></mxCell>')
    inner = "\n".join(["<mxCell id=\"0\"/>", "<mxCell id=\"1\" parent=\"0\"/>", *cells])
    return f"<mxfile><diagram name={quoteattr(options.title)}><mxGraphModel><root>\n{inner}\n</root></mxGraphModel></diagram></mxfile>\n"


def excalidraw(shown: Visible, options: Options) -> str:
    """A scene: boxes in layers with their texts, and arrows of right angles whose ends spread along the boxes' sides."""
    width, height, gap_x, gap_y = 180, 60, 60, 120
    base = lambda id_, kind, x, y, w, h: {"id": id_, "type": kind, "x": x, "y": y, "width": w, "height": h, "angle": 0, "strokeColor": "#1e1e1e", "backgroundColor": "transparent", "fillStyle": "solid", "strokeWidth": 1, "strokeStyle": "solid", "roughness": 0, "opacity": 100, "groupIds": [], "seed": zlib.crc32(id_.encode()), "version": 1, "isDeleted": False, "boundElements": [], "locked": False}
    elements, at = [], {}
    for y, row in enumerate(layout.ordered(shown)):
        for x, id_ in enumerate(row):
            at[id_] = (x * (width + gap_x), y * (height + gap_y))
            key = safe_id(id_)
            elements.append(base(key, "rectangle", *at[id_], width, height) | {"boundElements": [{"type": "text", "id": f"{key}-text"}]})
            elements.append(base(f"{key}-text", "text", at[id_][0] + 10, at[id_][1] + 20, width - 20, 20) | {"text": shown.names[id_], "originalText": shown.names[id_], "fontSize": 16, "fontFamily": 2, "textAlign": "center", "verticalAlign": "middle", "containerId": key, "lineHeight": 1.25})
    boxes = {e["id"]: e for e in elements}
    out, into = layout.ports(shown, at)
    for k, e in enumerate(shown.edges):
        (x1, y1), (x2, y2) = at[e["source"]], at[e["target"]]
        down = y2 > y1
        start, end = (x1 + width * out[k], y1 + (height if down else 0)), (x2 + width * into[k], y2 + (0 if down else height))
        dx, dy, key = end[0] - start[0], end[1] - start[1], f"arrow{k}"
        points = [[0, 0], [0, dy / 2], [dx, dy / 2], [dx, dy]] if dx else [[0, 0], [0, dy]]
        elements.append(base(key, "arrow", *start, abs(dx), abs(dy)) | {"points": points, "startBinding": {"elementId": safe_id(e["source"]), "focus": 0, "gap": 1}, "endBinding": {"elementId": safe_id(e["target"]), "focus": 0, "gap": 1}, "startArrowhead": None, "endArrowhead": "arrow", "elbowed": True})
        for end_ in ("source", "target"):
            boxes[safe_id(e[end_])]["boundElements"].append({"type": "arrow", "id": key})
        if label := edge_label(e, shown.names):
            elements.append(base(f"{key}-text", "text", start[0] + dx / 2, start[1] + dy / 2 - 10, 8 * len(label), 20) | {"text": label, "originalText": label, "fontSize": 12, "fontFamily": 2, "textAlign": "center", "verticalAlign": "middle", "containerId": key, "lineHeight": 1.25})
    background = options.theme[0] if theme.parse(options.theme[0]) else "#ffffff"
    return json.dumps({"type": "excalidraw", "version": 2, "source": "lattice", "elements": elements, "appState": {"viewBackgroundColor": background, "gridSize": None}, "files": {}}, ensure_ascii=False)


def page(shown: Visible, options: Options) -> str:
    return pages.diagram(options, mermaid(shown, options))


def forcegraph(shown: Visible, options: Options) -> str:
    return pages.force(shown, options)


FORMATS: dict[str, Callable[[Visible, Options], str]] = {"mermaid": mermaid, "plantuml": plantuml, "c4": c4, "json": as_json, "structurizr": structurizr, "drawio": drawio, "excalidraw": excalidraw, "html": page, "forcegraph": forcegraph}
#: These show all edges; the others show them reduced.
WHOLE = ("json", "forcegraph")


def render(graph: Graph, kind: str = "mermaid", options: Options = Options()) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}: {', '.join(FORMATS)}")
    return clipped(FORMATS[kind](visible(graph, options, reduce=kind not in WHOLE), options), options.max_chars)
