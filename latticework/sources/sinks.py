"""Writers: Parquet, graph JSON, reports, pages."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import communities, ranking, records, relations, stats, usage

LANGUAGE_COLOURS = {"python": "#3572a5", "go": "#00add8", "typescript": "#3178c6", "javascript": "#f1e05a", "rust": "#dea584", "java": "#b07219", "unknown": "#888888"}
PALETTE = ("#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#bcf60c", "#fabebe", "#008080")


def write_parquet(g: Graph, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The native form; partitioning by language or repo prunes lookups by them."""
    g.nodes.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def json_document(g: Graph) -> DataFrame:
    """One row, one column: {nodes, edges, communities} of the whole graph.  For graphs that fit one row; others go to Parquet."""
    rows = lambda df: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c != "ord"]).alias("x")))), lambda e: e["x"]).alias("a"))
    label = communities.labels(g).agg(F.map_from_entries(F.collect_list(F.struct("id", "community"))).alias("c"))
    whole = rows(g.nodes).withColumnRenamed("a", "nodes").crossJoin(rows(g.edges).withColumnRenamed("a", "edges")).crossJoin(label)
    return whole.select(F.to_json(F.struct("nodes", "edges", F.col("c").alias("communities")), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_json_document(g: Graph, path: str) -> None:
    """A folder with one text file that holds `json_document`."""
    json_document(g).coalesce(1).write.mode("overwrite").text(path)


def write_json(g: Graph, path: str) -> None:
    """A folder of JSON lines in parts, nodes, edges and communities (id, community), that `read_json` reads; of any size."""
    for name, table in (("nodes", g.nodes), ("edges", g.edges), ("communities", communities.labels(g))):
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def usage_report(g: Graph, path: str, entry_points: tuple[str, ...] = (), include_suspicious: bool = False) -> None:
    """JSON lines of the classified nodes that the report shows."""
    shown = ["dead", "entry", *(["suspicious"] if include_suspicious else [])]
    usage.classified(g, entry_points).where(F.col("status").isin(shown)).write.mode("overwrite").json(path)


def write_records(found: DataFrame, folder: str) -> list[str]:
    """One Markdown file per record; records are few, so the driver writes them."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for r in records.markdown(found).toLocalIterator():
        safe = r["file_name"].replace("/", "-")
        Path(folder, safe).write_text(r["content"], encoding="utf-8")
        names.append(safe)
    return names


def styled_nodes(g: Graph, hot: DataFrame | None = None) -> DataFrame:
    """Nodes with colour, community colour, radius and cluster place for drawing."""
    hot = ranking.hot_paths(g, 50) if hot is None else hot
    label = communities.numbered(communities.describe(g, communities.labels(g)))
    member = communities.labels(g).join(label.select("community", "number"), "community").select("id", "number")
    colours = F.create_map(*[F.lit(x) for kv in LANGUAGE_COLOURS.items() for x in kv])
    top = hot.select("id", "score").crossJoin(F.broadcast(hot.agg(F.max("score").alias("most"))))
    bonus = F.when(F.col("most") > 0, 12 * F.col("score") / F.col("most")).otherwise(0.0)
    base = F.when(F.col("kind") == "function", 8.0).when(F.col("kind") == "class", 10.0).otherwise(6.0)
    styled = g.nodes.join(F.broadcast(top), "id", "left").join(member, "id")
    cell = F.col("number") - 1
    palette = F.array(*[F.lit(c) for c in PALETTE])
    return styled.select(
        "ord", "id", "name", "kind", "filepath", "docstring", "signature", "language", "repo", F.col("number").alias("community"),
        F.coalesce(F.try_element_at(colours, F.col("language")), F.lit(LANGUAGE_COLOURS["unknown"])).alias("colour"),
        F.get(palette, (cell % len(PALETTE)).cast("int")).alias("community_colour"), (base + F.when(F.col("score").isNotNull(), bonus).otherwise(0.0)).alias("radius"),
        F.col("score").isNotNull().alias("is_hot"), ((cell % 4) * 300 + 150).alias("x"), (F.floor(cell / 4) * 300 + 150).alias("y"),
    )


def styled_edges(g: Graph) -> DataFrame:
    """Edges between nodes with colour and dash; those between repos stand out."""
    crossing = relations.cross_repo_edges(g).select("ord", F.lit(True).alias("x"))
    joined = g.inner_edges().join(crossing, "ord", "left")
    return joined.select("ord", "source", "target", "relation", F.when(F.col("x"), "#ff4d4d").otherwise("#999999").alias("colour"), F.when(F.col("x"), "6,3").otherwise("").alias("dash"))


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;margin:1em}}svg{{border:1px solid #ccc}}td,th{{padding:2px 8px;text-align:left}}</style></head>
<body><h1>{title}</h1>{body}<script id="data" type="application/json">{data}</script><script>{script}</script></body></html>
"""

_DRAW = """
const data=JSON.parse(document.getElementById('data').textContent),svg=document.getElementById('graph'),ns=svg.namespaceURI,at={};
data.nodes.forEach((n,i)=>{const a=i*2.4,r=6*Math.sqrt(i%200);at[n.id]=[n.x+r*Math.cos(a),n.y+r*Math.sin(a)]});
const make=(t,o)=>{const e=document.createElementNS(ns,t);for(const k in o)e.setAttribute(k,o[k]);svg.appendChild(e);return e};
data.edges.forEach(e=>{const s=at[e.source],t=at[e.target];if(s&&t)make('line',{x1:s[0],y1:s[1],x2:t[0],y2:t[1],stroke:e.colour,'stroke-dasharray':e.dash})});
data.nodes.forEach(n=>{const c=make('circle',{cx:at[n.id][0],cy:at[n.id][1],r:n.radius,fill:n.colour,stroke:n.community_colour});const t=document.createElementNS(ns,'title');t.textContent=n.id;c.appendChild(t)});
document.getElementById('q').addEventListener('input',ev=>{const ws=ev.target.value.toLowerCase().split(/[\\s_]+/).filter(w=>w.length>1);
const of=n=>ws.reduce((s,w)=>s+(n.name.toLowerCase().includes(w)?10:0)+((n.docstring||'').toLowerCase().includes(w)?3:0)+((n.filepath||'').toLowerCase().includes(w)?1:0)+(n.name.toLowerCase().startsWith(w)?5:0),0);
document.getElementById('hits').textContent=data.nodes.map(n=>[of(n),n.name]).filter(x=>x[0]>0).sort((a,b)=>b[0]-a[0]).slice(0,10).map(x=>x[1]).join(', ')});
"""


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    head = "".join(cell("th", k) for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r.values()) + "</tr>" for r in rows) + "</table>"


def write_page(g: Graph, path: str, hot: DataFrame | None = None) -> None:
    """The graph as one page with a drawing and a search box; for graphs that a browser can draw."""
    data = {"nodes": _rows(styled_nodes(g, hot).orderBy("ord")), "edges": _rows(styled_edges(g).orderBy("ord"))}
    body = '<p><input id="q" placeholder="search"> <span id="hits"></span></p><svg id="graph" width="1200" height="900"></svg>'
    text = json.dumps(data).replace("</", "<\\/")
    Path(path).write_text(_PAGE.format(title="Knowledge graph", body=body, data=text, script=_DRAW), encoding="utf-8")


def write_dashboard(g: Graph, path: str) -> None:
    """Repos, calls between them, communities, hot paths and unused symbols on one page; every table is an aggregate."""
    parts = {
        "Repositories": stats.repo_stats(g), "Calls between repositories": stats.cross_repo_matrix(g), "Communities": communities.overview(g),
        "Hot paths": ranking.hot_paths_per_repo(g).orderBy("repo", "place"), "Unused symbols": usage.dead_per_repo(g).orderBy("repo"),
    }
    tables = {k: _rows(v) for k, v in parts.items()}
    body = "".join(f"<h2>{k}</h2>{_table(v)}" for k, v in tables.items())
    Path(path).write_text(_PAGE.format(title="Workspace dashboard", body=body, data=json.dumps(tables, default=str).replace("</", "<\\/"), script=""), encoding="utf-8")


def schema_document() -> str:
    """The tables' schemas as DDL."""
    from ..model import EDGE_SCHEMA, NODE_SCHEMA

    return "\n".join(f"{name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in s)})" for name, s in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA)))
