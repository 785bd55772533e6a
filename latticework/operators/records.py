"""Architecture decision records drawn from findings in the graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from . import communities, iterative, ranking, usage
from .relations import cross_repo_edges


def repo_cycles(g: Graph, longest: int | None = None) -> DataFrame:
    """(cycle): simple cycles of repos that call one another, closed, least repo first; `longest` bounds their members."""
    return iterative.cycles(cross_repo_edges(g).select(F.col("source_repo").alias("source"), F.col("target_repo").alias("target")), longest)


def _text(template: str, /, **columns):
    """A Column of a template with {named} columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if p or k % 2])


def _record(df: DataFrame, rule: int, order, tags: list, **texts) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), order.cast("string").alias("place"), *[(c if not isinstance(c, str) else F.lit(c)).alias(k) for k, c in texts.items()], F.array(*[F.lit(t) if isinstance(t, str) else t for t in tags]).alias("tags"))


def decision_records(g: Graph, date=None, longest_cycle: int | None = None) -> DataFrame:
    """Numbered proposals: (id, title, status, date, decision, context, consequences, alternatives, tags).

    Five rules in order: calls between repos, communities of several languages,
    hot nodes called from other repos, unused public symbols, cycles of repos.
    `date` is a Column, today if not given.
    """
    between = cross_repo_edges(g).groupBy("source_repo").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("target_repo")).alias("to"), F.min("ord").alias("first"))
    repo, n = F.col("source_repo"), F.col("n")
    one = _record(
        between, 1, F.format_string("%020d", "first"), ["cross-repo", "coupling", "subprocess", repo],
        title=_text("Calls from {r} into other repositories", r=repo),
        decision=_text("{r} depends at run time on {k} repositories: {to}", r=repo, k=F.size("to"), to=F.array_join("to", ", ")),
        context=_text("{n} edges lead from {r} to other repositories, which couples them.", n=n, r=repo),
        consequences=_text("A change in one of them can break {r}; they have to be deployed and tested in order.", r=repo),
        alternatives="Put a service interface or a queue between them, with a documented contract.",
    )
    found = communities.communities(g, mixed=True).where("dominant_language = 'mixed'")
    langs = F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    two = _record(
        found, 2, F.format_string("%020d", "number"), ["mixed-language", "community", "polyglot"],
        title=_text("Community of several languages: {l}", l=langs),
        decision=_text("Community {k} has {s} nodes in several languages: {l}", k=F.col("number"), s=F.col("size"), l=langs),
        context=_text("It spans {m} languages with density {d}.", m=F.size("languages"), d=F.format_number("density", 2)),
        consequences="Refactoring, building and debugging cross language borders.",
        alternatives="Separate the languages by an interface that belongs to neither.",
    )
    hot = ranking.hot_paths(g, 20)
    callers = g.edges.select("source", "target").distinct().join(g.nodes.select(F.col("id").alias("source"), F.col("repo").alias("caller_repo")).where("caller_repo <> ''"), "source")
    foreign = hot.join(callers.select(F.col("target").alias("id"), "caller_repo"), "id").where("caller_repo <> repo").agg(F.count_distinct("id").alias("n"))
    three = _record(
        foreign.where("n > 0"), 3, F.lit(""), ["hot-paths", "cross-repo", "critical-path"],
        title="Hot paths that other repositories depend on",
        decision=_text("{n} of the hottest nodes are called from other repositories", n=n),
        context="They have the most incoming edges of the whole graph, some of them from elsewhere.",
        consequences="A change or a slowdown there spreads over repositories.",
        alternatives="Keep these interfaces stable, version them and test them together.",
    )
    public = (F.coalesce("parent", F.lit("")) == "") | F.contains("filepath", F.lit("__init__")) | F.startswith("name", F.lit("export_"))
    unused = usage.classified(g).where("status = 'dead'").where(public).agg(F.count(F.lit(1)).alias("n"))
    four = _record(
        unused.where("n > 0"), 4, F.lit(""), ["dead-code", "public-api", "cleanup"],
        title="Unused symbols in public places",
        decision=_text("{n} unused symbols lie where a public interface would", n=n),
        context="Nothing calls them, and they have no parent, or lie in a package file, or are named as exports.",
        consequences="They cost maintenance and widen the attack surface.",
        alternatives="Remove them, or document who uses them.",
    )
    ring = F.array_join("cycle", " -> ")
    five = _record(
        repo_cycles(g, longest_cycle), 5, ring, ["circular-dependency", "cross-repo", "architecture"],
        title=_text("Repositories in a circle: {c}", c=ring),
        decision=_text("These repositories depend on one another in a circle: {c}", c=ring),
        context="The edges between repositories close a cycle.",
        consequences="None of them can be built or deployed before the others.",
        alternatives="Move what is shared into a library, or turn one direction into events.",
    )
    rows = one
    for more in (two, three, four, five):
        rows = rows.unionByName(more)
    number = F.row_number().over(Window.orderBy("rule", "place"))
    rows = rows.withColumn("number", number).withColumn("id", F.format_string("ADR-%03d", number))
    when = date if date is not None else F.date_format(F.current_date(), "yyyy-MM-dd")
    return rows.select("number", "id", "title", F.lit("proposed").alias("status"), when.alias("date"), "decision", "context", "consequences", "alternatives", "tags", "rule")


def markdown(records: DataFrame) -> DataFrame:
    """(file_name, content) of each record."""
    head = F.concat(*[F.concat(F.lit(f"{k}: "), F.col(k), F.lit("\n")) for k in ("id", "title", "status", "date")], F.lit("tags: ["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]\n"))
    sections = [F.concat(F.lit(f"\n## {name}\n"), F.col(name.lower()), F.lit("\n")) for name in ("Status", "Context", "Decision", "Consequences", "Alternatives")]
    content = F.concat(F.lit("---\n"), head, F.lit("---\n\n# "), F.col("id"), F.lit(": "), F.col("title"), F.lit("\n"), *sections, F.lit("\n## Tags\n"), F.array_join("tags", ", "), F.lit("\n"))
    name = F.concat(F.lower("id"), F.lit("-"), F.replace(F.lower("title"), F.lit(" "), F.lit("-")), F.lit(".md"))
    return records.select(name.alias("file_name"), content.alias("content"))
