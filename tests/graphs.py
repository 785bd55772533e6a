"""Small graphs for tests."""

from latticework.model import Graph


def graph(spark, nodes, edges):
    """nodes: (id, name, *more as a dict); edges: (source, target) or (source, target, relation)."""
    n = [{"ord": k, "id": x[0], "name": x[1], "kind": "function", "filepath": "/f.py", "docstring": "", "signature": "", "language": "python", "repo": "", "parent": None, "line": k} | (x[2] if len(x) > 2 else {}) for k, x in enumerate(nodes)]
    e = [(k, x[0], x[1], x[2] if len(x) > 2 else "calls", 0, x[3] if len(x) > 3 else "") for k, x in enumerate(edges)]
    schema = "ord long, id string, name string, kind string, filepath string, docstring string, signature string, language string, repo string, parent string, line int"
    return Graph.of(spark.createDataFrame(n, schema), spark.createDataFrame(e, "ord long, source string, target string, relation string, line int, repo string"))


def hot(spark):
    return graph(spark, [("n1", "main"), ("n2", "helper"), ("n3", "parse_json"), ("n4", "unused"), ("n5", "bridge")], [("n1", "n2"), ("n1", "n3"), ("n2", "n3"), ("n4", "n3"), ("n5", "n1")])
