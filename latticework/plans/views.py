"""Graphs seen in relational tables.

Each view is a pair of SELECTs in SQL that Spark and DuckDB both read, so the
tables need no other preparation; `{name}` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph

_NODE = "ord, id, name, kind, filepath, cast(0 as int) as line, docstring, signature, cast(null as varchar(10)) as parent, language, repo"

VIEWS: dict[str, tuple[str, str]] = {
    # Suppliers and parts; a line item is an edge from one to the other.
    "trade": (
        f"""select {_NODE} from (
          select s_suppkey as ord, concat('S:', cast(s_suppkey as varchar(20))) as id, s_name as name, 'class' as kind, concat('/trade/', n_name, '/suppliers') as filepath, '' as docstring, '' as signature, n_name as language, r_name as repo
          from {{supplier}} join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
          union all
          select 1000000000 + p_partkey, concat('P:', cast(p_partkey as varchar(20))), p_name, 'function', concat('/parts/', p_brand, '/list'), '', '', p_brand, '' from {{part}}) x""",
        """select l_orderkey * 100 + l_linenumber as ord, concat('S:', cast(l_suppkey as varchar(20))) as source, concat('P:', cast(l_partkey as varchar(20))) as target, 'calls' as relation, cast(l_linenumber as int) as line, '' as repo from {lineitem}""",
    ),
    # Orders call their customers, every third one by name.
    "custom": (
        f"""select {_NODE} from (
          select c_custkey as ord, concat('C:', cast(c_custkey as varchar(20))) as id, case when c_custkey = 1 then 'main' else c_name end as name, 'function' as kind, concat('/customers/', c_mktsegment, '/all') as filepath, '' as docstring, '' as signature, 'python' as language, c_mktsegment as repo from {{customer}}
          union all
          select 1000000000 + o_orderkey, concat('O:', cast(o_orderkey as varchar(20))), concat('order', cast(o_orderkey as varchar(20))), 'method', '/orders/all', '', '', 'sql', '' from {{orders}}) x""",
        """select o_orderkey as ord, concat('O:', cast(o_orderkey as varchar(20))) as source, case when o_orderkey % 3 = 0 then c_name else concat('C:', cast(o_custkey as varchar(20))) end as target, 'calls' as relation, 0 as line, '' as repo from {orders} join {customer} on o_custkey = c_custkey""",
    ),
    # Nations; an edge for each item from the supplier's to the customer's.
    "nations": (
        f"""select {_NODE} from (
          select cast(n_nationkey as bigint) as ord, concat('N:', cast(n_nationkey as varchar(20))) as id, n_name as name, 'function' as kind, concat('/', r_name, '/', n_name) as filepath, '' as docstring, '' as signature, r_name as language, r_name as repo from {{nation}} join {{region}} on n_regionkey = r_regionkey) x""",
        """select l_orderkey * 100 + l_linenumber as ord, concat('N:', cast(s_nationkey as varchar(20))) as source, concat('N:', cast(c_nationkey as varchar(20))) as target, 'calls' as relation, 0 as line, '' as repo
          from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey""",
    ),
    # Pages; a link leads to a path, and a page is named by its own path's last part.
    "web": (
        f"""select {_NODE} from (
          select page_id as ord, url as id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/([a-z]+)/[^/]*/?$', '\\1') as name, 'function' as kind, url as filepath, '' as docstring, '' as signature, 'html' as language, '' as repo from {{pages}}) x""",
        """select page_id * 100000 + cast(k as bigint) as ord, url as source, href as target, 'calls' as relation, 0 as line, '' as repo from {links}""",
    ),
    # Documents: text as docstring; document d calls d / 2 and d / 3.
    "corpus": (
        f"""select {_NODE} from (
          select doc_id as ord, concat('D:', cast(doc_id as varchar(20))) as id, concat(source, case when doc_id % 2 = 0 then '_parseDoc_' else 'LoadPage' end, lang) as name, case when doc_id % 5 = 0 then 'class' else 'function' end as kind, concat('/', source, '/', lang, '/doc') as filepath, text as docstring, concat('def f(', lang, ': str, n: int) if list[', source, ']') as signature, lang as language, source as repo from {{documents}}) x""",
        """select doc_id * 10 + k as ord, concat('D:', cast(doc_id as varchar(20))) as source, case when k = 1 then concat('D:', cast(floor(doc_id / 2) as bigint)) else concat('D:', cast(floor(doc_id / 3) as bigint)) end as target, 'calls' as relation, 0 as line, source as repo
          from {documents} cross join (select 1 as k union all select 2 as k) t""",
    ),
    # Documents in directories by source, in repos by language; document d calls d / 2.
    "shelves": (
        f"""select {_NODE} from (
          select doc_id as ord, concat('/', source, '/', cast(doc_id as varchar(20))) as id, concat('d', cast(doc_id as varchar(20))) as name, 'function' as kind, concat('/', source, '/', cast(doc_id as varchar(20))) as filepath, '' as docstring, '' as signature, lang as language, concat('repo-', lang) as repo from {{documents}}) x""",
        """select d.doc_id as ord, concat('/', d.source, '/', cast(d.doc_id as varchar(20))) as source, concat('/', b.source, '/', cast(b.doc_id as varchar(20))) as target, 'calls' as relation, 0 as line, '' as repo
          from {documents} d join {documents} b on b.doc_id = cast(floor(d.doc_id / 2) as bigint) where d.doc_id > 0""",
    ),
    # Event types; an edge from each event of a user to that user's next.
    "events": (
        f"""select {_NODE} from (
          select row_number() over (order by event_type) as ord, event_type as id, event_type as name, 'function' as kind, concat('/', event_type, '/e') as filepath, '' as docstring, '' as signature, 'log' as language, event_type as repo from (select distinct event_type from {{events}}) y) x""",
        """select event_id as ord, event_type as source, following as target, 'calls' as relation, 0 as line, '' as repo
          from (select event_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as following from {events}) z where following is not null""",
    ),
    # Documents in directories by source and language; those of every fourth source import one module of their language, and each imports itself.
    "folders": (
        f"""select {_NODE} from (
          select doc_id as ord, concat('/', source, '/', lang, '/', cast(doc_id as varchar(20))) as id, cast(doc_id as varchar(20)) as name, 'function' as kind, concat('/', source, '/', lang, '/', cast(doc_id as varchar(20))) as filepath, '' as docstring, '' as signature, lang as language, source as repo from {{documents}}) x""",
        """select doc_id as ord, concat('/', source, '/', lang, '/', cast(doc_id as varchar(20))) as source, concat('m', cast(cast(substr(source, 4) as int) % 4 as varchar(20)), lang) as target, 'imports' as relation, 0 as line, source as repo from {documents}
           union all select 1000000000 + doc_id, concat('/', source, '/', lang, '/', cast(doc_id as varchar(20))), concat('/', source, '/', lang, '/', cast(doc_id as varchar(20))), 'imports', 0, source from {documents}""",
    ),
}

#: The links of pages in either dialect.
_LINKS_SPARK = "select page_id, url, k, href from {pages} lateral view posexplode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) t as k, href"
_LINKS_DUCK = "select page_id, url, unnest(range(len(h))) as k, unnest(h) as href from (select page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as h from pages)"


def view(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The named graph over the tables in `sf_dir`; ids are distinct."""
    nodes, edges = VIEWS[name]
    tables: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", nodes + edges)) - {"links"}}
    if "{links}" in edges:
        tables["links"] = spark.sql(_LINKS_SPARK, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    run = lambda q: spark.sql(q.replace("'\\1'", "'$1'"), **{t: d for t, d in tables.items() if "{" + t + "}" in q})
    return Graph.of(run(nodes), run(edges), distinct_ids=True)


def duck(name: str) -> str:
    """Common table expressions `nodes` and `edges` of a graph in DuckDB."""
    nodes, edges = (re.sub(r"\{(\w+)\}", r"\1", q) for q in VIEWS[name])
    links = f"links as ({_LINKS_DUCK}), " if " links" in edges else ""
    return f"{links}nodes as ({nodes}), edges as ({edges})"
