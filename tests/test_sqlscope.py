"""The SQL reader: goldens, fixed readings, and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.functions import sqlscope as s


def rows(sql, dependencies=False):
    return [(f"{m.source_database}.{m.source_table}.{m.source_column}".strip("."), m.target_column, m.sql_operation) for m in s.column_mappings(sql, dependencies) if m.primary]


CHAIN = """
-- DOMAIN: d
WITH daily AS (
  SELECT t.id, t.acc, t.amount, t.at, ROW_NUMBER() OVER (PARTITION BY t.acc ORDER BY t.at DESC) AS rn
  FROM bronze.moves t WHERE t.at >= DATE_SUB(CURRENT_DATE(), 365)
), per_acc AS (
  SELECT a.acc, a.cust, SUM(d.amount) AS total, COUNT(*) AS n FROM daily d JOIN bronze.accounts a ON d.acc = a.acc WHERE d.rn <= 100 GROUP BY a.acc, a.cust
), scored AS (
  SELECT c.cust, c.name, p.total, CASE WHEN p.total > 10 THEN 'HIGH' ELSE 'LOW' END AS risk, ROW_NUMBER() OVER (ORDER BY p.total DESC) AS place
  FROM per_acc p JOIN bronze.customers c ON p.cust = c.cust
)
INSERT INTO gold.risk SELECT x.cust, x.name, x.total, x.risk, x.place, CURRENT_TIMESTAMP() AS made FROM scored x WHERE x.place <= 10
"""


def test_cte_chain():
    assert rows(CHAIN) == [
        ("bronze.customers.cust", "cust", "SELECT"), ("bronze.customers.name", "name", "SELECT"), ("bronze.moves.amount", "total", "AGGREGATE"),
        ("bronze.moves.amount", "risk", "ALIAS"), ("bronze.moves.amount", "place", "WINDOW, FILTER")]


def test_dependencies_come_first():
    assert rows(CHAIN, True)[:5] == [
        ("bronze.moves.at", "—", "FILTER_DEPENDENCY"), ("bronze.moves.acc", "—", "FILTER_DEPENDENCY, JOIN_KEY"), ("bronze.accounts.acc", "—", "JOIN_KEY"),
        ("bronze.accounts.cust", "—", "JOIN_KEY"), ("bronze.customers.cust", "—", "JOIN_KEY")]


def test_joined_table_without_alias_is_seen():
    assert ("y.b.v", "v", "SELECT") in rows("INSERT INTO t SELECT a.k, b.v FROM x.a JOIN y.b ON a.k = b.k")


def test_star_and_set_branches():
    assert rows("CREATE VIEW v AS SELECT * FROM a.b") == [("a.b.*", "*", "SELECT")]
    everything = {m[:3] for m in s.column_mappings("INSERT INTO t SELECT x FROM a UNION ALL SELECT y FROM b")}
    assert everything == {("", "a", "x"), ("", "b", "y")}


def test_semicolon_in_text_and_comment():
    assert len(s.split_statements("SELECT ';' -- a;b\n; /* ; */ SELECT 2;")) == 2


def test_inner_alias_does_not_leak():
    assert rows("INSERT INTO t WITH q AS (SELECT p.id FROM d.p p) SELECT q.id, SUM(p.cost) AS c FROM q") == [("d.p.id", "id", "SELECT"), ("cost", "c", "AGGREGATE")]


def test_self_join_resolves_bare_column_to_nothing_and_qualified_ones():
    assert rows("INSERT INTO t SELECT a.v, b.v AS w, z FROM d.t1 a JOIN d.t1 b ON a.i = b.i") == [("d.t1.v", "v", "SELECT"), ("d.t1.v", "w", "ALIAS"), ("z", "z", "SELECT")]


def test_merge_update_delete_overwrite():
    assert ("s.u.a", "a", "SELECT") in rows("MERGE INTO g.m USING s.u ON m.id = u.id WHEN MATCHED THEN UPDATE SET a = u.a WHEN NOT MATCHED THEN INSERT (id) VALUES (u.id)")
    assert ("g.t.y", "x", "SELECT") in rows("UPDATE g.t SET x = y WHERE z = 1") or ("g.t.y", "x", "ALIAS") in rows("UPDATE g.t SET x = y WHERE z = 1")
    assert s.read_statement("DELETE FROM g.t WHERE a = 1").target == ("g", "t")
    assert s.read_statement("INSERT OVERWRITE TABLE g.t SELECT 1").target == ("g", "t")
    assert s.read_statement("OPTIMIZE g.t") is None


def test_lateral_view_subquery_and_using():
    assert rows("INSERT INTO o SELECT e.x FROM d.t LATERAL VIEW explode(t.xs) e AS x")[0][0] == "d.t.xs"
    assert ("d.v.n", "k", "AGGREGATE") in rows("INSERT INTO o SELECT (SELECT MAX(v.n) FROM d.v v WHERE v.g = r.g) AS k FROM d.r r")
    assert ("d.a.k", "k", "SELECT, JOIN") in rows("INSERT INTO o SELECT a.k FROM d.a JOIN d.b USING (k)")


def test_every_source_of_an_expression_is_kept():
    found = s.column_mappings("INSERT INTO t WITH q AS (SELECT o.a * o.b AS c FROM d.o o) SELECT SUM(q.c) AS s FROM q")
    assert {(m.source_column, m.primary) for m in found} == {("a", False), ("b", True)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_reader_never_fails(text):
    s.column_mappings(text, True)


_rows = st.lists(st.builds(s.Mapping, st.sampled_from(["", "d"]), st.sampled_from(["", "t"]), st.sampled_from("ab"), st.just("g"), st.sampled_from("xy"), st.sampled_from("cd"), st.sampled_from(["SELECT", "JOIN", "FILTER", "JOIN_KEY"])))


@settings(max_examples=100, deadline=None)
@given(_rows)
def test_merge_is_idempotent_for_single_operations(found):
    once = s.merged(found)
    split = [m._replace(sql_operation=op) for m in once for op in m.sql_operation.split(", ")]
    assert s.merged(split) == once
