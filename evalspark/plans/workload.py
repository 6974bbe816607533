"""Query shapes, and a small evaluation workload over the given tables."""

from __future__ import annotations

# One text per shape; both engines run it as it stands.
SHAPES = {
    "w_projection": "SELECT o_orderkey, o_orderstatus FROM orders",
    "w_filter": "SELECT p_name, p_retailprice FROM part WHERE p_type = 'ECONOMY' AND p_size > 20",
    "w_join_two": """SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "w_join_three": """SELECT n.n_name, c.c_name, o.o_orderkey FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "w_anti": """SELECT p.p_partkey, p.p_name FROM part p LEFT JOIN lineitem l
        ON p.p_partkey = l.l_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 30 WHERE l.l_partkey IS NULL""",
    "w_join_group": """SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(AVG(o.o_totalprice), 4) AS avg_price,
          ROUND(SUM(o.o_totalprice * 2), 2) AS doubled
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    "w_global_agg": """SELECT ROUND(AVG(l_extendedprice), 4) AS avg_price, COUNT(*) AS n,
          ROUND(SUM(l_discount), 2) AS discounts FROM lineitem WHERE l_returnflag = 'A'""",
    "w_having": """SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey HAVING COUNT(*) >= 30""",
    "w_order": "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name",
    "w_topk": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "w_in_having": """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN
        (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 6)""",
    "w_nested_scalar": """SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders
        WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders))""",
    "w_scalar_sub": """SELECT c_custkey, c_name FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)""",
    "w_cte": """WITH best AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey)
        SELECT c.c_name, b.top FROM customer c JOIN best b ON c.c_custkey = b.o_custkey""",
    "w_empty": "SELECT c_name FROM customer WHERE c_mktsegment = 'NOWHERE'",
    "w_union": """SELECT name FROM (SELECT c_mktsegment AS name FROM customer
        UNION SELECT p_type FROM part) u""",
    "w_recursive": """WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 9)
        SELECT n.i, COUNT(l.l_orderkey) AS lines FROM n LEFT JOIN lineitem l ON l.l_linenumber = n.i GROUP BY n.i""",
}

# Example, gold SQL, and candidates with the verdict each deserves.
EVALUATION = {
    "segment-count": (
        "SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment",
        [
            ("SELECT COUNT(c_custkey) AS n, c_mktsegment FROM customer GROUP BY 2", "not_equivalent"),
            ("SELECT c_mktsegment AS s, SUM(1) AS n FROM customer GROUP BY c_mktsegment ORDER BY n", "unordered_rows"),
            ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "not_equivalent"),
            ("SELECT c_mktsegment, COUNT(*) FROM clients GROUP BY c_mktsegment", "not_equivalent"),
        ],
    ),
    "status-average": (
        "SELECT o_orderstatus, AVG(o_totalprice) FROM orders GROUP BY o_orderstatus",
        [
            ("SELECT o_orderstatus, SUM(o_totalprice) / COUNT(*) FROM orders GROUP BY o_orderstatus", "unordered_rows"),
            ("SELECT o_orderstatus, AVG(o_totalprice) + 0.001 FROM orders GROUP BY o_orderstatus", "not_equivalent"),
            ("SELECT o_orderstatus, AVG(o_price) FROM orders GROUP BY o_orderstatus", "not_equivalent"),
        ],
    ),
    "top-orders": (
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
        [
            ("""SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders) t
             ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""", "ordered_rows"),
            ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5", "not_equivalent"),
            ("""SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders
             ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) t ORDER BY o_totalprice, o_orderkey DESC""", "not_equivalent"),
            ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4", "not_equivalent"),
        ],
    ),
    "big-spenders": (
        "SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 400000",
        [
            ("""SELECT COUNT(*) FROM customer WHERE c_custkey IN
             (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""", "unordered_rows"),
            ("SELECT COUNT(*) FROM orders WHERE o_totalprice > 400000; DROP TABLE orders", "unsafe_sql"),
            ("DELETE FROM orders", "unsafe_sql"),
            ("SELEC COUNT(*) FROM orders", "syntax_error"),
        ],
    ),
    "nobody": (
        "SELECT c_name FROM customer WHERE c_mktsegment = 'NOWHERE'",
        [
            ("SELECT c_name FROM customer WHERE 1 = 0", "empty_structural_partial"),
            ("SELECT 'x' WHERE 1 = 0", "empty_unverified"),
            ("SELECT s_name FROM supplier WHERE 1 = 0", "empty_unverified"),
            ("SELECT c_name FROM customer", "not_equivalent"),
        ],
    ),
    "all-lines": (
        "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber",
        [
            ("SELECT l_orderkey + 0, l_linenumber FROM lineitem ORDER BY 1, 2", "ordered_rows"),
            ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber, l_orderkey", "not_equivalent"),
            ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 1", "not_equivalent"),
        ],
    ),
    "flag-lines": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2",
        [
            ("""SELECT l_returnflag, l_linestatus, COUNT(1), MAX(l_quantity) FROM lineitem
             GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", "ordered_rows"),
            ("""SELECT l_returnflag, l_linestatus, COUNT(1), MAX(l_quantity) FROM lineitem
             GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag DESC, l_linestatus""", "not_equivalent"),
        ],
    ),
}
