"""Result equivalence over an order's rows, six candidates for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.screening import has_order_by, outer_order_by, source_tables
from evalspark.operators import equivalence
from evalspark.plans.registry import Tables, query

RESULT_COLUMNS = ["price", "flag", "n"]

# What is compared, spelled out for the check: prices to six places.
_BAG = "o, round(price, 6) AS price, flag, n"


def long_rows(t: Tables, name: str):
    rows = t.adapted(name)
    keys = ["example_id"]
    if "k" in rows.columns:
        keys.append(F.col("k").alias("candidate_index"))
    return rows.select(*keys, "row_idx", equivalence.cells(rows, RESULT_COLUMNS).alias("cells"))


@query(
    "equiv_unordered",
    f""", g AS (SELECT {_BAG}, count(*) AS c FROM gold_rows GROUP BY ALL),
    m AS (SELECT k, {_BAG}, count(*) AS c FROM candidate_rows GROUP BY ALL),
    p AS (SELECT DISTINCT o, k FROM candidate_rows),
    bad AS (
      SELECT m.o, m.k FROM m LEFT JOIN g USING (o, price, flag, n) WHERE m.c IS DISTINCT FROM g.c
      UNION SELECT p.o, p.k FROM p JOIN g USING (o) LEFT JOIN m USING (o, k, price, flag, n) WHERE m.c IS NULL)
    SELECT 'o-' || p.o AS example_id, p.k AS candidate_index, bad.o IS NULL AS rows_match
    FROM p LEFT JOIN bad USING (o, k)""",
    "candidate_rows",
)
def equiv_unordered(t: Tables):
    """Multiset comparison of every candidate's rows with gold's."""
    return equivalence.unordered_matches(long_rows(t, "candidate_rows"), long_rows(t, "gold_rows"))


_CLOSE = "abs(m.price - g.price) <= 1e-6 * greatest(1.0, abs(m.price), abs(g.price))"


@query(
    "equiv_ordered",
    f""", j AS (SELECT m.o, m.k, m.row_idx, CASE WHEN g.o IS NULL OR NOT ({_CLOSE}) THEN 0
        WHEN m.flag <> g.flag THEN 1 WHEN m.n <> g.n THEN 2 END AS bad
      FROM candidate_rows m LEFT JOIN gold_rows g USING (o, row_idx)),
    f AS (SELECT o, k, min(row_idx) FILTER (bad IS NOT NULL) AS bad_row FROM j GROUP BY o, k)
    SELECT 'o-' || f.o AS example_id, f.k AS candidate_index, f.bad_row, CAST(j.bad AS BIGINT) AS bad_col
    FROM f LEFT JOIN j ON j.o = f.o AND j.k = f.k AND j.row_idx = f.bad_row""",
    "candidate_rows",
)
def equiv_ordered(t: Tables):
    """Row-by-row comparison, and where the first difference is."""
    found = equivalence.ordered_mismatches(
        long_rows(t, "candidate_rows"), long_rows(t, "gold_rows")
    )
    return found.withColumn("bad_col", F.col("bad_col").cast("bigint"))


_GOLD_SQL = """CASE o % 3 WHEN 0 THEN 'SELECT l_extendedprice, l_returnflag, n FROM lineitem ORDER BY l_linenumber'
      ELSE 'SELECT l_extendedprice, l_returnflag, n FROM lineitem' END"""


def runs(t: Tables):
    """Headers of the runs: some failed, some truncated, some with other column names."""
    gold = t.adapted("gold_rows").groupBy("example_id", "o").agg(F.count("*").alias("row_count"))
    gold_runs = gold.select(
        "example_id",
        F.when(
            F.col("o") % 3 == 0,
            "SELECT l_extendedprice, l_returnflag, n FROM lineitem ORDER BY l_linenumber",
        )
        .otherwise("SELECT l_extendedprice, l_returnflag, n FROM lineitem")
        .alias("sql"),
        (F.col("o") % 50 != 1).alias("success"),
        F.array(*[F.lit(c) for c in RESULT_COLUMNS]).alias("columns"),
        "row_count",
        (F.col("o") % 50 == 2).alias("truncated"),
        F.array(F.lit("lineitem"), F.lit("orders")).alias("schema_tables"),
    )
    mine = t.adapted("candidate_rows").groupBy("example_id", "o", "k").agg(F.count("*").alias("row_count"))
    named = F.when(F.col("o") % 4 == 0, F.array(*[F.lit(c) for c in RESULT_COLUMNS])).when(
        F.col("o") % 50 == 3, F.array(F.lit("price"))
    )
    candidate_runs = mine.select(
        "example_id",
        F.col("k").alias("candidate_index"),
        F.lit("SELECT * FROM lineitem").alias("sql"),
        (F.col("o") % 50 != 4).alias("success"),
        F.coalesce(named, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("columns"),
        F.when(F.col("o") % 50 == 4, "timeout").otherwise("none").alias("error_type"),
        F.lit("").alias("error_message"),
        "row_count",
        (F.col("o") % 50 == 5).alias("truncated"),
    )
    return candidate_runs, gold_runs


@query(
    "equiv_verdicts",
    f""", g AS (SELECT {_BAG}, count(*) AS c FROM gold_rows GROUP BY ALL),
    m AS (SELECT k, {_BAG}, count(*) AS c FROM candidate_rows GROUP BY ALL),
    gs AS (SELECT o, count(*) AS size FROM gold_rows GROUP BY o),
    p AS (SELECT o, k, count(*) AS size FROM candidate_rows GROUP BY o, k),
    bag_bad AS (SELECT m.o, m.k FROM m LEFT JOIN g USING (o, price, flag, n) WHERE m.c IS DISTINCT FROM g.c
      UNION SELECT p.o, p.k FROM p JOIN g USING (o) LEFT JOIN m USING (o, k, price, flag, n) WHERE m.c IS NULL),
    list_all AS (SELECT m.o, m.k, m.row_idx, CASE WHEN g.o IS NULL OR NOT ({_CLOSE}) THEN 0
        WHEN m.flag <> g.flag THEN 1 WHEN m.n <> g.n THEN 2 END AS bad
      FROM candidate_rows m LEFT JOIN gold_rows g USING (o, row_idx)),
    list_bad AS (SELECT o, k, min(row_idx) AS bad_row, arg_min(bad, row_idx) AS bad_col
      FROM list_all WHERE bad IS NOT NULL GROUP BY o, k),
    j AS (SELECT p.o, p.k, p.size AS n, gs.size AS gold_n, p.o % 3 = 0 AS ordered,
        CASE WHEN p.o % 50 = 1 THEN 'fail' WHEN p.o % 50 = 4 THEN 'fail' WHEN p.o % 50 IN (2, 5) THEN 'cut'
          WHEN p.o % 50 = 3 AND p.o % 4 <> 0 THEN 'fail' ELSE 'go' END AS gate,
        CASE WHEN p.o % 3 = 0 THEN p.size = gs.size AND lb.o IS NULL ELSE bb.o IS NULL END AS same, bad_row, bad_col
      FROM p JOIN gs USING (o) LEFT JOIN bag_bad bb USING (o, k) LEFT JOIN list_bad lb USING (o, k))
    SELECT 'o-' || o AS example_id, k AS candidate_index, gate = 'go' AND same AS strict_equivalent,
      false AS partial_credit,
      CASE WHEN gate = 'cut' THEN 'truncated_unverified' WHEN gate = 'fail' OR NOT same THEN 'not_equivalent'
        WHEN ordered THEN 'ordered_rows' ELSE 'unordered_rows' END AS kind,
      n AS candidate_row_count, gold_n AS gold_row_count, o % 4 = 0 AS column_match,
      o % 4 = 0 OR o % 50 <> 3 AS column_count_match, ordered AND gate = 'go' AS order_sensitive,
      CASE WHEN o % 50 = 1 THEN 'gold query failed' WHEN o % 50 = 4 THEN 'candidate failed: timeout'
        WHEN gate = 'cut' THEN 'a result is truncated' WHEN gate = 'fail' THEN 'column counts differ'
        WHEN n <> gold_n AND ordered THEN 'row counts differ' WHEN n <> gold_n THEN 'row multisets differ'
        WHEN same THEN 'rows match'
        WHEN ordered THEN 'ordered mismatch at row ' || bad_row || ' column ' || bad_col
        ELSE 'row multisets differ' END AS reason, '' AS problems FROM j""",
    "candidate_rows",
)
def equiv_verdicts(t: Tables):
    """Full verdicts: gates, both comparisons and the record of each candidate."""
    candidate_runs, gold_runs = runs(t)
    judged = equivalence.verdicts(
        candidate_runs, gold_runs, long_rows(t, "candidate_rows"), long_rows(t, "gold_rows"), by_example=True
    )
    return judged.drop("equivalent").withColumn("problems", F.array_join("problems", "; "))


@query(
    "equiv_empty",
    """, s AS (SELECT ord, example_id, evidence AS lang, CASE ord % 6
        WHEN 0 THEN 'SELECT 1 WHERE 1 = 0'
        WHEN 1 THEN 'SELECT text FROM docs_' || evidence || ' WHERE 1 = 0'
        WHEN 2 THEN 'SELECT text FROM docs_' || evidence || ' d JOIN labels l ON d.doc_id = l.doc_id WHERE 1 = 0'
        WHEN 3 THEN 'SELECT x FROM nowhere WHERE 1 = 0'
        WHEN 4 THEN 'SELECT doc_id FROM labels, docs_' || evidence || ' WHERE 1 = 0' END AS sql FROM examples),
    v AS (SELECT example_id, CASE ord % 6 WHEN 0 THEN 'no source table'
        WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'tables beyond gold''s; unknown tables' WHEN 4 THEN ''
        ELSE 'no candidate SQL; no source table' END AS problems FROM s)
    SELECT example_id, 0 AS candidate_index, false AS strict_equivalent, problems = '' AS partial_credit,
      CASE WHEN problems = '' THEN 'empty_structural_partial' ELSE 'empty_unverified' END AS kind, problems FROM v""",
    "examples",
)
def equiv_empty(t: Tables):
    """Two empty results count for something only if the tables make sense."""
    examples = t.adapted("examples").withColumn("docs", F.concat(F.lit("docs_"), "evidence"))
    texts = {
        0: F.lit("SELECT 1 WHERE 1 = 0"),
        1: F.format_string("SELECT text FROM %s WHERE 1 = 0", "docs"),
        2: F.format_string(
            "SELECT text FROM %s d JOIN labels l ON d.doc_id = l.doc_id WHERE 1 = 0", "docs"
        ),
        3: F.lit("SELECT x FROM nowhere WHERE 1 = 0"),
        4: F.format_string("SELECT doc_id FROM labels, %s WHERE 1 = 0", "docs"),
    }
    sql = F.coalesce(*[F.when(F.col("ord") % 6 == k, v) for k, v in texts.items()])
    header = [
        F.lit(True).alias("success"),
        F.array(F.lit("x")).alias("columns"),
        F.lit("none").alias("error_type"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.lit(False).alias("truncated"),
    ]
    gold = examples.select(
        "example_id",
        F.format_string("SELECT text FROM %s JOIN labels USING (doc_id) WHERE 1 = 0", "docs").alias("sql"),
        *header,
        F.array("docs", F.lit("labels")).alias("schema_tables"),
    )
    mine = examples.select("example_id", F.lit(0).alias("candidate_index"), sql.alias("sql"), *header)
    none = long_rows(t, "candidate_rows").filter("false")
    judged = equivalence.verdicts(mine, gold, none, none.drop("candidate_index"))
    return judged.select(
        "example_id",
        "candidate_index",
        "strict_equivalent",
        "partial_credit",
        "kind",
        F.array_join("problems", "; ").alias("problems"),
    )


@query(
    "cell_normalization",
    """SELECT 'ev-' || event_id AS example_id, CASE k % 5 WHEN 0 THEN 'null'
        WHEN 1 THEN 'num:' || CAST(k * 1000000 AS VARCHAR) WHEN 2 THEN 'bool:' || CAST(k > 50 AS VARCHAR)
        WHEN 3 THEN 'str:' || event_type ELSE 'num:nan' END AS cell,
      'num:' || CAST(CAST(CAST(value AS DECIMAL(20, 2)) * 1000000 AS BIGINT) AS VARCHAR) AS amount
    FROM event_fields""",
    "event_fields",
)
def cell_normalization(t: Tables):
    """Cells read from logged JSON results, and the text they are compared by."""
    k = F.col("k")
    events = t.adapted("event_fields")
    json = (
        F.when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".0000001")))
        .when(k % 5 == 2, (k > 50).cast("string"))
        .when(k % 5 == 3, F.to_json(F.struct("event_type")))
        .otherwise("null")
    )
    value = F.when(k % 5 == 3, F.variant_get(F.parse_json(json), "$.event_type", "variant")).otherwise(
        F.parse_json(json)
    )
    logged = equivalence.cell_from_variant(value)
    nan = F.struct(
        F.lit("num").alias("tag"), F.lit(float("nan")).alias("num"), F.lit("NaN").alias("str")
    )
    cell = F.when(k % 5 == 4, nan).otherwise(logged)
    amount = equivalence.cells(events, ["value"])
    return events.select(
        F.concat(F.lit("ev-"), "event_id").alias("example_id"),
        F.lower(equivalence.normalize_cell(cell)).alias("cell"),
        equivalence.normalize_cell(F.get(amount, F.lit(0))).alias("amount"),
    )


@query(
    "row_cap",
    """, s AS (SELECT o, k, count(*) AS n, max(row_idx) AS last FROM candidate_rows GROUP BY o, k)
    SELECT 'o-' || o AS example_id, k AS candidate_index, least(n, 5) AS row_count, n > 5 AS truncated FROM s""",
    "candidate_rows",
)
def row_cap(t: Tables):
    """Row count and truncation of each result under a row cap."""
    _, sizes = equivalence.apply_row_cap(
        long_rows(t, "candidate_rows"), ["example_id", "candidate_index"], 5
    )
    return sizes.withColumn("row_count", F.col("row_count").cast("bigint"))


@query(
    "gold_cache",
    """, k AS (SELECT example_id, ord % 4 <> 0 AS cached, ord % 8 = 1 AS corrupt FROM examples)
    SELECT count(*) FILTER (cached AND NOT corrupt) AS hits, count(*) FILTER (NOT cached OR corrupt) AS misses FROM k""",
    "examples",
)
def gold_cache(t: Tables):
    """Which gold results can be reused; corrupt entries count as missing."""
    examples = t.adapted("examples")
    dataset, print_of = F.lit("0" * 64), F.sha2("schema_text", 256)
    key = equivalence.cache_key(dataset, print_of, F.col("db_id"), F.col("example_id"), F.col("gold_sql"))
    wanted = examples.select("example_id", key.alias("cache_key"))
    cached = examples.filter("ord % 4 <> 0").select(
        key.alias("cache_key"), F.when(F.col("ord") % 8 != 1, True).alias("success")
    )
    hits, misses = equivalence.cache_lookup(wanted, cached)
    from evalspark.operators.validate import one_row

    return one_row(hits.agg(F.count("*").alias("hits")), misses.agg(F.count("*").alias("misses")))


@query(
    "source_tables",
    """SELECT example_id, 'docs_' || evidence || CASE WHEN ord % 2 = 0 THEN ',labels' ELSE '' END AS tables,
      ord % 3 = 0 AS ordered, ord % 6 = 0 AS outer_ordered FROM examples""",
    "examples",
)
def tables_and_order(t: Tables):
    """Source tables of a query and whether it orders its rows, anywhere or outermost."""
    examples = t.adapted("examples")
    sql = F.concat(
        F.when(F.col("ord") % 3 == 0, "SELECT x, 'FROM a ORDER BY b' FROM (SELECT doc_id AS x FROM ").otherwise(
            "SELECT x /* JOIN c */ FROM (SELECT doc_id AS x FROM "
        ),
        F.lit('"docs_'),
        "evidence",
        F.when(F.col("ord") % 2 == 0, '" AS d, main.labels l').otherwise('"'),
        F.when((F.col("ord") % 3 == 0) & (F.col("ord") % 2 == 1), " ORDER  BY 1)").otherwise(")"),
        F.when(F.col("ord") % 6 == 0, " order by x").otherwise(""),
    )
    queries = examples.withColumn("sql", sql)
    return queries.select(
        "example_id",
        F.array_join(source_tables(F.col("sql")), ",").alias("tables"),
        has_order_by(F.col("sql")).alias("ordered"),
        outer_order_by(F.col("sql")).alias("outer_ordered"),
    )
