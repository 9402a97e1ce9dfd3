"""DuckDB SQL for the marketplace views, used to build oracle queries.

``with_views("C", "C_products")`` returns a ``WITH`` prefix defining the
requested views (dependencies included, in order).
"""

from __future__ import annotations

from tidewater.sources.views import INDUSTRY_RULES

_RULE_ROWS = ", ".join(f"('{i}', '{c}')" for i, cats in INDUSTRY_RULES.items() for c in cats)

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "C_products": ((), f"""
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
               p_retailprice AS price, p_brand || ' ' || p_name AS description
        FROM part"""),
    "C": (("C_products",), """
        SELECT e.event_id AS interaction_id, 'customer' AS user_type, e.user_id,
               e.k AS item_id, 'product' AS item_type, e.event_type AS interaction_type,
               p.category, CAST(CASE WHEN e.event_type = 'purchase' THEN e.event_id % 4 + 1 ELSE 1 END AS INTEGER) AS quantity,
               p.price, e.ts AS interaction_timestamp
        FROM (SELECT event_id, ts, user_id, event_type,
                     TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
        LEFT JOIN C_products p ON e.k = p.product_id"""),
    "O_materials": ((), """
        SELECT p_partkey AS material_id, p_name AS material_name, p_type AS category,
               p_retailprice AS price, p_brand || ' ' || p_name AS description
        FROM part"""),
    "O": ((), """
        SELECT 'owner' AS user_type, l.l_suppkey AS user_id, l.l_partkey AS item_id,
               'raw_material' AS item_type,
               CASE l.l_returnflag WHEN 'R' THEN 'reorder' WHEN 'N' THEN 'purchase' WHEN 'A' THEN 'view' END AS interaction_type,
               p.p_type AS category, CAST(l.l_quantity AS INTEGER) AS quantity, p.p_retailprice AS price,
               l.l_shipdate AS interaction_timestamp
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
    "CATIDS": ((), """
        SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS category_id
        FROM (SELECT DISTINCT p_type FROM part)"""),
    "D": (("CATIDS",), """
        SELECT 'owner' AS user_type, l.l_suppkey AS user_id, c.category_id AS item_id,
               'raw_material' AS item_type,
               CASE l.l_returnflag WHEN 'R' THEN 'reorder' WHEN 'N' THEN 'purchase' WHEN 'A' THEN 'view' END AS interaction_type,
               p.p_type AS category, CAST(l.l_quantity AS INTEGER) AS quantity, p.p_retailprice AS price,
               l.l_shipdate AS interaction_timestamp
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN CATIDS c ON p.p_type = c.p_type"""),
    "K": ((), """
        SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type) AS BIGINT) AS kid, p_brand, p_type, price
        FROM (SELECT p_brand, p_type, min(p_retailprice) AS price FROM part GROUP BY p_brand, p_type)"""),
    "PK": (("K",), """
        SELECT p.p_partkey, p.p_brand, p.p_type, p.p_retailprice, k.kid
        FROM part p JOIN K k ON p.p_brand = k.p_brand AND p.p_type = k.p_type"""),
    "OK": (("PK",), """
        SELECT 'owner' AS user_type, l.l_suppkey AS user_id, pk.kid AS item_id,
               'raw_material' AS item_type,
               CASE l.l_returnflag WHEN 'R' THEN 'reorder' WHEN 'N' THEN 'purchase' WHEN 'A' THEN 'view' END AS interaction_type,
               pk.p_type AS category, CAST(l.l_quantity AS INTEGER) AS quantity, pk.p_retailprice AS price,
               l.l_shipdate AS interaction_timestamp
        FROM lineitem l JOIN PK pk ON l.l_partkey = pk.p_partkey"""),
    "OK_materials": (("K",), """
        SELECT kid AS material_id, p_brand || ' ' || p_type AS material_name, p_type AS category,
               price, p_brand AS description FROM K"""),
    "OLK": (("PK",), """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, o.o_custkey, o.o_orderdate, pk.kid
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN PK pk ON l.l_partkey = pk.p_partkey"""),
    "T": (("OLK",), """
        SELECT o_custkey AS customer_id, kid AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               o_orderdate AS timestamp FROM OLK"""),
    "T_products": (("K",), """
        SELECT kid AS product_id, p_brand || ' ' || p_type AS name, p_type AS category,
               p_brand AS subcategory, price FROM K"""),
    "T_customers": (("CATIDS",), """
        SELECT c.c_custkey AS customer_id, t.p_type AS preferred_category
        FROM customer c JOIN CATIDS t ON (c.c_custkey % (SELECT count(*) FROM CATIDS)) + 1 = t.category_id"""),
    "M": (("OLK",), """
        SELECT o_custkey AS owner_id, kid AS material_id, CAST(l_quantity AS INTEGER) AS quantity,
               o_orderdate AS date, l_orderkey, l_linenumber, l_partkey FROM OLK"""),
    "M_owners": ((), """SELECT c_custkey AS owner_id, c_mktsegment AS industry FROM customer"""),
    "RULES": ((), f"""SELECT * FROM (VALUES {_RULE_ROWS}) AS r(industry, category)"""),
    "P": ((), """
        SELECT user_id, movie_id, rating FROM (
          SELECT user_id, movie_id, rating,
                 row_number() OVER (PARTITION BY user_id, movie_id ORDER BY event_id) AS rn
          FROM (SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS movie_id,
                       CAST(1 + (CAST(floor(value) AS BIGINT) % 5 + 5) % 5 AS INTEGER) AS rating FROM events))
        WHERE rn = 1"""),
    "P_items": ((), f"""
        SELECT p_partkey AS movie_id, p_name AS title, p_type AS genre, p_brand || ' ' || p_name AS description
        FROM part"""),
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n][1]}\n)" for n in order) + "\n"


# ---- SQL expression helpers (DuckDB) --------------------------------------

def weight_sql(col: str = "interaction_type") -> str:
    from tidewater.functions.constants import INTERACTION_WEIGHTS, UNKNOWN_WEIGHT
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in INTERACTION_WEIGHTS.items())
    return f"CAST(COALESCE(CASE lower(trim({col})) {cases} END, {UNKNOWN_WEIGHT}) AS DOUBLE)"


def raw_weight_sql(col: str = "interaction_type") -> str:
    from tidewater.functions.constants import RAW_WEIGHTS
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RAW_WEIGHTS.items())
    return f"CAST(CASE {col} {cases} END AS DOUBLE)"


def days_sql(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 86400000000.0)"


def scored_sql(view: str, rate: float, with_quantity: bool, name: str = "S") -> str:
    """CTE text ``name AS (...)``: events with weight, decay and event_score."""
    q = " * quantity" if with_quantity else ""
    return f"""{name} AS (
        SELECT *, interaction_weight * decay_weight{q} AS event_score FROM (
          SELECT *, {weight_sql()} AS interaction_weight,
                 exp(CAST({-rate} AS DOUBLE) * {days_sql('interaction_timestamp', f'(SELECT max(interaction_timestamp) FROM {view})')}) AS decay_weight
          FROM {view}))"""
