"""Documents with headings and tables, rendered from the relational tables.

Two families in one set of elements. A region is a document and each of its nations a
page: a chapter heading on every page, an article heading, lines of suppliers in three
numbering styles, a table of supplier balances, a unit line and a page counter. A
customer is a document (doc_id from ORDERS_FROM on) and each of its orders a page, so
their number grows with the tables: chapters every third page, a running head in some
documents, article headings in five styles (one of them prose, one marked as
continued), a table of the order's items (some ragged, some without a header), units,
figures, contents on the first two pages, and counters. Pages of customers without an
order do not exist. The rows are made by DataFrames for Spark and by SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDERS_FROM = 100
LONG = "the holder named here keeps separate accounts for every calendar quarter"

_PAGES = """SELECT n_nationkey, n_name, n_regionkey, r_name,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS page_no
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

_BLOCKS = f"""
SELECT n_regionkey AS doc_id, page_no, 1 AS block, CAST(0 AS BIGINT) AS item, 'heading_1' AS type,
    concat('제', CAST(n_regionkey + 1 AS STRING), '장 ', r_name) AS content, '' AS caption FROM paged
UNION ALL
SELECT n_regionkey, page_no, 2, 0, 'heading_2', concat('제', CAST(n_nationkey + 1 AS STRING), '조(', n_name, ') general terms'), '' FROM paged
UNION ALL
SELECT n_regionkey, page_no, 3, s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'text' ELSE 'heading_3' END,
    CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN concat('① ', s_name, ' applies')
      WHEN 1 THEN concat(CAST(s_suppkey AS STRING), '. ', s_name, ' {LONG}')
      WHEN 2 THEN concat('가. ', s_name) ELSE concat('Supplier line of ', n_name, ' 및') END, ''
  FROM paged JOIN {{supplier}} ON s_nationkey = n_nationkey
UNION ALL
SELECT n_regionkey, page_no, 4, 0, 'heading_3', concat('Balances of ', n_name), '' FROM paged WHERE n_nationkey % 3 = 0
UNION ALL
SELECT n_regionkey, page_no, 5, 0, 'table', concat('<table><tr><td>key</td><td>cents</td></tr>',
    AGGREGATE(concat('<tr><td>', CAST(s_suppkey AS STRING), '</td><td>', CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS STRING), '</td></tr>'), s_suppkey), '</table>'), ''
  FROM paged JOIN {{supplier}} ON s_nationkey = n_nationkey GROUP BY n_regionkey, page_no
UNION ALL
SELECT n_regionkey, page_no, 6, 0, 'text', '(단위: 천원)', '' FROM paged WHERE n_nationkey % 2 = 0
UNION ALL
SELECT n_regionkey, page_no, 7, 0, 'text', concat('Supplier line of ', n_name, ' with'), '' FROM paged
UNION ALL
SELECT n_regionkey, page_no, 8, 0, 'toc_entry', concat(n_name, '::', CAST(page_no AS STRING)), '' FROM paged WHERE page_no <= 2
UNION ALL
SELECT n_regionkey, page_no, 9, 0, 'text', concat('- ', CAST(page_no AS STRING), ' -'), '' FROM paged WHERE n_nationkey % 2 = 1
"""

_ROWS = """SELECT CAST(doc_id AS INT) AS doc_id, CAST(page_no AS INT) AS page_no,
    CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block, item) - 1 AS INT) AS pos, type, content, caption FROM blocks"""


def _sql(aggregate: str) -> str:
    head, _, rest = _BLOCKS.partition("AGGREGATE(")
    depth, cut = 1, 0
    for cut, c in enumerate(rest):
        depth += (c == "(") - (c == ")")
        if not depth:
            break
    value, _, key = rest[:cut].rpartition(", ")
    return f"WITH paged AS ({_PAGES}), blocks AS ({head}{aggregate.format(value=value, key=key)}{rest[cut + 1:]}) {_ROWS}"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, pos, type, content, caption of every element of both families."""
    return region_elements(spark, sf_dir).unionByName(order_elements(spark, sf_dir))


def _item(kind: Column | str, content: Column | str) -> Column:
    return F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for x, n in ((kind, "type"), (content, "content"))])


def _some(when: Column, *items: Column) -> Column:
    return F.filter(F.array(*items), lambda _: when)


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as pages: three shuffles, of items, orders and customers by their keys."""
    customer, orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    say, text = (lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])), lambda c: c.cast("string")
    cells = F.struct("l_linenumber", say("<tr><td>", text(F.col("l_partkey")), "</td><td>", text(F.col("l_quantity").cast("long")), "</td><td>", text(F.round(F.col("l_extendedprice") * 100).cast("long")), "</td></tr>").alias("row"))
    items = lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(cells)), lambda x: x["row"]), "").alias("rows"))
    k, n = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = orders.join(items, F.col("l_orderkey") == k, "left").join(customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("page_no", n)
    page, key, name = text(F.col("page_no")), text(k), F.col("c_name")
    style = k % 5
    article = F.when(style == 0, _item("heading_2", say("제", page, "조(Order ", key, ") terms"))).when(style == 1, _item("heading_2", say(page, ".1 Shipment of order ", key)))
    article = article.when(style == 2, _item("heading_3", say("가. Order ", key))).when(style == 3, _item("text", say("제", page, F.when(k % 2 == 0, "조(Orders) ").otherwise("조 Orders by "), name, " 및"))).otherwise(_item("heading_2", say("Order ", key, " (continued)")))
    table = say("<table>", F.when(k % 4 == 1, "").otherwise("<tr><td>part</td><td>quantity</td><td>price</td></tr>"), F.col("rows"), F.when(k % 7 == 3, "<tr><td>total</td></tr>").otherwise(""), "</table>")
    parts = F.concat(
        _some(F.col("page_no") % 3 == 1, _item("heading_1", say("제", text(F.floor((F.col("page_no") + 2) / 3)), "장 ", F.col("c_mktsegment")))),
        _some(F.col("c_custkey") % 4 == 0, _item("heading_2", say("Ledger of ", name))),
        F.array(article, _item("text", say("Placed as ", F.col("o_orderpriority"), " by ", name, " in full"))),
        _some(k % 3 == 0, _item("heading_3", say("Items of order ", key))),
        _some(F.col("rows").isNotNull(), _item("table", table)),
        _some(k % 2 == 0, _item("text", "(단위: 천원)")),
        _some(k % 6 == 1, _item("figure", say("Chart of order ", key))),
        _some(F.col("page_no") <= 2, _item("toc_entry", say("Order ", key, "::", page))),
        _some(k % 2 == 1, _item("text", say("- ", page, " -"))),
    )
    made = pages.select((F.col("o_custkey") + ORDERS_FROM).cast("int").alias("doc_id"), F.col("page_no").cast("int").alias("n"), parts.alias("parts"))
    return made.select("doc_id", F.col("n").alias("page_no"), F.posexplode("parts").alias("pos", "x")).select("doc_id", "page_no", "pos", "x.type", "x.content", F.lit("").alias("caption"))


def region_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents, their nations as pages.

    A page's elements are one array, so each table is scanned once and the place in the array is the position.
    """
    region, nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier"))
    key, text = F.col("n_nationkey"), lambda c: c.cast("string")
    page = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    pages = nation.join(region, nation.n_regionkey == region.r_regionkey).withColumn("page_no", page)
    cents = F.round(F.col("s_acctbal") * 100).cast("long").alias("cents")
    held = supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), cents))).alias("held"))
    rows = pages.join(held, F.col("s_nationkey") == key, "left")

    def line(s: Column) -> Column:
        k = s["key"] % 4
        shown = F.when(k == 0, F.concat(F.lit("① "), s["name"], F.lit(" applies"))).when(k == 1, F.concat(text(s["key"]), F.lit(". "), s["name"], F.lit(f" {LONG}")))
        return _item(F.when(k == 3, "text").otherwise("heading_3"), shown.when(k == 2, F.concat(F.lit("가. "), s["name"])).otherwise(F.concat(F.lit("Supplier line of "), F.col("n_name"), F.lit(" 및"))))

    cells = F.array_join(F.transform("held", lambda s: F.concat(F.lit("<tr><td>"), text(s["key"]), F.lit("</td><td>"), text(s["cents"]), F.lit("</td></tr>"))), "")
    number = text(F.col("page_no"))
    parts = F.concat(
        F.array(
            _item("heading_1", F.concat(F.lit("제"), text(F.col("n_regionkey") + 1), F.lit("장 "), F.col("r_name"))),
            _item("heading_2", F.concat(F.lit("제"), text(key + 1), F.lit("조("), F.col("n_name"), F.lit(") general terms"))),
        ),
        F.coalesce(F.transform("held", line), F.filter(F.array(_item("", "")), lambda _: F.lit(False))),
        _some(key % 3 == 0, _item("heading_3", F.concat(F.lit("Balances of "), F.col("n_name")))),
        _some(F.col("held").isNotNull(), _item("table", F.concat(F.lit("<table><tr><td>key</td><td>cents</td></tr>"), F.coalesce(cells, F.lit("")), F.lit("</table>")))),
        _some(key % 2 == 0, _item("text", "(단위: 천원)")),
        F.array(_item("text", F.concat(F.lit("Supplier line of "), F.col("n_name"), F.lit(" with")))),
        _some(F.col("page_no") <= 2, _item("toc_entry", F.concat(F.col("n_name"), F.lit("::"), number))),
        _some(key % 2 == 1, _item("text", F.concat(F.lit("- "), number, F.lit(" -")))),
    )
    made = rows.select("n_regionkey", F.col("page_no").alias("n"), parts.alias("parts"))
    out = made.select(F.col("n_regionkey").cast("int").alias("doc_id"), F.col("n").cast("int").alias("page_no"), F.posexplode("parts").alias("pos", "x"))
    return out.select("doc_id", "page_no", "pos", "x.type", "x.content", F.lit("").alias("caption"))


_ORDERS = f"""
paged2 AS (SELECT CAST(o_custkey + {ORDERS_FROM} AS INT) AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey AS k, o_orderpriority AS prio, c_custkey AS c, c_name, c_mktsegment AS seg, cells
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, string_agg(cell, '' ORDER BY l_linenumber, cell) AS cells
    FROM (SELECT *, '<tr><td>' || l_partkey || '</td><td>' || CAST(trunc(l_quantity) AS BIGINT) || '</td><td>' || CAST(round(l_extendedprice * 100) AS BIGINT) || '</td></tr>' AS cell FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey),
blocks2 AS (SELECT doc_id, p, 1 AS block, 'heading_1' AS type, '제' || ((p + 2) // 3) || '장 ' || seg AS content FROM paged2 WHERE p % 3 = 1
UNION ALL SELECT doc_id, p, 2, 'heading_2', 'Ledger of ' || c_name FROM paged2 WHERE c % 4 = 0
UNION ALL SELECT doc_id, p, 3, CASE k % 5 WHEN 2 THEN 'heading_3' WHEN 3 THEN 'text' ELSE 'heading_2' END, CASE k % 5 WHEN 0 THEN '제' || p || '조(Order ' || k || ') terms' WHEN 1 THEN p || '.1 Shipment of order ' || k
  WHEN 2 THEN '가. Order ' || k WHEN 3 THEN '제' || p || CASE WHEN k % 2 = 0 THEN '조(Orders) ' ELSE '조 Orders by ' END || c_name || ' 및' ELSE 'Order ' || k || ' (continued)' END FROM paged2
UNION ALL SELECT doc_id, p, 4, 'text', 'Placed as ' || prio || ' by ' || c_name || ' in full' FROM paged2
UNION ALL SELECT doc_id, p, 5, 'heading_3', 'Items of order ' || k FROM paged2 WHERE k % 3 = 0
UNION ALL SELECT doc_id, p, 6, 'table', '<table>' || CASE WHEN k % 4 = 1 THEN '' ELSE '<tr><td>part</td><td>quantity</td><td>price</td></tr>' END || cells || CASE WHEN k % 7 = 3 THEN '<tr><td>total</td></tr>' ELSE '' END || '</table>' FROM paged2 WHERE cells IS NOT NULL
UNION ALL SELECT doc_id, p, 7, 'text', '(단위: 천원)' FROM paged2 WHERE k % 2 = 0
UNION ALL SELECT doc_id, p, 8, 'figure', 'Chart of order ' || k FROM paged2 WHERE k % 6 = 1
UNION ALL SELECT doc_id, p, 9, 'toc_entry', 'Order ' || k || '::' || p FROM paged2 WHERE p <= 2
UNION ALL SELECT doc_id, p, 10, 'text', '- ' || p || ' -' FROM paged2 WHERE k % 2 = 1)"""

#: The same rows in DuckDB, over its views.
_REGIONS = _sql("string_agg({value}, '' ORDER BY {key})").replace("{region}", "region").replace("{nation}", "nation").replace("{supplier}", "supplier")
SQL = f"SELECT * FROM ({_REGIONS}) UNION ALL SELECT * FROM (WITH {_ORDERS.strip()} SELECT doc_id, CAST(p AS INT), CAST(row_number() OVER (PARTITION BY doc_id, p ORDER BY block) - 1 AS INT), type, content, '' FROM blocks2)"
