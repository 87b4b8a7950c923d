"""Purges over customers, orders and their lines, with SQL written from the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import purge as P
from tarnwick.session import table

LEAST = -500


def purge_cascade(s: SparkSession, d: str) -> DataFrame:
    """Customers deep in debt go, with their orders and the lines of these; suppliers of a nation that loses its first customer go too, with their lines."""
    line = table(s, d, "lineitem").withColumn("line", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    nation = table(s, d, "nation").join(table(s, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first")), F.col("n_nationkey") == F.col("c_nationkey"))
    tables = {"customer": (table(s, d, "customer"), "c_custkey"), "orders": (table(s, d, "orders"), "o_orderkey"), "lineitem": (line, "line"), "nation": (nation, "n_nationkey"), "supplier": (table(s, d, "supplier"), "s_suppkey")}
    links = [("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("nation", "first", "customer"), ("supplier", "s_nationkey", "nation"), ("lineitem", "l_suppkey", "supplier")]
    gone = P.cascade(tables, links, {"customer": table(s, d, "customer").where(F.col("c_acctbal") < LEAST).select("c_custkey")})
    rows = [df.select(F.lit(name).alias("source"), F.col("key").cast("string").alias("key")) for name, df in gone.items()]
    return reduce(DataFrame.unionByName, rows)


def _address(user, n) -> F.Column:
    return F.concat(F.lit("box"), n.cast("string"), F.lit("@firm"), user.cast("string"), F.lit(".example"))


def purged_applications(s: SparkSession, d: str) -> DataFrame:
    """Orders as applications of their customers, whose notes and URLs name addresses; lines as mails; suppliers and some customers block addresses."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    apps = table(s, d, "orders").select(
        k.alias("app"), u.alias("user"), F.concat(F.lit("wrote to "), F.upper(_address(u % 50, k % 40)), F.lit(", then waited")).alias("notes"), F.when(k % 3 == 0, F.concat(F.lit("https://jobs.example/?to="), _address(u % 50, k % 60), F.lit("&x=1"))).alias("url"),
    )
    line = table(s, d, "lineitem")
    logs = line.where("l_linenumber = 1").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_orderkey") % 4 > 0, F.col("l_orderkey")).alias("app"), F.col("o_custkey").alias("user"), _address(F.col("l_suppkey") % 50, F.col("l_orderkey") % 80).alias("to_email"),
    )
    own = table(s, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("user"), _address(F.col("c_custkey") % 50, F.col("c_custkey") % 40).alias("email"), F.when(F.col("c_custkey") % 40 == 0, "manual").otherwise("bounce").alias("source"))
    all_ = table(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.lit(None).cast(own.schema["user"].dataType).alias("user"), F.concat(F.lit(" "), _address(F.col("s_suppkey") % 50, F.col("s_suppkey") % 7)).alias("email"), F.lit("manual").alias("source"))
    return P.dead_applications(apps, logs, own.unionByName(all_))


SQL = {
    "purge_cascade": f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < {LEAST}), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)),
        n AS (SELECT c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1 HAVING min(c_custkey) IN (FROM c)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n))
        SELECT 'customer' AS source, c_custkey::VARCHAR AS key FROM c UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM o UNION ALL SELECT 'nation', c_nationkey::VARCHAR FROM n UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM s
        UNION ALL SELECT DISTINCT 'lineitem', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey IN (FROM o) OR l_suppkey IN (FROM s)""",
    "purged_applications": """WITH a AS (SELECT o_orderkey AS app, o_custkey AS u, 'box' || o_orderkey % 40 || '@firm' || o_custkey % 50 || '.example' AS noted, CASE WHEN o_orderkey % 3 = 0 THEN 'box' || o_orderkey % 60 || '@firm' || o_custkey % 50 || '.example' END AS linked FROM orders),
        m AS (SELECT l_orderkey AS app, 'box' || l_orderkey % 80 || '@firm' || l_suppkey % 50 || '.example' AS mailed FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 > 0),
        b AS (SELECT DISTINCT CASE WHEN c_custkey % 40 = 0 THEN c_custkey END AS whose, 'box' || c_custkey % 40 || '@firm' || c_custkey % 50 || '.example' AS email FROM customer WHERE c_custkey % 20 = 0
            UNION SELECT NULL, 'box' || s_suppkey % 7 || '@firm' || s_suppkey % 50 || '.example' FROM supplier WHERE s_suppkey % 3 = 0),
        x AS (SELECT a.app, a.u, mailed AS email, 'log' AS kind FROM a JOIN m USING (app) UNION ALL SELECT app, u, noted, 'notes' FROM a UNION ALL SELECT app, u, linked, 'url' FROM a)
        SELECT app, u AS user, bool_or(kind = 'log') AS by_log, bool_or(kind = 'notes') AS by_notes, bool_or(kind = 'url') AS by_url FROM x JOIN b ON b.email = x.email AND (whose IS NULL OR whose = u) GROUP BY app, u""",
}
QUERIES = {name: globals()[name] for name in SQL}
