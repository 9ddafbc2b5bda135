"""Reading of the shared tables, and the register that the queries build from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: What the market segments of customers stand for in the register.
SEGMENTS = {"BUILDING": "wholesale", "AUTOMOBILE": "distributor", "MACHINERY": "food_manufacturer", "HOUSEHOLD": "retailer", "FURNITURE": "hotel"}
TODAY = "1998-08-02"


def today() -> Column:
    return F.lit(TODAY).cast("date")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads: region is the city, nation the state; the key's remainders say what is known of them."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    segment = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    status = F.element_at(F.array(*map(F.lit, ("new", "new", "new", "new", "new", "contacted", "quoted", "won", "lost", "ignored"))), (key % 10 + 1).cast("int"))
    return joined.select(
        key.alias("id"),
        F.lit("buyer").alias("kind"),
        F.coalesce(F.try_element_at(segment, F.col("c_mktsegment")), F.lit("other")).alias("segment"),
        F.col("c_name").alias("name"),
        F.col("r_name").alias("city"),
        F.col("n_name").alias("state"),
        F.when(key % 3 != 0, F.concat(F.lit("+9198"), F.lpad(key.cast("string"), 8, "0"))).alias("phone"),
        F.when(key % 4 == 0, F.concat(F.lit("buyer"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(key % 5 == 0, F.concat(F.lit("https://www.buyer"), key.cast("string"), F.lit(".example.com"))).alias("website"),
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit(" Main Road"))).alias("address"),
        F.when(key % 6 != 0, F.date_sub(today(), (key % 60).cast("int"))).alias("why_now_date"),
        status.alias("status"),
        F.concat(F.lit("src"), (key % 7).cast("string")).alias("source"),
        F.col("c_acctbal").alias("balance"),
    )


#: The register's SQL twin.
REGISTER_SQL = """
register AS (SELECT c_custkey AS id, 'buyer' AS kind,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'wholesale' WHEN 'AUTOMOBILE' THEN 'distributor' WHEN 'MACHINERY' THEN 'food_manufacturer' WHEN 'HOUSEHOLD' THEN 'retailer' WHEN 'FURNITURE' THEN 'hotel' ELSE 'other' END AS segment,
  c_name AS name, r_name AS city, n_name AS state,
  CASE WHEN c_custkey % 3 <> 0 THEN '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN 'buyer' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN 'https://www.buyer' || c_custkey || '.example.com' END AS website,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey || ' Main Road' END AS address,
  CASE WHEN c_custkey % 6 <> 0 THEN DATE '1998-08-02' - CAST(c_custkey % 60 AS INT) END AS why_now_date,
  ['new','new','new','new','new','contacted','quoted','won','lost','ignored'][CAST(c_custkey % 10 AS INT) + 1] AS status,
  'src' || (c_custkey % 7) AS source, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
scored AS (SELECT *,
  CASE segment WHEN 'distributor' THEN 26 WHEN 'caterer' THEN 22 WHEN 'retailer' THEN 18 WHEN 'institution' THEN 16 WHEN 'other' THEN 8 ELSE 30 END AS p_segment,
  CASE WHEN phone IS NOT NULL THEN 30 WHEN email IS NOT NULL THEN 20 WHEN website IS NOT NULL THEN 10 ELSE 0 END AS p_contact,
  CASE WHEN why_now_date IS NULL THEN 4 WHEN DATE '1998-08-02' - why_now_date <= 14 THEN 20 WHEN DATE '1998-08-02' - why_now_date <= 30 THEN 10 ELSE 0 END AS p_recency,
  CASE WHEN regexp_replace(lower(city), '[^a-z]', '', 'g') = 'asia' THEN 10 ELSE 0 END AS p_city,
  CASE WHEN address IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 5 ELSE 0 END AS p_detail,
  CASE WHEN status <> 'new' THEN -25 ELSE 0 END AS p_penalty FROM register),
leads AS (SELECT *, greatest(0, least(100, p_segment + p_contact + p_recency + p_city + p_detail + p_penalty)) AS score FROM scored)
"""
