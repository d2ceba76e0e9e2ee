"""The commerce tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_group, first_word


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n: Column) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, n.cast("int"))


def _hours(n: Column) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, n.cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status, day = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    return raw(spark, sf_dir, "orders").select(
        k.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(status == "P", "canceled").when(status == "F", "delivered").when(status == "O", "shipped").alias("order_status"),
        day.alias("order_purchase_timestamp"),
        F.when(k % 11 != 0, day + _hours(k % 48)).alias("order_approved_at"),
        F.when(status.isin("F", "O") & (k % 13 != 0), day + _days(k % 5 + 1)).alias("order_delivered_carrier_date"),
        F.when(status == "F", day + _days(k % 23 + 3)).alias("order_delivered_customer_date"),
        (day + _days(F.lit(14))).alias("order_estimated_delivery_date"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    freight = F.round((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(38,8)"), 2).cast("double")
    return raw(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        freight.alias("freight_value"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payment_value"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    return raw(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (k % 7 != 0)).select(
        F.concat(F.lit("R"), k).alias("review_id"),
        k.cast("string").alias("order_id"),
        (k % 5 + 1).cast("int").alias("review_score"),
        (day + _days(F.lit(30))).alias("review_creation_date"),
        F.when(k % 9 != 0, day + _days(k % 6 + 30)).alias("review_answer_timestamp"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_unique_id"), F.col("c_custkey").alias("customer_order"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return raw(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit("MEDIUM")).alias("product_category_name"),
        F.when(size % 4 != 0, size % 6).alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
    )


def category_translation(spark: SparkSession) -> DataFrame:
    rows = [(c, c.lower()) for c in ("STANDARD", "PROMO", "ECONOMY", "LARGE")]
    return spark.createDataFrame(rows, "product_category_name string, product_category_name_english string")


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = raw(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = raw(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return found.select(
        F.col("s_suppkey").cast("string").alias("seller_id"), F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"), F.col("n_name").alias("seller_state"),
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    numbered = lambda name, n: F.concat(F.lit(f"{name}_"), k % n).alias(name)
    age = F.lit(20) + F.col("p_size")
    return raw(spark, sf_dir, "part").select(
        k.alias("persona_id"), first_word("p_name").alias("customer_name"), F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
        age.cast("int").alias("age"), age_group(age).alias("age_group"), F.col("p_brand").alias("occupation"),
        numbered("marital_status", 3), numbered("education_level", 4), numbered("family_type", 5), numbered("housing_type", 3),
        numbered("province", 17), numbered("district", 40), F.col("p_name").alias("persona"),
    )
