"""Dimensions of the silver layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indexing import with_row_index

PERSONA = ("customer_name", "sex", "age", "age_group", "occupation", "marital_status", "education_level", "family_type", "housing_type", "province", "district", "persona")


def dim_customer(customers: DataFrame, personas: DataFrame, customer_order: str = "customer_order", persona_order: str = "persona_id") -> DataFrame:
    """The n-th customer with the n-th persona, each in the order of an explicit key; those beyond the shorter table go."""
    left = with_row_index(customers, customer_order).select("row_idx", "customer_id", "customer_unique_id")
    right = with_row_index(personas, persona_order).select("row_idx", *PERSONA)
    return left.join(right, "row_idx").drop("row_idx")


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with their category in English. Whether the translation is broadcast is left to its size."""
    other = F.lit("unknown")
    return products.join(translation, "product_category_name", "left").select(
        "product_id", F.coalesce("product_category_name", other).alias("product_category_name"), F.coalesce("product_category_name_english", other).alias("product_category_name_english"),
        F.coalesce("product_photos_qty", F.lit(0)).alias("product_photos_qty"), "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    )


def dim_seller(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
