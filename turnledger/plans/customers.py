"""Customers and orders: lookups, recent orders and the order-status context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.text import iso_millis, normalise_order_id, order_reference, render
from turnledger.operators.joins import lookup
from turnledger.operators.ranking import top_k
from turnledger.plans.traces import customer_label

# Context texts handed to the writer of the reply.
NO_ORDERS = "(no orders found for this customer)"
ORDERS_HEAD = "Recent orders for this customer (most recent first):\n"
NO_CALLER = "(no caller identified, no order number provided)"
UNKNOWN_ORDER = "The caller asked about order {{ORDER}}, but no order with that ID exists in our system."
FOREIGN_ORDER = "The customer asked about order {{ORDER}}, but no order with that ID belongs to this customer.\n"


def _customer_row(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "tier", customer_label().alias("display_label"), "lifetime_value", "open_orders")


def customer_list(customers: DataFrame) -> DataFrame:
    """All customers by id."""
    return _customer_row(customers).orderBy("customer_id")


def customer_by_id(customers: DataFrame, customer_id: str) -> DataFrame:
    """One customer; the predicate reaches the scan."""
    return _customer_row(customers.where(F.col("customer_id") == customer_id))


def recent_orders(orders: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` newest orders per customer; ties on the date go to the greater key."""
    return top_k(orders, ["customer_id"], [F.desc("order_date"), F.desc("order_key")], k, rank="recency")


def order_lookup(requests: DataFrame, orders: DataFrame, strict: bool = False) -> DataFrame:
    """Find the order each request names."""
    wanted = requests.select(
        "request_id", normalise_order_id(order_reference("utterance", strict)).alias("order_id")
    ).where(F.col("order_id").isNotNull())
    found = orders.select("order_id", F.col("customer_id").alias("owner_id"), "status", iso_millis("order_date").alias("ordered_at"))
    return wanted.join(found, "order_id", "left").select(
        "request_id", "order_id", F.col("status").isNotNull().alias("found"), "owner_id", "status", "ordered_at"
    )


def customer_context(customers: DataFrame, orders: DataFrame, conversations: DataFrame) -> DataFrame:
    """What is known about a caller. Both facts are summed per customer before they
    are joined, so a busy customer is one row by then."""
    bought = orders.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.max("order_date").alias("last_order_at")
    )
    contacts = (
        conversations.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("contacts"),
            F.max_by("journey", F.struct("created_at", "trace_id")).alias("recent_journey"),
        )
    )
    return (
        customers.join(bought, "customer_id", "left")
        .join(contacts, "customer_id", "left")
        .select(
            "customer_id",
            "tier",
            customer_label().alias("display_label"),
            "lifetime_value",
            "open_orders",
            F.coalesce("orders", F.lit(0)).alias("orders"),
            iso_millis("last_order_at").alias("last_order_at"),
            F.coalesce("contacts", F.lit(0)).alias("prior_contacts"),
            "recent_journey",
        )
    )


def attach_customer(rows: DataFrame, customers: DataFrame, row_id: str = "trace_id") -> DataFrame:
    """Add label and tier to any rows with a customer id; anonymous when absent."""
    known = customers.select("customer_id", F.col("tier").alias("__tier"))
    joined = lookup(rows.drop("tier"), known, "customer_id", row_id)
    return joined.select(
        *[c for c in rows.columns if c != "tier"],
        F.coalesce("__tier", F.lit("anonymous")).alias("tier"),
        customer_label(tier="__tier").alias("customer_label"),
        F.col("__tier").isNull().alias("is_anonymous"),
    )


def _order_fields() -> Column:
    def when_set(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))

    def stamp(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss'+00:00'")

    return F.concat_ws(
        ", ",
        F.concat(F.lit("order_id="), "order_id"),
        F.concat(F.lit("sku="), "sku"),
        F.concat(F.lit("product_name="), "product_name"),
        F.concat(F.lit("quantity="), F.col("quantity").cast("string")),
        F.concat(F.lit("status="), "status"),
        F.concat(F.lit("order_date="), stamp("order_date")),
        when_set("eta", stamp("eta")),
        when_set("tracking_no", F.col("tracking_no")),
    )


def order_status_context(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """The facts a reply to each order-status request may use.

    Callers see only their own orders; anonymous callers are served by order number.
    Recent orders are cut to three per customer before they are gathered.
    """
    blocks = orders.withColumn("block", _order_fields())
    by_id = blocks.select("order_id", F.col("customer_id").alias("owner_id"), "block")
    recent = (
        recent_orders(blocks)
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct("recency", "block"))).alias("recent"))
    )
    asked_for = requests.withColumn("order_id", order_reference("utterance"))
    rows = lookup(lookup(asked_for, by_id, "order_id", "request_id"), recent, "customer_id", "request_id")
    listing = F.when(F.col("recent").isNull(), NO_ORDERS).otherwise(
        F.concat(
            F.lit(ORDERS_HEAD),
            F.array_join(F.transform("recent", lambda r: F.concat(F.lit("- "), r["block"])), "\n"),
        )
    )
    single = F.concat(F.lit(ORDERS_HEAD), F.lit("- "), F.col("block"))
    anonymous = F.col("customer_id").isNull()
    asked, found = F.col("order_id").isNotNull(), F.col("block").isNotNull()
    own = found & (F.col("owner_id") == F.col("customer_id"))

    def about(template: str) -> Column:
        return render(template, ORDER="order_id")

    context = (
        F.when(anonymous & ~asked, NO_CALLER)
        .when(anonymous & ~found, about(UNKNOWN_ORDER))
        .when(anonymous | own, single)
        .when(asked, F.concat(about(FOREIGN_ORDER), listing))
        .otherwise(listing)
    )
    return rows.select(
        "request_id",
        "customer_id",
        "order_id",
        F.when(anonymous & ~asked, "ask").when(anonymous, "by_order_id").otherwise("recent_for_customer").alias("lookup_mode"),
        found.alias("found"),
        F.coalesce(own, F.lit(False)).alias("own_order"),
        (anonymous & ~asked).alias("awaiting_slot"),
        context.alias("context"),
    )
